"""Language-model scoring by a subword lattice.

The edges of a word's lattice are a public vocabulary's pieces and, from its start to its end, the word itself if
training rows have it. Each edge has a unigram weight; the forward recursion in log space sums over all segmentations
of a word, and a document's probability is the product over its words and one end. Pieces that start a word ("▁...")
and pieces inside one are told apart, so that piece sequences and word sequences match and the probabilities of all
documents sum to at most one. Single bytes are pieces too, so every word has a segmentation. The vocabulary's own
scores (ranks) are the pieces' weights to begin with; as pieces stand for words that are rare or new, they are fitted
by expectation maximisation to the distinct words of training rows. A whole word's weight is its count less a
discount, and what is discounted in all is the weight of going by pieces.

Corpora mix languages and kinds of text. Documents fall in CLASSES classes, found without labels by all training rows'
words; each class has its own discounted counts above those of all, and a document's probability is the sum over the
classes, each with its share of training rows.

Counts follow the corpus: words of all documents are counted in one shuffle, the lattice runs once per distinct word,
and documents get their words' values from a bounded table of the most frequent words or else through a second shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.bytetext import Words, prefix_sums, span_hash, words
from pointlake.llm.common import batches, column, discard, least_hashed, materialise, rows_of, text_blocks, tidy, tune

#: Words whose values documents look up in place: a table of this many rows of 24 bytes goes to every task.
HEAD_WORDS = 100_000
#: Passes over the distinct training words that fit the weights.
ROUNDS = 1
#: Words that run through the lattice together.
POOLED = 8192
#: Added to every piece's expected count.
FLOOR = 0.01
SMOOTH = 0.1
#: Classes of documents, buckets of words that tell them apart, passes over all training rows, and rows that the first
#: centres are chosen from.
CLASSES, FEATURES, CLASS_PASSES, SEEDS = 6, 4096, 3, 256
_WIDTHS = np.array([4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256])


class Slots:
    """Positions of 64-bit keys in an array, by two tables of slots and a search for the few that neither holds."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(8, int(len(keys) * 8).bit_length())
        self.tables, left = [], np.arange(len(keys))
        for k in range(2):
            table = np.full(1 << self.bits, -1, np.int32)
            table[self._slot(keys[left], k)] = left
            left = left[table[self._slot(keys[left], k)] != left]
            self.tables.append(table)
        order = np.argsort(keys[left])
        self.left, self.left_keys = left[order], keys[left][order]

    def _slot(self, keys: np.ndarray, k: int) -> np.ndarray:
        return ((keys << np.uint64(k * self.bits)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self.tables[0][self._slot(keys, 0)].astype(np.int64)
        miss = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        if len(miss):
            at = self.tables[1][self._slot(keys[miss], 1)].astype(np.int64)
            wrong = (at < 0) | (self.keys[at] != keys[miss])
            out[miss] = np.where(wrong, -1, at)
            if len(self.left):
                rest = miss[wrong]
                j = np.minimum(np.searchsorted(self.left_keys, keys[rest]), len(self.left) - 1)
                out[rest] = np.where(self.left_keys[j] == keys[rest], self.left[j], -1)
        return out


@dataclass
class Pieces:
    """Pieces by number: those inside a word first, then those that start one, then the bare start. weight: their
    first probabilities."""

    inner: list[bytes]
    initial: list[bytes]
    weight: np.ndarray

    @property
    def bare(self) -> int:
        return len(self.inner) + len(self.initial)


def read_pieces(file: str) -> Pieces:
    """The pieces of a sentencepiece file that lower-cased words can hold. A score is a merge rank with a minus sign;
    the first weight of rank r is in proportion to 1 / (r + 10), as frequencies are to ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    inner, initial, bare = {bytes([k]): 1e-6 for k in range(256)}, {}, 1e-3
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k):
            continue
        piece, weight = model.id_to_piece(k), 1.0 / (10.0 + max(0.0, -model.get_score(k)))
        if any("A" <= c <= "Z" or c in "\t\n\v\f\r " for c in piece) or "▁" in piece[1:]:
            continue
        if piece == "▁":
            bare = max(bare, weight)
        elif piece[0] == "▁":
            initial[piece[1:].encode()] = weight
        else:
            inner[piece.encode()] = inner.get(piece.encode(), 0.0) + weight
    weight = np.array([*inner.values(), *initial.values(), bare])
    return Pieces(list(inner), list(initial), weight / weight.sum())


class Lattice:
    """Probabilities of words under pieces with log weights."""

    def __init__(self, pieces: Pieces, log_weight: np.ndarray):
        self.pieces, self.log_weight = pieces, log_weight
        self.tables = [self._table(pieces.inner, 0), self._table(pieces.initial, len(pieces.inner))]

    @staticmethod
    def _table(strings: list[bytes], base: int) -> tuple[np.ndarray, Slots, int]:
        data = np.frombuffer(b"".join(strings), np.uint8)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        end = np.cumsum(size)
        keys = span_hash(prefix_sums(data), end - size, end)
        return np.unique(size), Slots(keys), base

    def _edges(self, sums: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) of the lattices of words, by ascending `from`; -1 is the place before a word's
        start, from which pieces that start a word lead to their end."""
        for at in range(-1, width):
            begin = max(at, 0)
            sizes, slots, base = self.tables[at < 0]
            for size in sizes:
                if begin + size > width:
                    break
                rows = np.flatnonzero(length >= begin + size)
                if not len(rows):
                    break
                found = slots.find(span_hash(sums, start[rows] + begin, start[rows] + begin + size))
                some = found >= 0
                if some.any():
                    yield at, begin + int(size), rows[some], found[some] + base

    def run(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural-log probability of each word data[start:start+length]; with counts, also the expected number of
        each piece over all words times their counts."""
        sums, out = prefix_sums(data), np.zeros(len(start))
        expected = None if count is None else np.zeros(len(self.log_weight))
        bucket = np.searchsorted(_WIDTHS, length)
        for k in np.unique(bucket):
            rows = np.flatnonzero(bucket == k)
            width = int(length[rows].max())
            most = max(1, (1 << 22) // (width + 2))
            for low in range(0, len(rows), most):
                part = rows[low : low + most]
                out[part] = self._forward(sums, start[part], length[part], width, None if count is None else count[part], expected)
        return out, expected

    def _forward(self, sums: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, count: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        n, weight = len(start), self.log_weight
        forward = np.full((n, width + 1), -np.inf)
        forward[:, 0] = weight[self.pieces.bare]
        kept = []
        for at, to, rows, piece in self._edges(sums, start, length, width):
            step = weight[piece] + (forward[rows, at] if at >= 0 else 0.0)
            forward[rows, to] = np.logaddexp(forward[rows, to], step)
            if count is not None:
                kept.append((at, to, rows, piece))
        total = forward[np.arange(n), length]
        if count is not None:
            backward = np.full((n, width + 1), -np.inf)
            backward[np.arange(n), length] = 0.0
            for at, to, rows, piece in reversed(kept):
                step = weight[piece] + backward[rows, to]
                if at >= 0:
                    backward[rows, at] = np.logaddexp(backward[rows, at], step)
                    step = step + forward[rows, at]
                expected += np.bincount(piece, np.exp(step - total[rows]) * count[rows], len(expected))
            expected[self.pieces.bare] += (np.exp(backward[:, 0] + weight[self.pieces.bare] - total) * count).sum()
        return total


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from. A row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


@dataclass
class Classes:
    """Centres of classes over FEATURES buckets of words, of length 1 each, and the log share of each class."""

    centre: np.ndarray
    log_share: np.ndarray

    def features(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, bucket, value) that are not zero: roots of the buckets' shares of each document's words."""
        key, n = np.unique(w.doc * FEATURES + (w.hash >> np.uint64(52)).astype(np.int64), return_counts=True)
        doc = key // FEATURES
        return doc, key % FEATURES, np.sqrt(n / np.maximum(w.count, 1)[doc])

    def of(self, w: Words) -> np.ndarray:
        """The class with the nearest centre of each document; of equal ones, as for no words, the first."""
        doc, bucket, value = self.features(w)
        return np.stack([np.bincount(doc, value * c[bucket], len(w.count)) for c in self.centre]).argmax(axis=0)


def find_classes(docs: DataFrame, number: int = CLASSES, passes: int = CLASS_PASSES, seeds: int = SEEDS) -> Classes:
    """Spherical k-means over all rows not held out: each pass deals every one of them to its nearest centre and sums up
    what the new centres and shares are. The first centres are far from each other among `seeds` rows, those with the
    least hash of their id, and nothing else depends on these."""
    learnt = docs.where("not held_out")
    ids = least_hashed(learnt.where("doc_id is not null").select("doc_id").distinct(), "doc_id", seeds)
    named = learnt.join(F.broadcast(ids), "doc_id", "left_semi")
    none = Classes(np.zeros((number, FEATURES)), np.full(number, -np.log(number)))
    found_schema = pa.schema([("x", pa.list_(pa.float64()))])

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(it):
            for _, _, data, offsets in text_blocks(column(b, "text")):
                w = words(data, offsets)
                doc, bucket, value = none.features(w)
                x = np.zeros((len(w.count), FEATURES))
                x[doc, bucket] = value
                yield batches({"x": list(x[w.count >= 20])}, found_schema)

    rows = sorted({tuple(r.x) for r in named.select("text").mapInArrow(vectors, "x array<double>").collect()})
    if not rows:
        return none
    root = np.array(rows)
    centre = [root.mean(0)]
    for _ in range(number):
        centre.append(root[np.min([((root - c) ** 2).sum(1) for c in centre[1:] or centre], axis=0).argmax()])
    classes = Classes(np.stack(centre[1:]), none.log_share)
    sum_schema = pa.schema([("at", pa.int32()), ("v", pa.float64())])
    for _ in range(passes):
        now = classes

        def sums(it: Iterator[pa.RecordBatch], now: Classes = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((number, FEATURES + 1))  # the last column has the number of documents
            for b in rows_of(it):
                for _, _, data, offsets in text_blocks(column(b, "text")):
                    w = words(data, offsets)
                    label = now.of(w)
                    doc, bucket, value = now.features(w)
                    total += np.bincount(label[doc] * (FEATURES + 1) + bucket, value, total.size).reshape(total.shape)
                    total[:, FEATURES] += np.bincount(label[w.count > 0], minlength=number)
            some = np.flatnonzero(total.ravel())
            yield batches({"at": some.astype(np.int32), "v": total.ravel()[some]}, sum_schema)

        total = np.zeros(number * (FEATURES + 1))
        for r in learnt.select("text").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            total[r["at"]] = r.v  # a row for each class and bucket
        total = total.reshape(number, -1)
        empty = total[:, FEATURES] == 0
        centre = np.where(empty[:, None], classes.centre, total[:, :FEATURES])
        share = total[:, FEATURES] + 1.0
        classes = Classes(centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12), np.log(share / share.sum()))
    return classes


def count_words(docs: DataFrame, classes: Classes) -> DataFrame:
    """(h, word, c0, c1, ...): every distinct word of docs (doc_id, text, held_out) with its count in rows of each class
    not held out."""
    number = len(classes.log_share)
    schema = pa.schema([("h", pa.int64()), ("word", pa.string()), *[(f"c{k}", pa.int64()) for k in range(number)]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(it):
            learnt = ~column(b, "held_out").to_numpy(zero_copy_only=False)
            for low, high, data, offsets in text_blocks(column(b, "text")):
                w = words(data, offsets)
                if not len(w.hash):
                    continue
                kind = np.where(learnt[low:high], classes.of(w), number)
                keys, first, at = np.unique(w.hash, return_index=True, return_inverse=True)
                count = np.bincount(at * (number + 1) + kind[w.doc], minlength=len(keys) * (number + 1)).reshape(len(keys), -1)
                raw = data.tobytes()
                spelt = [raw[s:e].lower() for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
                out = pa.array(spelt, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), out, *[pa.array(count[:, k]) for k in range(number)]], schema=schema)

    kinds = ", ".join(f"c{k} long" for k in range(number))
    return docs.mapInArrow(run, f"h long, word string, {kinds}").groupBy("h", "word").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(number)])


def _word_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of a batch of words."""
    for _, _, data, offsets in text_blocks(column(batch, "word"), 1 << 40):
        return data, offsets[:-1], np.diff(offsets)
    return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)


def _pooled(it: Iterator[pa.RecordBatch], most: int = POOLED) -> Iterator[pa.RecordBatch]:
    """Batches of words put together until they have `most` rows: the lattice takes words of a width at once."""
    held: list[pa.RecordBatch] = []
    for b in rows_of(it):
        held.append(b)
        if sum(x.num_rows for x in held) >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def expected_pieces(counted: DataFrame, lattice: Lattice) -> np.ndarray:
    """Expected number of each piece in the distinct training words: summed by task, then by piece."""
    schema = pa.schema([("piece", pa.int32()), ("e", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lattice.log_weight))
        for b in _pooled(it):
            data, start, length = _word_arrays(b)
            total += lattice.run(data, start, length, np.ones(len(start)))[1]
        some = np.flatnonzero(total)
        yield batches({"piece": some.astype(np.int32), "e": total[some]}, schema)

    out = np.zeros(len(lattice.log_weight))
    for r in counted.where("c > 0").select("word").mapInArrow(run, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect():
        out[r.piece] = r.e  # a row a piece of the vocabulary
    return out


def fit(counted: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Lattice:
    """The vocabulary's weights fitted to the distinct training words."""
    lattice = Lattice(pieces, np.log(pieces.weight))
    for _ in range(rounds):
        expected = expected_pieces(counted, lattice) + FLOOR
        lattice = Lattice(pieces, np.log(expected / expected.sum()))
    return lattice


def most_frequent(valued: DataFrame, most: int) -> DataFrame:
    """At most `most` of the most frequent words: those from a count on that so few reach. The count comes from a
    histogram of some hundred steps, so nothing is sorted and no task or driver holds more rows than that."""
    step = F.floor(F.log2(F.col("c")) * 16).cast("int")
    total, least = 0, None
    for r in sorted(valued.where("c > 0").groupBy(step.alias("s")).count().collect(), key=lambda r: -r.s):
        total += r["count"]
        if total > most:
            break
        least = r.s
    return valued.where((F.col("c") > 0) & (step >= least) if least is not None else F.lit(False))


def score(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """A row for every row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (A-Z lower-cased) and one end for each text; null texts count as empty. base_score: log10 of a
    smoothed unigram over the training tokens; score: the lattice's log10 probability. Without training rows the
    vocabulary's own weights are used, smoothed. Equal rows get equal results, as often as they occur. Words are told
    apart by 64-bit hashes."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("held_out", held_out())
    classes = find_classes(rows)
    each = range(len(classes.log_share))
    counted, counted_path = materialise(count_words(rows, classes).withColumn("c", sum((F.col(f"c{k}") for k in each[1:]), F.col("c0"))), "words")
    ends = rows.where(~F.col("held_out")).count()
    number = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    facts = counted.agg(number(F.col("c")), number(F.col("c") > 0), number(F.col("c") == 1), number(F.col("c") == 2), *[number(F.col(f"c{k}")) for k in each], *[number(F.col(f"c{k}") > 0) for k in each]).first()
    tokens, kinds, once, twice = facts[:4]
    class_tokens, class_kinds = np.array(facts[4 : 4 + len(each)], float), np.array(facts[4 + len(each) :], float)
    total, distinct = tokens + ends, kinds + (ends > 0)
    lattice = fit(counted, read_pieces(file), rounds)
    discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    # By pieces and as whole words, above both by classes: shares that add up to one; a document's end is a token too.
    by_pieces = discount * kinds / tokens if tokens else 1.0
    by_all = np.where(class_tokens > 0, discount * class_kinds / np.maximum(class_tokens, 1), 1.0)
    end_share = ends / total if tokens else 0.001
    value_schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), *[(f"lp{k}", pa.float64()) for k in each]])

    def values(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pooled(it):
            data, start, length = _word_arrays(b)
            count = column(b, "c").to_numpy()
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(count - discount, 0.0) / max(tokens, 1))
                lp = np.logaddexp(whole, lattice.run(data, start, length)[0] + np.log(by_pieces))
                own = [np.log(np.maximum(column(b, f"c{k}").to_numpy() - discount, 0.0) / max(class_tokens[k], 1)) for k in each]
            out = {f"lp{k}": (np.logaddexp(own[k], lp + np.log(by_all[k])) + np.log1p(-end_share)) / np.log(10.0) for k in each}
            yield batches({"h": column(b, "h"), "c": count, **out}, value_schema)

    lps = [f"lp{k}" for k in each]
    lp_kinds = ", ".join(f"{k} double" for k in lps)
    valued, _ = materialise(counted.mapInArrow(values, f"h long, c long, {lp_kinds}"), "values")
    discard(spark, counted_path)
    head = most_frequent(valued, head_words).toPandas()
    head_h, head_c = head["h"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)
    head_values = [(head_c > 0).astype(np.float64), np.log10(head_c + SMOOTH), *[head[k].to_numpy(np.float64) for k in lps]]

    # One row a document with what its frequent words add up to (h null), and one for each other word with its number.
    part_schema = pa.schema([("h", pa.int64()), ("r", pa.int64()), ("r2", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), *[(k, pa.float64()) for k in lps], ("doc_id", pa.int64())])
    slots: list[Slots] = []

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not slots:
            slots.append(Slots(head_h))
        for b in rows_of(it):
            r, r2, doc_id = column(b, "r"), column(b, "r2"), column(b, "doc_id")
            for low, high, data, offsets in text_blocks(column(b, "text")):
                w, n = words(data, offsets), high - low
                at = slots[0].find(w.hash)
                inside, tail = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                d, j = w.doc[inside], at[inside]
                sums = [np.bincount(d, x[j], n) if len(j) else np.zeros(n) for x in head_values]
                own = [pa.nulls(n, pa.int64()), r.slice(low, n), r2.slice(low, n), pa.array(w.count.astype(np.int64)), pa.array(sums[0].astype(np.int64)), *[pa.array(x) for x in sums[1:]], doc_id.slice(low, n)]
                yield pa.RecordBatch.from_arrays(own, schema=part_schema)
                if len(tail):
                    doc, h = w.doc[tail], w.hash[tail]
                    order = np.lexsort((h, doc))
                    doc, h = doc[order], h[order]
                    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
                    number = np.diff(np.append(first, len(h)))
                    rest = [pa.nulls(len(first), f.type) for f in list(part_schema)[4:]]
                    yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), r.slice(low, n).take(pa.array(doc[first])), r2.slice(low, n).take(pa.array(doc[first])), pa.array(number.astype(np.int64)), *rest], schema=part_schema)

    both, _ = materialise(rows.select(F.xxhash64("doc_id", "text").alias("r"), F.xxhash64(F.lit(1), "text", "doc_id").alias("r2"), "doc_id", "text").mapInArrow(parts, f"h long, r long, r2 long, n long, known long, logs double, {lp_kinds}, doc_id long"), "parts")
    own = both.where("h is null").select("r", "r2", F.lit(1).alias("copies"), (F.col("n") + 1).alias("n_tokens"), (F.col("known") + F.lit(int(ends > 0))).alias("known"), (F.col("logs") + F.lit(float(np.log10(ends + SMOOTH)))).alias("logs"), *lps, "doc_id")
    rare = both.where("h is not null").select("h", "r", "r2", "n").join(valued, "h").select(
        "r", "r2", F.lit(0).alias("copies"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10(F.col("c") + F.lit(SMOOTH))).alias("logs"), *[(F.col("n") * F.col(k)).alias(k) for k in lps], F.lit(None).cast("long").alias("doc_id")
    )
    summed = own.unionByName(rare).groupBy("r", "r2").agg(*[F.sum(k).alias(k) for k in ("copies", "n_tokens", "known", "logs", *lps)], F.max("doc_id").alias("doc_id"))
    scale = float(np.log10(total + SMOOTH * (distinct + 1)))
    one = lambda k: F.col(k) / F.col("copies")
    log10_share = classes.log_share / np.log(10.0)
    of_class = [one(k) + F.lit(float(share)) for k, share in zip(lps, log10_share, strict=True)]
    best = F.greatest(*of_class)
    marginal = best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in of_class[1:]), F.pow(F.lit(10.0), of_class[0] - best)))
    result = summed.select(
        "doc_id",
        held_out().alias("held_out"),
        one("n_tokens").cast("long").alias("n_tokens"),
        one("known").cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (one("logs") - one("n_tokens") * F.lit(scale)).alias("base_score"),
        (marginal + F.lit(float(np.log10(end_share)))).alias("score"),
        "copies",
    )
    return result.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
