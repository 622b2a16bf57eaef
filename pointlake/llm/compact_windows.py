"""Substring dedup by compact windows.

The tokens of a document are its runs of five words. For each of FUNCTIONS hash functions a Cartesian tree over the
tokens' hashes groups all subsequences of at least a passage's length by their minimum, so a few windows (c, l, r) stand
for all of them: every subsequence that begins in l..c and ends in c..r has its minimum at c. Two texts with a passage of
Jaccard similarity s have equal minima for each function with probability s.

1. Windows with equal minima meet, and each is linked to the window of the smallest document (spans() says how hot
   minima are kept apart). Documents of equal words count as one from the start.
2. The windows that two documents are linked by are joined as intervals: a pair is a candidate where ENOUGH functions
   agree on a common subsequence in both.
3. Candidates' tokens are aligned, which gives exact passages and similarities.
   Each document is compared with the one that most of its windows are linked to, then with the others that windows
   which no passage covers yet are linked to.
4. Windows that are still not covered were linked to a document that shares something else, such as a frequent line. They
   meet again by sharper signatures, the minima of two functions over one subsequence, and are linked to the smallest
   and to the preceding document there. Where one function more than before agrees, these are aligned as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pointlake.llm.bytetext import mix, shingles, words
from pointlake.llm.common import batches, column, discard, input_bytes, materialise, rows_of, text_blocks, tidy, tune
from pointlake.llm.member_filter import MemberFilter

SHINGLE = 5
#: Shortest passage, in words, and least Jaccard similarity of its tokens.
MIN_WORDS, SIMILARITY = 50, 0.8
#: Hash functions, and how many must agree on a common subsequence.
FUNCTIONS, ENOUGH = 8, 3
#: Holders of a minimum that a task sends on; it links what it has beyond them among itself.
HELD = 64
#: Windows that a task packs together, and bytes of input for each bucket of minima.
PACKED, BUCKET_BYTES = 1 << 19, 4 << 20
#: Buckets where the input's size isn't known.
UNKNOWN_BUCKETS = 1 << 10
#: About how many windows of a bucket are sorted at once.
PORTION = 1 << 16
#: A window's reach to either side is kept up to so many tokens.
REACH = 255
#: Stands for no document.
_NONE = int(np.iinfo(np.int64).min)
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def compact_windows(value: np.ndarray, begin: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of the compact windows of width >= least, by ascending c. value: hashes of tokens, documents one after
    the other; begin: the first token of each document and the number of all.

    Values are compared by their upper 40 bits (fewer from 2**24 tokens on, as a place takes the rest) and then by
    place, so the leftmost of equal ones is the minimum. A
    centre is the minimum of some run of `least` tokens, and the nearest smaller token on either side of it is one too
    (its run reaches over the whole window). So the tree is needed over centres alone; parents are found by following
    pointers from centre to centre."""
    n = len(value)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    position = np.uint64((1 << max(24, n.bit_length())) - 1)
    order = (value & ~position) | np.arange(n, dtype=np.uint64)
    low, width = order, 1
    while 2 * width <= least:
        low, width = np.minimum(low[: len(low) - width], low[width:]), 2 * width
    if width < least:
        low = np.minimum(low[: len(low) - (least - width)], low[least - width :])
    inside = np.ones(n - least + 1, bool)
    for b in begin[1:-1]:  # runs over a document's border
        inside[max(0, b - least + 1) : b] = False
    at = (low[inside] & position).astype(np.int64)
    mark = np.zeros(n, bool)
    mark[at] = True
    c = np.flatnonzero(mark)
    doc = np.searchsorted(begin, c, "right") - 1
    v, m = order[c], len(c)
    before, after = np.arange(-1, m - 1), np.arange(1, m + 1)
    before[(before >= 0) & (doc[before] != doc)] = -1
    after[(after < m) & (doc[np.minimum(after, m - 1)] != doc)] = m
    for pointer, end in ((before, -1), (after, m)):
        on = np.arange(m)
        while len(on := on[pointer[on] != end]) and len(on := on[v[pointer[on]] > v[on]]):
            pointer[on] = pointer[pointer[on]]
    l = np.where(before >= 0, c[before] + 1, begin[doc])  # noqa: E741
    r = np.where(after < m, c[np.minimum(after, m - 1)], begin[doc + 1]) - 1
    return c, l, r


def common_run(least: int, similarity: float) -> int:
    """Tokens that a passage of `least` or more has at least in one unbroken stretch.

    Where stretches are broken, one text or the other lacks at least 2 * SHINGLE - 1 tokens together and each lacks
    SHINGLE - 1 (unless the words there repeat themselves). With e breaks, the m common tokens are so at least
    e * (2 * SHINGLE - 1) * s / (1 - s) and s * (least + e * (SHINGLE - 1)), in e + 1 stretches."""
    if similarity >= 1:
        return least
    lost = (2 * SHINGLE - 1) * similarity / (1 - similarity)
    most = [max(e * lost, similarity * (least + e * (SHINGLE - 1))) / (e + 1) for e in range(1, 64)]
    return max(1, min(least, *(int(np.ceil(x - 1e-9)) for x in most)))


def function_values(token: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function of tokens: a bijection."""
    return (token ^ (token >> np.uint64(29))) * _FACTORS[k]


def packed_place(c: np.ndarray, k: int | np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A centre, function and reach in one whole number, in the order of centres."""
    return c << 24 | np.asarray(k, np.int64) << 16 | np.minimum(left, REACH) << 8 | np.minimum(right, REACH)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(c, function, l, r) of packed places."""
    c = place >> 24
    return c, place >> 16 & 255, c - (place >> 8 & 255), c + (place & 255)


def _ends_of_repeats(value: np.ndarray, row: np.ndarray, c: np.ndarray, near: int) -> np.ndarray:
    """Which windows to keep of those whose minimum is repeated in its document at distances of at most `near`, as in
    lines that follow one another: the first and the last of such a series, which stand for what is between them."""
    order = np.lexsort((c, value, row))
    same = (value[order[1:]] == value[order[:-1]]) & (row[order[1:]] == row[order[:-1]]) & (np.diff(c[order]) <= near)
    keep = np.ones(len(c), bool)
    keep[order[1:-1][same[1:] & same[:-1]]] = False
    return keep


def block_windows(token: np.ndarray, number: np.ndarray, least: int, functions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, place) of the windows of documents that lie one after the other, `number` tokens each."""
    begin = np.concatenate([[0], np.cumsum(number)])
    keys, rows, places = [], [], []
    for k in range(functions):
        value = function_values(token, k)
        c, l, r = compact_windows(value, begin, least)  # noqa: E741
        row = np.searchsorted(begin, c, "right") - 1
        keep = _ends_of_repeats(value[c], row, c, least // 2)
        c, l, r, row = c[keep], l[keep], r[keep], row[keep]  # noqa: E741
        keys.append(mix(value[c] + np.uint64(k)))
        rows.append(row)
        places.append(packed_place(c - begin[row], k, c - l, r - c))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(places)


def _encoded(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> bytes:
    """Windows as compressed bytes; keys ascend. Bytes of equal weight lie together, as most are alike."""
    lanes = [np.diff(key, prepend=np.uint64(0)), doc.view(np.uint64), place.view(np.uint64)]
    raw = np.concatenate([np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.ravel() for x in lanes])
    return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _decoded(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, n * 24, codec="zstd", asbytes=True), np.uint8).reshape(3, 8, n)
    key, doc, place = (np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in raw)
    return np.cumsum(key, dtype=np.uint64), doc.view(np.int64), place.view(np.int64)


class _Packer:
    """A task's windows. Documents with equal words are one, that with the smallest id."""

    def __init__(self, buckets: int):
        self.shift = np.uint64(64 - (buckets.bit_length() - 1))
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple[int, int], int] = {}
        self.ids: list[int] = []
        self.text_keys: list[int] = []
        self.copies: list[tuple[int, int, int, int]] = []
        self.windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: list[int], text_keys: list[int], signs: list[tuple[int, int]], key: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
        number = np.full(len(ids), -1)
        for i, (doc, text_key, sign) in enumerate(zip(ids, text_keys, signs, strict=True)):
            at = self.known.get(sign)
            if at is None:
                at = self.known[sign] = number[i] = len(self.ids)
                self.ids.append(doc)
                self.text_keys.append(text_key)
            elif doc > self.ids[at]:
                self.copies.append((doc, text_key, sign[1], at))
            elif doc < self.ids[at]:
                self.copies.append((self.ids[at], self.text_keys[at], sign[1], at))
                self.ids[at], self.text_keys[at] = doc, text_key
        of = number[row]
        keep = of >= 0
        self.windows.append((key[keep], of[keep], place[keep]))
        self.held += int(keep.sum())

    def flush(self) -> Iterator[dict]:
        """Rows (bucket, kind, n, data): windows by bucket; links within this task; copies."""
        ids = np.array(self.ids, np.int64)
        if self.copies:
            doc, text_key, n, at = np.array(self.copies, np.int64).T
            yield from self._row(int(doc[0]), 2, np.stack([doc, text_key, n, ids[at]]))
        if self.held:
            key, of, place = (np.concatenate(x) for x in zip(*self.windows, strict=True))
            self.windows.clear()
            doc = ids[of]
            order = np.lexsort((place, doc, key))
            key, doc, place = key[order], doc[order], place[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
            if (over := rank >= HELD).any():
                own = np.flatnonzero(over)
                head = own - rank[own]
                for other in (head, own - 1):
                    far = doc[other] < doc[own]
                    if far.any():
                        a, b = own[far], other[far]
                        yield from self._row(int(doc[a[0]]), 1, np.stack([key[a].view(np.int64), doc[a], place[a], doc[b], place[b]]))
                key, doc, place = key[~over], doc[~over], place[~over]
            bucket = (key >> self.shift).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket)) + 1
            for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                for a in range(low, high, 1 << 14):
                    b = min(high, a + (1 << 14))
                    yield {"bucket": int(bucket[a]), "kind": 0, "n": b - a, "data": _encoded(key[a:b], doc[a:b], place[a:b])}
        self.clear()

    def _row(self, seed: int, kind: int, values: np.ndarray) -> Iterator[dict]:
        bucket = int(mix(np.array([seed], np.int64).view(np.uint64))[0] >> self.shift)
        for a in range(0, values.shape[1], 1 << 14):
            part = np.ascontiguousarray(values[:, a : a + (1 << 14)])
            yield {"bucket": bucket, "kind": kind, "n": part.shape[1], "data": part.tobytes()}


def packed_windows(docs: DataFrame, buckets: int, min_words: int = MIN_WORDS, functions: int = FUNCTIONS) -> DataFrame:
    """Rows (bucket, kind, n, data) of docs (doc_id, text_key, text), as _Packer has them. buckets: a power of two."""
    least = min_words - SHINGLE + 1
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("n", pa.int32()), ("data", pa.binary())])

    def rows(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for x in found:
            yield batches({k: [v] for k, v in x.items()}, schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets)
        for b in rows_of(it):
            ids, text_keys = column(b, "doc_id").to_numpy(), column(b, "text_key").to_numpy()
            for first, _, data, offsets in text_blocks(column(b, "text")):
                w = words(data, offsets)
                long = np.flatnonzero(w.count >= min_words)
                if not len(long):
                    continue
                begin = np.cumsum(w.count) - w.count
                within = (np.arange(len(w.hash)) - begin[w.doc]).astype(np.uint64)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash + within * _FACTORS[63]), dtype=np.uint64)])
                sign = (total[begin + w.count] - total[begin])[long].tolist()
                token, _, number = shingles(w, SHINGLE)
                number = np.where(w.count >= min_words, number, 0)
                token = token[np.repeat(w.count >= min_words, np.where(w.count >= SHINGLE, w.count - SHINGLE + 1, w.count > 0))]
                key, row, place = block_windows(token, number[long], least, functions)
                packer.add(ids[first + long].tolist(), text_keys[first + long].tolist(), list(zip(sign, w.count[long].tolist(), strict=True)), key, row, place)
                if packer.held >= PACKED:
                    yield from rows(packer.flush())
        yield from rows(packer.flush())
        tidy()

    return docs.mapInArrow(run, "bucket int, kind byte, n int, data binary")


def meetings(packed: DataFrame) -> DataFrame:
    """Windows whose minimum several documents have: key, doc_id, place, other_id, other_place (of the smallest
    document; null in its own rows), many (more than two documents have it). Copies have a null key, their text's key as
    place, and other_place words."""
    schema = pa.schema([*[(k, pa.int64()) for k in ("key", "doc_id", "place", "other_id", "other_place")], ("many", pa.bool_())])

    def portions(parts: list) -> Iterator[list]:
        """A bucket's windows by ranges of keys, which ascend in each part: the same key is in one portion only."""
        number = -(-sum(len(x[0]) for x in parts) // PORTION)
        low, high = min(int(x[0][0]) for x in parts), max(int(x[0][-1]) for x in parts)
        border = np.array([low + (high - low) * k // number for k in range(1, number)], np.uint64)
        cuts = [[0, *np.searchsorted(x[0], border).tolist(), len(x[0])] for x in parts]
        for k in range(number):
            if got := [tuple(y[c[k] : c[k + 1]] for y in x) for x, c in zip(parts, cuts, strict=True) if c[k] < c[k + 1]]:
                yield got

    def together(parts: list) -> pa.RecordBatch | None:
        key, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, doc, key))
        key, doc, place = key[order], doc[order], place[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        several = np.repeat(doc[start] < doc[start + size - 1], size)
        if not several.any():
            return None
        head = np.repeat(start, size)
        # A document that has the minimum at several places: the first of them goes with the other's first, and so on.
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        run = np.diff(np.append(np.flatnonzero(fresh), len(key)))
        heads = run[np.searchsorted(np.flatnonzero(fresh), head)]
        other = head + np.minimum(np.arange(len(key)) - first, heads - 1)
        own = np.flatnonzero(several)
        least = doc[own] == doc[head[own]]
        many = np.repeat(np.add.reduceat(fresh.astype(np.int64), start) > 2, size)[own]
        return batches({"key": key[own].view(np.int64), "doc_id": doc[own], "place": place[own], "other_id": pa.array(doc[other[own]], mask=least), "other_place": pa.array(place[other[own]], mask=least), "many": many}, schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for b in rows_of(it):
            each = zip(*(column(b, k).to_pylist() for k in ("bucket", "kind", "n", "data")), strict=True)
            for now, kind, n, data in each:
                if now != bucket and parts:
                    yield from (out for x in portions(parts) if (out := together(x)) is not None)
                    parts = []
                bucket = now
                if kind == 0:
                    parts.append(_decoded(data, n))
                    continue
                x = np.frombuffer(data, np.int64).reshape(-1, n)
                if kind == 1:
                    yield batches({**dict(zip(schema.names, x, strict=False)), "many": np.ones(n, bool)}, schema)
                else:
                    yield batches({"key": pa.nulls(n, pa.int64()), "doc_id": x[0], "place": x[1], "other_id": x[3], "other_place": x[2], "many": np.zeros(n, bool)}, schema)
        if parts:
            yield from (out for x in portions(parts) if (out := together(x)) is not None)
        tidy()

    number = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(number, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, doc_id long, place long, other_id long, other_place long, many boolean")


def _joint(place: np.ndarray, group: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Portions (i, j), i before j, of windows of two functions in one group that have a common subsequence of `least`
    tokens or more. place: ascending in each group, groups one after the other."""
    c, k, l, r = unpacked(place)  # noqa: E741
    wide = np.int64(1 << 34)
    ahead = np.searchsorted(group * wide + c, group * wide + r, "right") - np.arange(len(c)) - 1
    total, row = np.cumsum(ahead), 0
    while row < len(c):
        base = int(total[row - 1]) if row else 0
        end = max(row + 1, int(np.searchsorted(total, base + (1 << 18), "right")))
        n = ahead[row:end]
        i = np.repeat(np.arange(row, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        keep = (k[i] != k[j]) & (l[j] <= c[i]) & (np.minimum(r[i], r[j]) - np.maximum(l[i], l[j]) + 1 >= least)
        yield i[keep], j[keep]
        row = end


def agreeing(place: np.ndarray, other: np.ndarray, group: np.ndarray, least: int, enough: int) -> np.ndarray:
    """The interval join: which links have `enough` functions in all that agree on a common subsequence on both sides.
    place, other: windows of links; group: ascending numbers, one for each pair of documents."""
    _, k, _, _ = unpacked(place)
    oc, _, ol, orr = unpacked(other)
    mask = np.uint64(1) << k.astype(np.uint64)
    own = mask.copy()
    for i, j in _joint(place, group, least):
        low, high = np.maximum(ol[i], ol[j]), np.minimum(orr[i], orr[j])
        same = (low <= np.minimum(oc[i], oc[j])) & (high >= np.maximum(oc[i], oc[j])) & (high - low + 1 >= least)
        np.bitwise_or.at(mask, i[same], own[j[same]])
        np.bitwise_or.at(mask, j[same], own[i[same]])
    return np.bitwise_count(mask) >= enough


def _whole_groups(it: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of sorted batches, cut only where the first two of them (or the one there is to compare) change."""
    held: dict[str, np.ndarray] = {}
    for b in it:
        if not b.num_rows:
            continue
        now = {k: column(b, k).to_numpy(zero_copy_only=False) for k in names}
        held = {k: np.concatenate([held[k], v]) for k, v in now.items()} if held else now
        if len(held[names[0]]) < 1 << 16:
            continue
        last = np.flatnonzero((held[names[0]] != held[names[0]][-1]) | (held[names[1]] != held[names[1]][-1]))
        if len(last):
            cut = int(last[-1]) + 1
            yield {k: v[:cut] for k, v in held.items()}
            held = {k: v[cut:] for k, v in held.items()}
    if held:
        yield held


def candidates(links: DataFrame, min_words: int = MIN_WORDS, enough: int = ENOUGH) -> DataFrame:
    """Pairs (doc_id, other_id, n) with n links that `enough` functions agree on. Links with place2 and other_place2
    stand for two windows each; of those, equal ones count once."""
    paired = "place2" in links.columns
    names = ["doc_id", "other_id", "place", "other_place", *(["place2", "other_place2"] if paired else [])]
    least, schema = min_words - SHINGLE + 1, pa.schema([("doc_id", pa.int64()), ("other_id", pa.int64()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_groups(it, names):
            fresh = np.concatenate([[True], (x["doc_id"][1:] != x["doc_id"][:-1]) | (x["other_id"][1:] != x["other_id"][:-1])])
            group, place, other = np.cumsum(fresh) - 1, x["place"], x["other_place"]
            if paired:
                links_ = np.stack([np.tile(group, 2), np.concatenate([place, x["place2"]]), np.concatenate([other, x["other_place2"]])])
                links_ = links_[:, np.lexsort(links_[::-1])]
                group, place, other = links_[:, np.concatenate([[True], (links_[:, 1:] != links_[:, :-1]).any(axis=0)])]
            found, n = np.unique(group[agreeing(place, other, group, least, enough)], return_counts=True)
            at = np.flatnonzero(fresh)[found]
            yield batches({"doc_id": x["doc_id"][at], "other_id": x["other_id"][at], "n": n}, schema)
        tidy()

    order = ["doc_id", "other_id"] if paired else ["doc_id", "other_id", "place"]
    return links.select(*names).repartition("doc_id", "other_id").sortWithinPartitions(*order).mapInArrow(run, "doc_id long, other_id long, n long")


def sharper(windows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Signatures of two functions: (sign, doc_id, place, place2, open, done) of windows (key, doc_id, place, other_id,
    open), for every two windows of a document with a common subsequence; open where both of them are, done: the
    document that both are linked to already, if it is one."""
    least = min_words - SHINGLE + 1
    schema = pa.schema([("sign", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("place2", pa.int64()), ("open", pa.bool_()), ("done", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_groups(it, ["doc_id", "doc_id", "place", "key", "open", "other_id"]):
            group = np.cumsum(np.concatenate([[False], x["doc_id"][1:] != x["doc_id"][:-1]]))
            key, place = x["key"].view(np.uint64), x["place"]
            k = unpacked(place)[1]
            for i, j in _joint(place, group, least):
                low, high = np.where(k[i] < k[j], i, j), np.where(k[i] < k[j], j, i)
                sign = mix(key[low] + mix(key[high])).view(np.int64)
                yield batches({"sign": sign, "doc_id": x["doc_id"][i], "place": place[low], "place2": place[high], "open": x["open"][i] & x["open"][j], "done": np.where(x["other_id"][i] == x["other_id"][j], x["other_id"][i], _NONE)}, schema)
        tidy()

    return windows.repartition("doc_id").sortWithinPartitions("doc_id", "place").mapInArrow(run, "sign long, doc_id long, place long, place2 long, open boolean, done long")


def sharper_links(signs: DataFrame) -> DataFrame:
    """(doc_id, other_id, place, place2, other_place, other_place2): the two windows of documents with an open signature,
    with those of the smallest and of the preceding document that has it. A signature whose rows reach over several tasks starts anew in
    each of them, beginning with its smallest."""
    names = ("doc_id", "other_id", "place", "place2", "other_place", "other_place2")
    schema = pa.schema([(k, pa.int64()) for k in names])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, first, last = None, None, None
        for b in rows_of(it):
            s, d, p, q, o, done = (column(b, k).to_numpy(zero_copy_only=False) for k in ("sign", "doc_id", "place", "place2", "open", "done"))
            rows = np.stack([d, p, q, done])
            if sign is not None:  # the smallest and the last row of the batch before go ahead
                s, o = np.concatenate([[sign, sign], s]), np.concatenate([[False, False], o])
                rows = np.concatenate([first[:, None], last[:, None], rows], axis=1)
            fresh = np.concatenate([[True], s[1:] != s[:-1]])
            at = np.arange(len(s))
            head = np.maximum.accumulate(np.where(fresh, at, 0))
            before = np.maximum(at - 1, 0)
            for other, able in ((head, o), (before, o & (before != head))):
                keep = np.flatnonzero(able & (s[other] == s) & (rows[0, other] < rows[0]) & (rows[0, other] != rows[3]))
                far = other[keep]
                yield batches(dict(zip(names, (rows[0, keep], rows[0, far], rows[1, keep], rows[2, keep], rows[1, far], rows[2, far]), strict=True)), schema)
            sign, first, last = s[-1], rows[:, head[-1]], rows[:, -1]

    return signs.repartitionByRange("sign", "doc_id").sortWithinPartitions("sign", "doc_id").mapInArrow(run, ", ".join(f"{k} long" for k in names))


def passages(match: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, float]]:
    """(start, length, start in the other, similarity) of passages in tokens. match: for each token of a document its
    place in the other or -1.

    Stretches that match token by token are put together from left to right while the tokens between the first and
    the last are alike enough; what is too short or not alike is left out."""
    at = np.flatnonzero(match >= 0)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(match[at]) != 1))
    first, last = at[np.concatenate([[0], cut + 1])], at[np.append(cut, len(at) - 1)]
    out, now = [], None

    def close() -> None:
        a, b, qa, qb, m = now
        same = m / ((b - a + 1) + (qb - qa + 1) - m)
        if b - a + 1 >= least and qb - qa + 1 >= similarity * least and same >= similarity:
            out.append((a, b - a + 1, qa, same))

    for a, b, qa, qb in zip(first.tolist(), last.tolist(), match[first].tolist(), match[last].tolist(), strict=True):
        if now is not None:
            m = now[4] + b - a + 1
            wide = max(qb, now[3]) - min(qa, now[2]) + 1
            if qa > now[3] and m >= similarity * ((b - now[0] + 1) + wide - m):
                now = (now[0], b, now[2], qb, m)
                continue
            # A stretch that is too short to matter may be a phrase by chance: leave it out rather than end here.
            if b - a + 1 < SHINGLE and now[1] - now[0] + 1 > b - a + 1:
                continue
            close()
        now = (a, b, qa, qb, b - a + 1)
    close()
    return out


def _runs(token: np.ndarray, run: int) -> np.ndarray:
    """Hashes of all runs of `run` tokens."""
    n = max(0, len(token) - run + 1)
    out = np.zeros(n, np.uint64)
    for k in sorted({*range(0, run, SHINGLE), run - 1}):  # the words of these tokens are all words of the run
        out = out * _FACTORS[1] + token[k : k + n]
    return out


def _seeds(own: np.ndarray, other: np.ndarray, run: int) -> np.ndarray:
    """Rows (i, j, n): where stretches of n >= `run` equal tokens, as long as they can be, begin in both; by i."""
    a, b = _runs(own, run), _runs(other, run)
    order = np.argsort(b, kind="stable")
    b = b[order]
    low = np.searchsorted(b, a)
    number = np.searchsorted(b, a, "right") - low
    if not number.any():
        return np.zeros((0, 3), np.int64)
    first, last, total, row = [], [], np.cumsum(number), 0
    while row < len(a):
        base = int(total[row - 1]) if row else 0
        end = max(row + 1, int(np.searchsorted(total, base + (1 << 20), "right")))
        n = number[row:end]
        i = np.repeat(np.arange(row, end), n)
        j = order[np.repeat(low[row:end], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        starts = (i == 0) | (j == 0) | (own[i - 1] != other[j - 1])
        ends = (i == len(a) - 1) | (j == len(b) - 1) | (own[np.minimum(i + run, len(own) - 1)] != other[np.minimum(j + run, len(other) - 1)])
        first.append(np.column_stack([i[starts], j[starts]]))
        last.append(np.column_stack([i[ends], j[ends]]))
        row = end
    p, q = np.concatenate(first), np.concatenate(last)
    p, q = (x[np.lexsort((x[:, 0], x[:, 1] - x[:, 0]))] for x in (p, q))
    out = np.column_stack([p, q[:, 0] - p[:, 0] + run])
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _nearest(own: np.ndarray, other: np.ndarray, shift: int) -> np.ndarray:
    """For each token of own, at k, the place in other that has it and is nearest to k + shift, or -1."""
    order = np.argsort(other, kind="stable")
    value, m = other[order], len(other)
    key = np.searchsorted(value, value) * m + order
    first = np.searchsorted(value, own)
    known = value[np.minimum(first, m - 1)] == own
    want = np.clip(np.arange(len(own)) + shift, 0, m - 1)
    at = np.searchsorted(key, first * m + want)
    after, before = key[np.minimum(at, m - 1)], key[np.maximum(at - 1, 0)]
    has_after, has_before = (at < m) & (after // m == first), (at > 0) & (before // m == first)
    after, before = after % m, before % m
    near = np.where(has_after & ~(has_before & (want - before < after - want)), after, before)
    return np.where(known & (has_after | has_before), near, -1)


def aligned(own: np.ndarray, other: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, float]]:
    """passages() of two documents' tokens, which cover all that a passage covers in own.

    Each stretch of equal tokens is a seed with a place in both; the tokens around it are matched with their occurrence
    nearest to that place, so what the texts repeat elsewhere doesn't matter. Seeds in what is covered add nothing, nor
    do short ones beside another of nearly the same shift, which are in texts that are repeats for the most part."""
    if len(own) < least:
        return []
    # Of a passage's tokens similarity * least or more are common, so some stretch of `least` tokens has four fifths of that.
    value = np.sort(other)
    known = value[np.minimum(np.searchsorted(value, own), len(value) - 1)] == own if len(value) else np.zeros(len(own), bool)
    has = np.concatenate([[0], np.cumsum(known)])
    if (has[least:] - has[:-least]).max() < 0.8 * similarity * least:
        return []
    seeds = _seeds(own, other, common_run(least, similarity))
    # Seeds that are passages by themselves: few that cover the same, by taking the one that reaches furthest.
    queue, best, reach = [], None, -1
    for i, j, n in seeds[seeds[:, 2] >= least].tolist():
        if best is not None and i > reach:
            queue.append(best)
            reach, best = best[0] + best[2], None
        if i + n > reach and (best is None or i + n > best[0] + best[2]):
            best = i, j, n
    queue += [best] if best else []
    # The others need similarity * least tokens around them that the other text has at all.
    short = seeds[seeds[:, 2] < least]
    if len(short):
        enough = has[np.minimum(short[:, 0] + short[:, 2] + least, len(own))] - has[np.maximum(short[:, 0] - least, 0)] >= similarity * least
        queue += map(tuple, short[enough].tolist())
    if not queue:
        return []
    if min(q[2] for q in queue) < similarity * least:  # else the seeds are enough by themselves
        kinds, number = np.unique(np.concatenate([own, other]), return_inverse=True)
        mark, own_kind, other_kind = np.zeros(len(kinds), bool), number[: len(own)], number[len(own) :]
    out: list[tuple[int, int, int, float]] = []
    covered, failed = np.zeros(len(own), bool), set()
    begin, shift = np.array([q[0] for q in queue]), np.array([q[1] - q[0] for q in queue])
    settled = np.zeros(len(queue), bool)
    for at, (i, j, n) in enumerate(queue):
        if settled[at] or covered[i : i + n].all():
            continue
        wide = max(least, n)
        while True:
            low, high = max(0, i - wide), min(len(own), i + n + wide)
            other_low, other_high = max(0, j - wide * 3 // 2), min(len(other), j + n + wide * 3 // 2)
            part, around = own[low:high], other[other_low:other_high]
            seen = part.tobytes(), around.tobytes(), i - low, j - other_low
            if seen in failed:
                break
            able = n >= similarity * least
            if not able:
                mark[other_kind[other_low:other_high]] = True
                able = np.count_nonzero(mark[own_kind[low:high]]) >= similarity * least
                mark[other_kind[other_low:other_high]] = False
            tried = passages(_nearest(part, around, j - other_low - (i - low)), least, similarity) if able else []
            got = [(s + low, length, at + other_low, same) for s, length, at, same in tried if s + low < i + n and i < s + low + length]
            if not got:
                failed.add(seen)
            if all((s > low or not low) and (s + length < high or high == len(own)) for s, length, _, _ in got):
                if n < least:  # what has the nearly same shift there has been compared as well
                    settled |= (begin >= i) & (begin <= i + n) & (np.abs(shift - (j - i)) <= 2 * SHINGLE)
                for s, length, _, _ in got:
                    covered[s : s + length] = True
                out += [g for g in got if g not in out]
                break
            wide *= 2
    return out


def verified(pairs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """pairs: doc_id, text_key, text, other_id, other_text. Rows of spans(), below."""
    least = min_words - SHINGLE + 1
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("first_doc_id", pa.int64()), ("first_start_word", pa.int64()), ("similarity", pa.float64())])

    def tokens(text: pa.Array) -> list[np.ndarray]:
        """The tokens of each text; equal texts' are made once."""
        kinds = text.dictionary_encode()
        out: list[np.ndarray] = []
        for _, _, data, offsets in text_blocks(kinds.dictionary):
            v, _, n = shingles(words(data, offsets), SHINGLE)
            out += np.split(v, np.cumsum(n)[:-1])
        return [out[k] for k in kinds.indices.to_pylist()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows_of(it):
            for low in range(0, whole.num_rows, 256):
                b = whole.slice(low, 256)
                out: dict[str, list] = {f.name: [] for f in schema}
                each = zip(column(b, "doc_id").to_pylist(), column(b, "text_key").to_pylist(), column(b, "other_id").to_pylist(), tokens(column(b, "text")), tokens(column(b, "other_text")), strict=True)
                for doc, text_key, first, own, other in each:
                    for start, length, at, same in aligned(own, other, least, similarity):
                        for name, x in zip(out, (doc, text_key, start, length + SHINGLE - 1, first, at, same), strict=True):
                            out[name].append(x)
                yield batches(out, schema)
        tidy()

    kinds = "doc_id long, text_key long, start_word long, n_words long, first_doc_id long, first_start_word long, similarity double"
    return pairs.select("doc_id", "text_key", "text", "other_id", "other_text").mapInArrow(run, kinds)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, functions: int = FUNCTIONS, enough: int = ENOUGH) -> DataFrame:
    """Passages that a document with a smaller id has as well: doc_id, text_key (xxhash64 of the text), start_word,
    n_words, first_doc_id, first_start_word, similarity (Jaccard, of five-word tokens).

    A passage has at least min_words words in both. Words are as in bytetext; passages repeated within one document
    don't count, nor do rows without an id; null and empty texts have no passages. Rows with equal ids are one document
    of several texts; equal rows count once. Documents without such passages, and empty tables, have no rows. A span
    that lies within another one of the text is left out; of equal spans the one with the smallest first_doc_id stays.

    first_doc_id is the smallest document that the span was compared with: the smallest of all that share a minimum,
    unless one task meets more than HELD of these. Such a task links what it has beyond them to its own smallest and to
    the preceding one, so a hot minimum sends on HELD rows a task; and of documents with equal words only the smallest
    one of a task takes part, the others being spans as a whole."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    size = input_bytes(docs)
    buckets = 1 << max(1, min(24, (size // BUCKET_BYTES).bit_length())) if size < 1 << 50 else UNKNOWN_BUCKETS
    met, met_path = materialise(meetings(packed_windows(rows, buckets, min_words, functions)), "meetings")
    repeated, repeated_path = materialise(rows.groupBy("doc_id", "text_key").count().where("count > 1"), "repeated")
    if not repeated.isEmpty():  # else a row is paired as often as it is there
        again = MemberFilter.build(repeated.select("doc_id"), "doc_id").perhaps(F.col("doc_id"))
        rows = rows.withColumn("again", again)
        rows = rows.where("not again").unionByName(rows.where("again").dropDuplicates(["doc_id", "text_key"])).drop("again")
    paths = [repeated_path]

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = materialise(df, name)
        paths.append(path)
        return out

    copies, met = kept(met.where("key is null"), "copies"), met.where("key is not null")

    def check(pairs: DataFrame, name: str) -> DataFrame:
        own, other = (MemberFilter.build(pairs.select(k), k).perhaps(F.col("doc_id")) for k in ("doc_id", "other_id"))
        others = rows.where(other).select(F.col("doc_id").alias("other_id"), F.col("text").alias("other_text"))
        # Pairs grow with the table, so they are merged at every size rather than broadcast while they are few.
        both = pairs.select("doc_id", "other_id").join(rows.where(own).hint("merge"), "doc_id").join(others.hint("merge"), "other_id")
        return kept(verified(both, min_words, similarity), name)

    def still_open(windows: DataFrame, found: DataFrame) -> DataFrame:
        """windows with `open`: whether they are linked and no passage covers their centre."""
        cover = found.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "n_words")).alias("cover"))
        at = F.shiftright("place", 24)
        covered = F.exists("cover", lambda p: (p.start_word <= at) & (at + SHINGLE <= p.start_word + p.n_words))
        return windows.join(cover.hint("merge"), "doc_id", "left").withColumn("open", F.col("other_id").isNotNull() & ~F.coalesce(covered, F.lit(False))).drop("cover")

    # First with the document that most windows are linked to, as what it covers needn't be compared with others.
    every = kept(candidates(met.where("other_id is not null"), min_words, enough), "pairs")
    best = kept(every.groupBy("doc_id").agg(F.max_by("other_id", F.struct("n", -F.col("other_id"))).alias("other_id")), "best")
    found = check(best, "passages")
    state, state_path = materialise(still_open(met, found), "state")
    discard(spark, met_path)
    second = kept(candidates(state.where("open"), min_words, enough).join(best, ["doc_id", "other_id"], "left_anti"), "second")
    found = found.unionByName(check(second, "passages"))

    # Of a minimum that two documents have, these have been compared.
    state = state.where("many")
    pool = state.join(state.where("open").select("key").distinct().hint("merge"), "key", "left_semi").select("key", "doc_id", "place", F.coalesce("other_id", F.lit(_NONE)).alias("other_id"), "open")
    signs, signs_path = materialise(sharper(pool, min_words), "signs")
    discard(spark, state_path)
    third = candidates(sharper_links(signs), min_words, min(functions, enough + 1))
    third = kept(third.join(best.unionByName(second.select(*best.columns)), ["doc_id", "other_id"], "left_anti"), "third")
    discard(spark, signs_path)
    found = found.unionByName(check(third, "passages"))

    kinds = found.schema
    whole = copies.select("doc_id", F.col("place").alias("text_key"), F.lit(0).cast("long").alias("start_word"), F.col("other_place").alias("n_words"), F.col("other_id").alias("first_doc_id"), F.lit(0).cast("long").alias("first_start_word"), F.lit(1.0).alias("similarity"))
    # A copy's original may be a copy of a document of another task, or be found in one as a whole.
    full = found.where("start_word = 0").groupBy(F.col("doc_id").alias("first_doc_id"), F.col("n_words")).agg(F.min_by(F.struct("first_doc_id", "first_start_word", "similarity"), "first_doc_id").alias("__at"))
    whole = whole.join(full, ["first_doc_id", "n_words"], "left").select(
        "doc_id", "text_key", "start_word", "n_words", *[F.coalesce(F.col(f"__at.{k}"), F.col(k)).alias(k) for k in ("first_doc_id", "first_start_word", "similarity")]
    )
    out, _ = materialise(outermost(found.unionByName(whole.select(*kinds.names))), "spans")
    for path in paths:
        discard(spark, path)
    return out


def outermost(found: DataFrame) -> DataFrame:
    """Rows of spans() without those inside another span of their text."""
    names = found.columns
    rest = [k for k in names if k not in ("doc_id", "text_key")]
    lists = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*rest)).alias("s"))

    @arrow_udf("array<int>")
    def outer(lists: pa.Array) -> pa.Array:
        out = []
        for spans_ in lists.to_pylist():
            order = sorted(range(len(spans_)), key=lambda i: (spans_[i]["start_word"], -spans_[i]["n_words"], spans_[i]["first_doc_id"], spans_[i]["first_start_word"]))
            keep, reach = [], -1
            for i in order:
                end = spans_[i]["start_word"] + spans_[i]["n_words"]
                if end > reach:
                    keep.append(i)
                    reach = end
            out.append(keep)
        return pa.array(out, pa.list_(pa.int32()))

    # Nondeterministic: else Spark puts a filter with a second call before explode, which takes a second worker.
    kept = lists.withColumn("i", outer.asNondeterministic()("s")).select("doc_id", "text_key", F.explode("i").alias("i"), "s").select("doc_id", "text_key", F.element_at("s", F.col("i") + 1).alias("s"))
    return kept.select("doc_id", "text_key", "s.*").select(*names)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the passages of spans() cut from their texts, so that each stays in the document with the smallest id;
    count_col, if docs has it, is the new number of code points of a text that was cut. No row is dropped; a text that
    is nothing but repeats becomes empty or white space. Null texts, rows without an id and empty tables stay as they
    are, repeated rows are cut alike, and the names of other columns don't matter."""
    found, _ = materialise(spans(docs, id_col, text_col, min_words, similarity).select("doc_id", "text_key", F.struct("start_word", "n_words").alias("s")).distinct(), "repeats")
    perhaps = MemberFilter.build(found.select("doc_id"), "doc_id").perhaps(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)))
    marked = docs.select(F.struct(*docs.columns).alias("row"), perhaps.alias("perhaps"))
    text = F.col("row").getField(text_col)
    some = marked.where("perhaps").select("row", F.col("row").getField(id_col).cast("long").alias("id"), F.xxhash64(text.cast("string")).alias("key"))
    lists = found.groupBy("doc_id", "text_key").agg(F.collect_list("s").alias("spans")).withColumnsRenamed({"doc_id": "id", "text_key": "key"})

    @arrow_udf("string")
    def cut(text: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for value, spans_ in zip(text.to_pylist(), lists.to_pylist(), strict=True):
            data = np.frombuffer(value.encode(), np.uint8)
            w = words(data, np.array([0, len(data)]), hashed=False)
            keep = np.ones(len(data), bool)
            for s in spans_:
                keep[w.start[s["start_word"]] : w.end[s["start_word"] + s["n_words"] - 1]] = False
            out.append(data[keep].tobytes().decode())
        return pa.array(out, pa.string())

    # Merged at every size: a task that broadcast lists reach would need Python for `perhaps` and for `cut`, so two workers.
    joined = some.join(lists.hint("merge"), ["id", "key"], "left")
    changed = joined.where("spans is not null").select("row", cut(text.cast("string"), F.col("spans")).alias("cut"))
    new = F.col("row").withField(f"`{text_col}`", F.col("cut"))
    if count_col in docs.columns:
        new = new.withField(f"`{count_col}`", F.length("cut").cast(docs.schema[count_col].dataType))
    whole = marked.where("not perhaps").select("row").unionByName(joined.where("spans is null").select("row")).unionByName(changed.select(new.alias("row")))
    return whole.select([F.col("row").getField(k).alias(k) for k in docs.columns])
