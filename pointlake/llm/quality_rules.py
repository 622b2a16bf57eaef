"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow boosted trees on labelled rows give paths; each path is a conjunctive rule over statistics. A lasso logistic
regression weighs the rules, most of them with zero, and what is left is compiled to one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pointlake.llm.bytetext import words
from pointlake.llm.common import batches, column, discard, least_hashed, materialise, rows_of, text_blocks, tidy, tune

#: Labelled rows that the rules are fitted on, at most: those with the least hash of their id.
FIT_ROWS = 8192
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.2
#: Lasso strengths tried, the one with the least deviance on every fifth fitted row is used.
LASSO = (0.01, 0.004, 0.0015, 0.0005)
THRESHOLD = 0.7

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~=+_<>\\{}[]`",
    "sentence": b".,;:?",
    "other_byte": range(128, 256),
    "line": b"\n",
    "slash": b"/",
}
STATISTICS = ["words", "word_bytes", "long_words", "short_words", "distinct", "repeated", "line_words", *[f"{k}_rate" for k in _CLASSES if k != "line"]]

# Two classes a 64-bit lane pair, so that one running sum counts both.
_NAMES = list(_CLASSES)
_LANES = []
for _k in range(0, len(_NAMES), 2):
    _table = np.zeros(256, np.uint64)
    _table[list(_CLASSES[_NAMES[_k]])] += np.uint64(1)
    _table[list(_CLASSES[_NAMES[_k + 1]])] += np.uint64(1 << 32)
    _LANES.append(_table)


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    for k, table in enumerate(_LANES):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data], out=total[1:])
        both = total[offsets[1:]] - total[offsets[:-1]]
        out[_NAMES[2 * k]] = (both & np.uint64(0xFFFFFFFF)).astype(np.float64)
        out[_NAMES[2 * k + 1]] = (both >> np.uint64(32)).astype(np.float64)
    return out


def statistics_arrays(text: pa.Array) -> np.ndarray:
    """float64 of shape (texts, STATISTICS); null counts as empty, and an empty text has zeros."""
    out = [np.zeros((0, len(STATISTICS)))]
    for _, _, data, offsets in text_blocks(text):
        n = len(offsets) - 1
        w = words(data, offsets)
        count = np.maximum(w.count, 1).astype(np.float64)
        size = np.maximum(np.diff(offsets), 1).astype(np.float64)
        length = w.end - w.start
        per_doc = lambda x: np.bincount(w.doc[x], minlength=n) / count  # noqa: B023, E731
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        # Distinct words of a document: sorted by 16 bits of its place in the block and 48 bits of the word's hash.
        key = np.sort((w.doc.astype(np.uint64) << np.uint64(48)) | (w.hash >> np.uint64(16)))
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        d = (key >> np.uint64(48)).astype(np.int64)
        counts = _class_counts(data, offsets)
        out.append(
            np.stack(
                [
                    np.log1p(w.count),
                    np.bincount(w.doc, weights=length, minlength=n) / count,
                    per_doc(length > 12),
                    per_doc(length < 3),
                    np.bincount(d[first], minlength=n) / count,
                    per_doc(same),
                    np.minimum(w.count / (counts["line"] + 1), 1000.0),
                    *[counts[k] / size for k in _CLASSES if k != "line"],
                ],
                axis=1,
            )
        )
    return np.concatenate(out)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns STATISTICS, a row for every row of docs."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *[(k, pa.float64()) for k in STATISTICS]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(it):
            values = statistics_arrays(column(b, "text"))
            yield batches({"doc_id": column(b, "doc_id"), **{k: values[:, j] for j, k in enumerate(STATISTICS)}}, schema)
        tidy()

    kinds = ", ".join(["doc_id long", *[f"{k} double" for k in STATISTICS]])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kinds)


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, above, threshold), all of which hold, and a weight."""

    conditions: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, threshold in self.conditions:
            out &= (x[:, j] > threshold) == above
        return out

    def column(self, field: Callable[[str], Column] = F.col) -> Column:
        out = F.lit(True)
        for j, above, threshold in self.conditions:
            value = field(STATISTICS[j])
            out = out & ((value > F.lit(threshold)) if above else (value <= F.lit(threshold)))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.intercept + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x))))

    def column(self, field: Callable[[str], Column] = F.col) -> Column:
        """The score as an expression over the statistics, which `field` gives by name."""
        total = F.lit(float(self.intercept))
        for r in self.rules:
            total = total + F.when(r.column(field), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Thresholds of each statistic: midpoints between neighbouring values at its quantiles."""
    out = []
    for j in range(x.shape[1]):
        value = np.unique(x[:, j])
        middle = (value[1:] + value[:-1]) / 2
        out.append(np.unique(middle[np.linspace(0, len(middle) - 1, min(BINS - 1, len(middle))).astype(int)]) if len(middle) else np.zeros(0))
        if len(value) > BINS:
            cut = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
            out[-1] = np.unique(np.concatenate([out[-1], cut]))
    return out


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted trees: every node but the roots is a rule."""
    edges = _edges(x)
    binned = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    z, found = np.full(len(y), np.log(rate / (1 - rate))), {}
    for _ in range(TREES):
        p = _sigmoid(z)
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes = [(np.arange(len(y)), ())]
        for depth in range(DEPTH + 1):
            after = []
            for rows, path in nodes:
                g, h = gradient[rows].sum(), hessian[rows].sum()
                best = (1e-3, None, None)
                if depth < DEPTH and len(rows) >= 20:
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        gl = np.cumsum(np.bincount(binned[j][rows], gradient[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[j][rows], hessian[rows], len(e) + 1))[:-1]
                        nl = np.cumsum(np.bincount(binned[j][rows], minlength=len(e) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        gain[(nl < 5) | (len(rows) - nl < 5)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                _, j, k = best
                if j is None:
                    z[rows] += RATE * g / (h + 1)
                    continue
                above = binned[j][rows] > k
                for side in (False, True):
                    step = (*path, (j, side, float(edges[j][k])))
                    found[tuple(sorted(step))] = None
                    after.append((rows[above == side], step))
            nodes = after
    return [Rule(c) for c in found]


def _lasso(r: np.ndarray, y: np.ndarray, strength: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept with an L1 penalty, by accelerated proximal gradient steps. r: which rules (its
    columns) hold, as booleans."""
    n, m = r.shape
    rate = r.mean(0)
    scale = np.sqrt(np.maximum(rate * (1 - rate), 1e-4))
    a = r.astype(np.float32)
    a -= rate.astype(np.float32)
    a /= scale.astype(np.float32)
    step = 4.0 / max(_norm(a), 1e-9)
    positive = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b, v, t = np.zeros(m), np.log(positive / (1 - positive)), np.zeros(m), 1.0
    for _ in range(steps):
        error = _sigmoid((a @ v.astype(np.float32)).astype(np.float64) + b) - y
        new = v - step * (a.T @ error.astype(np.float32)).astype(np.float64) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * strength, 0)
        b -= 2.0 * error.mean()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return w / scale, float(b - (w / scale) @ rate)


def _norm(a: np.ndarray) -> float:
    """The greatest eigenvalue of a'a / n, by power iteration."""
    v = np.ones(a.shape[1], np.float32)
    for _ in range(30):
        u = a.T @ (a @ v) / len(a)
        size = np.linalg.norm(u)
        if size == 0:
            return 1.0
        v = u / size
    return float(size) * 1.05


def fit_arrays(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules and weights of labelled rows. Trees split nodes of 20 rows or more, so fewer rows than that, and rows of
    one class, give no rules. Without rules nothing tells texts apart and every score is the same: 1 without rows or
    with accepted ones alone, 0 with rejected ones alone, else the rate of accepted rows."""
    if not len(y) or y.min() == y.max():
        return RuleModel(40.0 if not len(y) or y[0] else -40.0, ())
    rules = grow_rules(x, y)
    if not rules:
        rate = y.mean()
        return RuleModel(float(np.log(rate / (1 - rate))), ())
    r = np.stack([rule.holds(x) for rule in rules], axis=1)
    held = np.arange(len(y)) % 5 == 4
    best = None
    for strength in LASSO:
        w, b = _lasso(r[~held], y[~held], strength)
        p = np.clip(_sigmoid(r[held] @ w + b), 1e-6, 1 - 1e-6)
        deviance = -np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))
        if best is None or deviance < best[0]:
            best = deviance, strength
    w, b = _lasso(r, y, best[1])
    kept = [Rule(rule.conditions, float(weight)) for rule, weight in zip(rules, w, strict=True) if abs(weight) > 1e-4]
    return RuleModel(b, tuple(kept))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label may be learnt from; a row without an id isn't one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> RuleModel:
    """Fit on at most `rows` labelled ids, none of them held out: those with the least hash. Null labels and ids are
    left out; several labels of an id count with their mean, rounded; of several texts of an id one counts."""
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    one = named.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.round(F.avg(label_col)).alias("y"))
    sample, path = materialise(least_hashed(one, "doc_id", rows), "sample")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    found = statistics(chosen).groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("x"))
    got = found.join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("y", "x.*").toPandas()
    discard(docs.sparkSession, path)
    model = fit_arrays(got[STATISTICS].to_numpy(np.float64), got["y"].to_numpy(np.float64))
    del got
    tidy()
    return model


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; null texts count as empty."""
    return statistics(docs, id_col, text_col).select("doc_id", held_out().alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model accepts, with all their columns, in one pass without a shuffle. Null texts count
    as empty; repeated rows are judged alike, an empty table stays empty, and the names of other columns don't matter.

    Only the statistics come back from Python; rows stay where they are."""
    tune(docs.sparkSession)

    @arrow_udf(", ".join(f"{k} double" for k in STATISTICS))
    def of(text: pa.Array) -> pa.Array:
        values = statistics_arrays(text)
        tidy()
        return pa.StructArray.from_arrays([pa.array(values[:, j]) for j in range(values.shape[1])], STATISTICS)

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    # As a lambda's argument the statistics are read once; as a struct's fields each of the rules would unpack them in
    # generated code, which makes the driver compile very large classes.
    score = F.transform(F.array("s"), lambda s: model.column(s.getField))[0]
    judged = rows.select("row", of.asNondeterministic()(text).alias("s")).where(score >= THRESHOLD)
    return judged.select([F.col("row").getField(k).alias(k) for k in docs.columns])
