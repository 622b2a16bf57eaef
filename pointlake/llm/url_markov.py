"""URL filters: rules by host and path, and for other URLs a ratio of character language models.

Two variable-order Markov models over bytes, one of accepted and one of rejected URLs, are smoothed by Witten-Bell
interpolation from order ORDER down to a uniform choice. A URL's score is the difference of its log-likelihoods by its
length; the threshold is calibrated on fitted URLs set aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.bytetext import prefix_sums, span_hash
from pointlake.llm.common import least_hashed, tune

ORDER = 5
#: URLs that the models are fitted on, at most; this bounds the models too.
FIT_URLS = 8192
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without it or for null."""
    rest = F.regexp_extract(F.col(url), "(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: str) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.regexp_extract(F.col(url), "(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: (verdict, host with path); a rule fits its
    host and all subdomains, if the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for given, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith(f".{name}")) & F.col(path).startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(given)).otherwise(verdict)
    return rule, verdict


@dataclass
class _Grams:
    """Counts by hash of a context with its next byte, and by hash of a context; columns: accepted, rejected."""

    gram: np.ndarray
    gram_count: np.ndarray
    context: np.ndarray
    context_count: np.ndarray
    context_kinds: np.ndarray


def _symbols(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a start and an end mark each, places of the symbols to predict, URL of each place)."""
    raw = [b"\x02" + u.encode() + b"\x03" for u in urls]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    start = np.cumsum(size) - size
    place = np.setdiff1d(np.arange(len(data)), start, assume_unique=True)
    return data, place, np.repeat(np.arange(len(raw)), size - 1)


def _hashes(data: np.ndarray, place: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: which places have so long a context, and the hashes of context and of context with byte."""
    sums = prefix_sums(data, fold=False)
    first = np.searchsorted(owner, np.arange(int(owner[-1]) + 1 if len(owner) else 0))
    begin = place[first][owner] - 1 if len(owner) else place
    for k in range(ORDER + 1):
        has = np.flatnonzero(place - k >= begin)
        at = place[has]
        yield has, span_hash(sums, at - k, at), span_hash(sums, at - k, at + 1)


class MarkovRatio:
    """Fitted models of both kinds; scores are above 0 where accepted URLs make a URL likelier."""

    def __init__(self, grams: list[_Grams], threshold: float = 0.0):
        self.grams, self.threshold = grams, threshold

    @classmethod
    def fit_arrays(cls, urls: list[str], accepted: np.ndarray) -> MarkovRatio:
        data, place, owner = _symbols(urls)
        kind = np.where(accepted[owner], 0, 1) if len(owner) else np.zeros(0, np.int64)
        grams = []
        for has, context, gram in _hashes(data, place, owner):
            side = kind[has]
            keys, at = np.unique(gram, return_inverse=True)
            count = np.stack([np.bincount(at[side == s], minlength=len(keys)) for s in (0, 1)], axis=1)
            names, to = np.unique(context, return_inverse=True)
            total = np.stack([np.bincount(to[side == s], minlength=len(names)) for s in (0, 1)], axis=1)
            context_of = np.zeros(len(keys), np.int64)
            context_of[at] = to
            kinds = np.stack([np.bincount(context_of[count[:, s] > 0], minlength=len(names)) for s in (0, 1)], axis=1)
            grams.append(_Grams(keys, count.astype(np.float32), names, total.astype(np.float32), kinds.astype(np.float32)))
        return cls(grams)

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """Log-likelihood ratio by symbol (bytes and the end); null counts as empty."""
        if not urls:
            return np.zeros(0)
        data, place, owner = _symbols([u or "" for u in urls])
        p = np.full((len(place), 2), 1.0 / 257)
        for (has, context, gram), g in zip(_hashes(data, place, owner), self.grams, strict=True):
            if not len(g.context):
                continue
            c = np.minimum(np.searchsorted(g.context, context), len(g.context) - 1)
            known = g.context[c] == context
            has, c, gram = has[known], c[known], gram[known]
            j = np.minimum(np.searchsorted(g.gram, gram), len(g.gram) - 1)
            count = np.where((g.gram[j] == gram)[:, None], g.gram_count[j], 0.0)
            total, kinds = g.context_count[c], g.context_kinds[c]
            p[has] = np.where(total > 0, (count + kinds * p[has]) / np.maximum(total + kinds, 1), p[has])
        ratio = np.log(p[:, 0]) - np.log(p[:, 1])
        return np.bincount(owner, ratio, len(urls)) / np.bincount(owner, minlength=len(urls))

    def calibrate(self, urls: list[str], accepted: np.ndarray) -> None:
        """Set the threshold that gets most of both kinds right, on average; halfway to the next score."""
        if not len(urls) or accepted.all() or not accepted.any():
            return
        score = self.scores(urls)
        order = np.argsort(score, kind="stable")
        good = accepted[order]
        right = np.concatenate([[0], np.cumsum(~good)]) / max(1, (~good).sum()) + (good.sum() - np.concatenate([[0], np.cumsum(good)])) / good.sum()
        best = int(right.argmax())
        edge = np.concatenate([[score[order[0]] - 1e-9], (score[order[1:]] + score[order[:-1]]) / 2, [score[order[-1]] + 1e-9]])
        self.threshold = float(edge[best])


def fit(labelled: DataFrame, url: str = "url", verdict: str = "verdict", urls: int = FIT_URLS) -> MarkovRatio:
    """Fit on at most `urls` distinct URLs with a verdict allow or block, those with the least hash; every fifth is set
    aside to calibrate. Without such URLs every score is 0 and passes."""
    named = labelled.where(F.col(verdict).isin("allow", "block") & F.col(url).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.max(F.col(verdict) == "allow").alias("good"))
    rows = least_hashed(named, "url", urls).collect()
    text, good = [r.url for r in rows], np.array([r.good for r in rows], bool)
    aside = np.arange(len(text)) % 5 == 4
    part = MarkovRatio.fit_arrays([t for t, a in zip(text, aside, strict=True) if not a], good[~aside])
    part.calibrate([t for t, a in zip(text, aside, strict=True) if a], good[aside])
    model = MarkovRatio.fit_arrays(text, good)
    model.threshold = part.threshold
    return model


def score(pages: DataFrame, model: MarkovRatio, url: str = "url") -> DataFrame:
    """pages with a column url_score; null URLs count as empty. Existing columns of that name are replaced."""
    tune(pages.sparkSession)
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def ratio(u: pa.Array) -> pa.Array:
        return pa.array(model.scores(u.to_pylist()), pa.float64())

    return pages.withColumn("url_score", ratio(F.col(url).cast("string")))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url: str = "url", urls: int = FIT_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, url_score for every row of pages, repeated ones as often.

    The verdict is the longest fitting rule's, and else allow where the models' score reaches their threshold. The
    models are fitted on URLs that rules decide. Null URLs have an empty host and path and are judged as empty."""
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url")).withColumn("host", host_of("url")).withColumn("path", path_of("url"))
    rule, verdict = rule_of(rules)
    ruled = named.withColumn("rule", rule).withColumn("by_rule", verdict)
    model = fit(ruled, "url", "by_rule", urls)
    judged = score(ruled, model)
    by_model = F.when(F.col("url_score") >= F.lit(model.threshold), F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "url_score")
