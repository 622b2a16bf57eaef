import random

import numpy as np
import pytest
import xxhash

from pointlake.llm import simhash_pivot
from pointlake.llm.components import connected_components

from .helpers import awkward, components, table, words


def plain_print(text):
    w = words(text)
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def expected(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    distinct = sorted({p for _, p in prints})
    group = components(distinct, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, p in prints:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    return sorted(((i, f"{p:016x}", least.get(group[p])) for i, p in prints), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_against_brute_force(spark, extra):
    rows = awkward()
    rng = random.Random(3)
    for k in range(30):  # near copies of a long text
        w = rows[43][1].split()
        for _ in range(rng.choice([1, 2, 40])):
            w[rng.randrange(len(w))] = "edited"
        rows.append((200 + k, " ".join(w)))
    got = simhash_pivot.near_duplicates(table(spark, rows, extra)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
    assert len({r.component_id for r in got}) < len(rows) - 15


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash_pivot, "CELL", 8)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base[:4].tolist():
        for _ in range(60):
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                prints.add(int(b) ^ 1 << int(bit))
            b ^= 1 << int(rng.integers(64))
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.node: r.component for r in connected_components(simhash_pivot.fingerprint_links(df)).collect()}
    want = components(sorted(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert {p: got.get(p, p) for p in signed} == want


def test_empty_and_drop(spark):
    assert simhash_pivot.near_duplicates(table(spark, [])).count() == 0
    rows = awkward()
    want = expected(rows)
    kept = [r.doc_id for r in simhash_pivot.drop_near_duplicates(table(spark, rows, True)).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({i for i, _, c in want if i is not None and i == c})
    assert simhash_pivot.drop_near_duplicates(table(spark, [], True)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(k, 5) for k in range(200, 260)] + [(7, 7), (None, 3), (5, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 3 for k in [3, 5, *range(200, 260)]}
