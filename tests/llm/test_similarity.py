import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from pointlake.llm import compact_windows, fingerprints, metric_join
from pointlake.llm.bytetext import mix

from .helpers import awkward, components, prose, table, words


def test_windows_against_all_subsequences():
    rng = np.random.default_rng(1)
    for n, least in [(1, 1), (5, 3), (40, 4), (60, 9), (30, 1)]:
        value = mix(rng.integers(0, 25, n).astype(np.uint64))
        begin = np.array([0, n // 3, n])
        got = set(zip(*[x.tolist() for x in compact_windows.compact_windows(value, begin, least)], strict=True))
        want = set()
        for a, b in ((0, n // 3), (n // 3, n)):
            of = {}
            for i in range(a, b):
                for j in range(i + least - 1, b):
                    c = min(range(i, j + 1), key=lambda k: (int(value[k]) >> 24, k))
                    lo, hi = of.get(c, (i, j))
                    of[c] = min(lo, i), max(hi, j)
            want |= {(c, lo, hi) for c, (lo, hi) in of.items()}
        assert got == want


def planted(seed=2):
    """(rows, {doc_id: (start, words)} of repeats, ids that have none)."""
    rng = random.Random(seed)
    text = lambda n: prose(rng, n).split()
    rows, repeats, passage = [], {}, text(70)
    for k in range(6):
        head = text(30 + 11 * k)
        rows.append((10 + k, " ".join(head + passage + text(40))))
        if k:
            repeats[10 + k] = len(head), 70
    edited = list(passage)
    edited[35] = "edited"
    head = text(25)
    rows.append((30, "".join(c.upper() if c.isascii() else c for c in "  ".join(head + edited + text(25)))))
    repeats[30] = len(head), 70
    whole = text(120)
    rows += [(40, " ".join(whole)), (41, "\n".join(whole))]
    repeats[41] = 0, 120
    short = text(40)
    rows += [(50 + k, " ".join(text(60) + short + text(60))) for k in range(3)]  # too short to count
    clean = [50, 51, 52]
    for k in range(60, 75):
        rows.append((k, " ".join(text(rng.randrange(1, 300)))))
        clean.append(k)
    twice = text(60)
    rows.append((80, " ".join(twice + text(9) + twice)))  # repeats itself only
    return rows, repeats, [*clean, 80, 10, 40]


@pytest.mark.parametrize("extra", [False, True])
def test_passages(spark, extra):
    rows, repeats, clean = planted()
    docs = table(spark, [*rows, (None, rows[0][1]), (90, None), (91, "")], extra)
    got = compact_windows.spans(docs).collect()
    found = {r.doc_id: (r.start_word, r.n_words) for r in got}
    assert found == repeats and not set(found) & set(clean)
    assert all(r.first_doc_id < r.doc_id and r.similarity >= 0.8 for r in got)
    assert {r.first_doc_id for r in got if r.doc_id < 40} == {10}
    cut = compact_windows.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    after = {r.doc_id: r.text for r in cut.collect() if r.doc_id is not None}
    for i, t in rows:
        start, n = repeats.get(i, (0, 0))
        assert words(after[i]) == words(t)[:start] + words(t)[start + n :]
        if i not in repeats:
            assert after[i] == t


def _covered(spark, rows):
    """{doc_id: places of words in passages that an earlier document has}."""
    out = {}
    for r in compact_windows.spans(table(spark, rows)).collect():
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    return out


def test_passages_beyond_the_first_holder(spark):
    rng, rows, want = random.Random(6), [], {}
    text = lambda n: prose(rng, n).split()
    for k in range(40):
        x, y = text(60), text(80)
        base = 100 * k
        rows += [(base, text(30) + x[:45] + text(30)), (base + 1, text(20) + x + text(20)), (base + 2, text(25) + x + text(25))]
        want[base + 2] = set(range(25, 85))
        rows += [(base + 10, text(20) + y[:45] + text(9)), (base + 11, text(20) + y[35:] + text(9)), (base + 12, text(30) + y + text(30)), (base + 13, text(40) + y + text(10))]
        want[base + 13] = set(range(40, 120))
    line = text(30)
    rows += [(9000 + k, text(30) + line + text(30)) for k in range(30)]  # frequent, and too short
    got = _covered(spark, [(i, " ".join(t)) for i, t in rows])
    assert got.keys() == want.keys()
    # The words beside a passage may be equal by chance, as some are frequent.
    assert all(want[i] <= got[i] and len(got[i]) <= len(want[i]) + 4 for i in want)


def test_passages_among_repeated_lines(spark):
    rng = random.Random(7)
    text = lambda n: prose(rng, n).split()
    twice, x = text(60), text(60)
    line = x[24:36]
    rows = [(1, text(9) + twice + text(9)), (2, text(20) + twice + text(20) + twice), (3, text(9) + x + text(9)), (4, line + text(10) + x + text(10))]
    rows += [(5, line + text(9) + line + text(9) + line)]
    got = _covered(spark, [(i, " ".join(t)) for i, t in rows])
    assert got == {2: {*range(20, 80), *range(100, 160)}, 4: set(range(22, 82))}


def test_no_edited_passage_is_missed(spark):
    rng, rows, want = random.Random(8), [], set()
    text = lambda n: prose(rng, n).split()
    for k in range(600):
        n = rng.choice([50, 60, 100])
        x = text(n)
        edited = list(x)
        if k % 4:
            for at in range(25, n - 20, 50):
                edited[at + rng.randrange(-15, 15)] = f"edit{k}"
        rows += [(2 * k, text(60) + x + text(60)), (2 * k + 1, text(60) + edited + text(60))]
        want.add(2 * k + 1)
    assert set(_covered(spark, [(i, " ".join(t)) for i, t in rows])) == want


def test_passages_awkward(spark):
    docs = table(spark, awkward(), True)
    got = {r.doc_id for r in compact_windows.spans(docs).collect()}
    texts = dict(awkward())
    want = {i for i, t in awkward() if i is not None and any(j is not None and j < i and len(words(t)) >= 50 and b" ".join(words(u)) in b" ".join(words(t)) and len(words(u)) >= 50 for j, u in awkward())}
    assert got == want, texts
    assert compact_windows.spans(table(spark, [])).count() == 0
    assert compact_windows.cut_repeats(table(spark, [], True)).count() == 0


def test_clean_passages_match_by_jaccard():
    match = np.full(200, -1)
    match[20:60] = np.arange(5, 45)
    match[65:105] = np.arange(50, 90)
    [(start, length, at, same)] = compact_windows.passages(match, 46, 0.8)
    assert (start, length, at) == (20, 85, 5) and same == pytest.approx(80 / 90)
    assert compact_windows.passages(match, 46, 0.95) == []


def vectors(seed=3, n=300, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * rng.uniform(0, 0.6, (n, 1))
    x = np.concatenate([base, near, near[:20]]).astype(np.float32)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * dim), (1003, [1.0] * (dim - 1) + [None]), (1004, [1.0] * (dim - 1) + [float("nan")]), (1005, [float("inf")] + [1.0] * (dim - 1)), (1006, [1.0, 0.0]), (1007, [2.0, 0.01]), (None, rows[0][1]), (5, rows[5][1]), (5, None)]
    return rows


@pytest.mark.parametrize("size", [4096, 32])
def test_metric_join_against_brute_force(spark, size):
    rows = vectors()
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        unit.append(np.float64(v) if ok else None)

    def linked(a, b):
        u, v = unit[a], unit[b]
        return u is not None and v is not None and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.9

    group = components(range(len(rows)), linked)
    want = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if group[b] == group[a] and rows[b][0] is not None]
        links = sum(linked(a, b) for b in range(len(rows)) if b != a)
        least = min(ids, default=None)
        want.append((i, links, least, i is not None and i == least))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("0 as cell", "vec_id", "embedding", "1 as node", "'x' as label")
    got = metric_join.near_duplicates(df, own_rows=size, other_rows=size * 2, pivot_rows=size)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert max(w[1] for w in want) > 20


def test_pivots_prune_clusters(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 16))
    x = (centre[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 16)) * 0.05).astype(np.float32)
    rows = [(int(i), bytearray(r.tobytes()), 1) for i, r in enumerate(x)]
    classes = spark.createDataFrame(rows, "node long, v binary, m long")
    chosen = metric_join.choose_pivots(classes, "<f4")
    assert len(chosen) == metric_join.FEW_PIVOTS
    placed, _, guests = metric_join.placement(classes, "<f4", chosen)
    own = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}
    replicas = {r.cell: r["count"] for r in guests.groupBy("cell").count().collect()}
    compared = sum(n * (n - 1) // 2 + n * replicas.get(c, 0) for c, n in own.items())
    assert len(own) > 5 and 0 < sum(replicas.values()) < 0.5 * 1500 * len(own)
    assert compared < 0.5 * 1500 * 1499 / 2


def test_metric_join_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert metric_join.near_duplicates(df).count() == 0


def test_fingerprints_of_edits(spark):
    rows = awkward()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + u[:cut]
        prints = ["".join(f"{x:02x}" for x in r) for r in fingerprints.fingerprint_arrays(pa.array([t, edited, u]))]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints))
    got = fingerprints.edited_fingerprints(table(spark, rows, True).repartition(3)).collect()
    following = dict.fromkeys(w[:5] for w in want)
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted((w[:5] for w in want), key=str) and following
    like = lambda a, b: max(0.0, np.cos(np.pi * (int(a, 16) ^ int(b, 16)).bit_count() / 128))
    nexts = sorted((str(w[0]), round(like(w[3], w[4]), 9), round(like(w[3], w[5]), 9)) for w in want)
    assert sorted((str(r.doc_id), round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == nexts
    [one] = fingerprints.edited_fingerprints(table(spark, [(7, "a b c d")])).collect()
    assert one.near_next == 1.0
    assert fingerprints.edited_fingerprints(table(spark, [])).count() == 0


def test_fingerprints_follow_similarity():
    rng = random.Random(5)
    texts = [prose(rng, 400).split() for _ in range(30)]
    a = fingerprints.fingerprint_arrays(pa.array([" ".join(t) for t in texts]))
    b = fingerprints.fingerprint_arrays(pa.array([" ".join(t[:300] + u[:100]) for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]))
    assert 0.6 < fingerprints.likeness(a, b).mean() < 0.9
    assert fingerprints.likeness(a, np.roll(a, 1, axis=0)).mean() < 0.15
    assert (fingerprints.likeness(a, a) == 1).all()


def test_search_by_permuted_tables(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    prints = [b.tobytes() for b in base]
    for b in base[:20]:
        for flips in range(1, 7):
            x = np.unpackbits(b)
            x[rng.choice(128, flips, replace=False)] ^= 1
            prints.append(np.packbits(x).tobytes())
    rows = [(k, p.hex()) for k, p in enumerate([*prints, prints[0]])] + [(999, None)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = {(r.query, r.fingerprint): r.distance for r in fingerprints.search(df.where("doc_id < 50"), df).collect()}
    far = lambda p, q: (int.from_bytes(p) ^ int.from_bytes(q)).bit_count()
    want = {(p.hex(), q.hex()): far(p, q) for p in prints[:50] for q in prints if far(p, q) <= 3}
    assert got == want
    with pytest.raises(ValueError):
        fingerprints.search(df, df, 4)
