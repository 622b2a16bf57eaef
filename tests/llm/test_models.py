import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from pointlake.llm import lattice_lm, quality_rules, url_markov

from .helpers import awkward, prose, table, words

PIECES = P.path("piece_bpe_32k.model")


def corpus(n=400, seed=8):
    """(doc_id, text), labels: some texts shout, some repeat words, some are tables."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w = prose(rng, rng.randrange(5, 200)).split()
        bad = rng.random() < 0.3
        if bad:
            kind = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x for x in w for _ in range(9)] if kind == 1 else [f"{x} |" for x in w]
        rows.append((k, " ".join(w)))
        labels.append((k, int(not bad)))
    return rows, labels


def test_quality_rules(spark):
    rows, labels = corpus(900)
    named = spark.createDataFrame([*labels, (None, 1), (3, None), (5, labels[5][1])], "doc_id long, quality int")
    docs = table(spark, rows, True)
    model = quality_rules.fit(docs, named)
    assert 0 < len(model.rules) < 200
    got = quality_rules.score(docs, model).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    # The compiled expression gives what the rules give.
    import pyarrow as pa

    plain = dict(zip([i for i, _ in rows], model.score(quality_rules.statistics_arrays(pa.array([t for _, t in rows]))), strict=True))
    assert all(abs(plain[r.doc_id] - r.score) < 1e-9 for r in got)
    kept = quality_rules.keep_good(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.predicted)


def test_quality_without_labels_and_awkward_rows(spark):
    docs = table(spark, awkward(), True)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_rules.fit(docs, none)
    got = quality_rules.score(docs, model).collect()
    assert len(got) == len(awkward()) and all(r.predicted == 1 for r in got)
    assert quality_rules.keep_good(docs, model).count() == len(awkward())
    assert quality_rules.score(table(spark, []), model).count() == 0
    one_class = quality_rules.fit_arrays(np.zeros((30, len(quality_rules.STATISTICS))), np.ones(30))
    assert one_class.rules == () and one_class.intercept > 0


def test_statistics_by_hand():
    import pyarrow as pa

    x = dict(zip(quality_rules.STATISTICS, quality_rules.statistics_arrays(pa.array(["Ab ab c!\nAB 12", None, ""]))[0], strict=True))
    assert x["words"] == pytest.approx(math.log(6)) and x["distinct"] == 3 / 5 and x["repeated"] == 1 / 5
    assert x["upper_rate"] == 3 / 14 and x["digit_rate"] == 2 / 14 and x["shout_rate"] == 1 / 14 and x["line_words"] == 2.5
    assert not quality_rules.statistics_arrays(pa.array([None, ""], pa.string())).any()


def plain_lattice(lattice, word):
    """Sum over all segmentations, by a plain recursion."""
    p, w = lattice.pieces, np.exp(lattice.log_weight)
    inner = {x: w[k] for k, x in enumerate(p.inner)}
    initial = {x: w[len(p.inner) + k] for k, x in enumerate(p.initial)}

    def rest(at):
        if at == len(word):
            return 1.0
        return sum(inner[word[at:e]] * rest(e) for e in range(at + 1, len(word) + 1) if word[at:e] in inner)

    return w[p.bare] * rest(0) + sum(initial[word[:e]] * rest(e) for e in range(1, len(word) + 1) if word[:e] in initial)


def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.read_pieces(PIECES)
    lattice = lattice_lm.Lattice(pieces, np.log(pieces.weight))
    some = ["the", "a", "hethen", "été", "ß", "x", "thing", "日本"]
    raw = [s.encode() for s in some]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw])
    start = np.cumsum(size) - size
    got, expected = lattice.run(data, start, size, np.ones(len(raw)))
    assert np.allclose(np.exp(got), [plain_lattice(lattice, r) for r in raw], rtol=1e-9)
    # Expected counts are derivatives of the log-likelihood by log weights.
    for piece in np.argsort(-expected)[:6]:
        step = lattice.log_weight.copy()
        step[piece] += 1e-5
        more, _ = lattice_lm.Lattice(pieces, step).run(data, start, size)
        assert (more.sum() - got.sum()) / 1e-5 == pytest.approx(expected[piece], rel=1e-3, abs=1e-4)
    long, _ = lattice.run(np.frombuffer(b"ab" * 500, np.uint8), np.array([0]), np.array([1000]))
    assert np.isfinite(long).all()


def test_slots():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2))
    slots = lattice_lm.Slots(keys)
    assert (slots.find(keys) == np.arange(len(keys))).all() and (slots.find(keys + np.uint64(1)) == -1).all()


@pytest.mark.parametrize("head", [0, 7, 100_000])
def test_scores_against_plain_counts(spark, head):
    rows = awkward() + [(300 + k, t) for k, (_, t) in enumerate(corpus(60)[0])]
    learnt = [(i, t) for i, t in rows if not (i is not None and zlib.crc32(str(i).encode()) % 10 == 0)]
    count = Counter(w for _, t in learnt for w in words(t))
    ends = len(learnt)
    total, kinds = sum(count.values()) + ends, len(count) + 1
    log = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    got = lattice_lm.score(table(spark, rows, True), PIECES, head_words=head, rounds=1).collect()
    want = sorted((str(i), len(words(t)) + 1, sum(count[w] > 0 for w in words(t)) + 1, round(sum(log(count[w]) for w in words(t)) + log(ends), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lattice_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lattice_lm.score(docs, PIECES).collect()
    mean = lambda rows, k: sum(r[k] for r in rows) / sum(r.n_tokens for r in rows)
    held, learnt = [r for r in got if r.held_out], [r for r in got if not r.held_out]
    assert mean(learnt, "score") > mean(learnt, "base_score") and mean(held, "score") > -4.5
    # The base gives each new word one share, however long: where few words are new, the lattice is ahead.
    known = [r for r in held if r.n_known >= 0.95 * r.n_tokens]
    assert mean(known, "score") > mean(known, "base_score")
    assert lattice_lm.score(table(spark, []), PIECES).count() == 0


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
CASES = [
    ("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://EXAMPLE.net/EN/1", "example.net", "/EN/1", "net/", "block"),
    ("http://net/x?y#z", "net", "/x", "net/", "block"),
    ("http://x.net", "x.net", "", None, None),
    ("http://x.net?a=/b", "x.net", "", None, None),
    ("http://planet/x", "planet", "/x", None, None),
    ("ftp://b.example.com/de/2#t", "b.example.com", "/de/2", "example.com/de/", "block"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("http://x.org/fr/é?q", "x.org", "/fr/é", "org/fr/", "allow"),
    ("x.org/fr/", "", "", None, None),
    ("a://b://c.net/d", "b:", "//c.net/d", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def test_url_rules_and_models(spark):
    rng = random.Random(9)
    pages = [(k, c[0]) for k, c in enumerate(CASES)]
    for k in range(600):
        good = rng.random() < 0.5
        site = rng.choice(["reading", "library", "garden"]) if good else rng.choice(["free-bets", "cheap-pills", "casino-xxx"])
        top = rng.choice([".example.net/en/", ".org/fr/"] if good else [".net/", ".example.com/de/"]) if k % 3 else ".info/"
        pages.append((100 + k, f"http://{site}{rng.randrange(50)}{top}{rng.randrange(999)}"))
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("'h' as host", "page_id", "url", "'r' as rule", "1 as verdict")
    got = {r.page_id: r for r in url_markov.judge(df, RULES).collect()}
    assert len(got) == len(pages)
    for k, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    open_ = [(got[i], u) for i, u in pages if i >= 100 and ".info/" in u]
    assert np.mean([r.verdict == ("block" if any(x in u for x in ("bets", "pills", "casino")) else "allow") for r, u in open_]) > 0.95
    assert url_markov.judge(df.limit(0), RULES).count() == 0


def test_markov_against_plain_witten_bell():
    urls, good = ["http://ab/ab", "http://ab/ba", "http://cc/cc"], np.array([True, True, False])
    model = url_markov.MarkovRatio.fit_arrays(urls, good)

    def plain(which, text):
        grams, total = Counter(), 0.0
        for u, g in zip(urls, good, strict=True):
            if g == which:
                s = "\2" + u + "\3"
                for i in range(1, len(s)):
                    for k in range(min(url_markov.ORDER, i) + 1):
                        grams[s[i - k : i], s[i]] += 1
        s = "\2" + text + "\3"
        for i in range(1, len(s)):
            p = 1 / 257
            for k in range(min(url_markov.ORDER, i) + 1):
                after = {c: n for (h, c), n in grams.items() if h == s[i - k : i]}
                if after:
                    p = (after.get(s[i], 0) + len(after) * p) / (sum(after.values()) + len(after))
            total += math.log(p)
        return total / (len(s) - 1)

    for text in ["http://ab/cc", "zz", "", "http://cc/ab"]:
        assert model.scores([text])[0] == pytest.approx(plain(True, text) - plain(False, text), abs=1e-5)
