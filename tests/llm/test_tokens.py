import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from pointlake.llm import bpe_codec, slack_packing, token_store
from pointlake.llm.mphf import MinimalPerfectHash

from .helpers import awkward, table

ODD = ["  a  b ", "a\n b", "It's  'S they'LL\n\n x", "ΑΣ Σ's ΑΣ", "é x ́ é", "İstanbul 123 4a", "<|endoftext|> x", "\x1c a\x1cb  c　 d", "日本 語です", "a\0 b\0c", "ﬁ ſ K Å", "a,b.c!!\nX y"]


def rows():
    rng = random.Random(2)
    odd = [(500 + k, t) for k, t in enumerate(ODD)]
    odd += [(600 + k, "".join(rng.choice(" \n\tabAB'sé1,.ΣΏİ ß") for _ in range(40))) for k in range(60)]
    return awkward() + odd


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_bpe_as_the_library(spark):
    file = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_codec.read_ranks(file), special_tokens={})
    want = []
    for i, t in rows():
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe_codec.round_trip(table(spark, rows(), True), file)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    encoded = bpe_codec.encode(table(spark, rows()), file)
    back = {r.doc_id: bytes(r.data) for r in bpe_codec.decode(encoded, file).collect() if r.doc_id is not None}
    assert all(back[i] == (t or "").encode() for i, t in rows() if i is not None)
    assert bpe_codec.round_trip(table(spark, []), file).count() == 0


def test_merge_of_long_words():
    vocabulary, _ = bpe_codec.codec(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(4)
    for n in (1, 2, 3, 17, 300, 4000):
        word = "".join(rng.choice("abtheionr") for _ in range(n))
        assert vocabulary.merge(word.encode()) == own.encode_ordinary(word) or word.encode() in vocabulary.ranks


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    mph = MinimalPerfectHash.loads(MinimalPerfectHash.build(keys).dumps())
    assert sorted(mph.lookup(keys)) == list(range(len(keys)))
    assert (mph.lookup(keys + np.uint64(1)) >= 0).mean() < 0.01
    assert len(MinimalPerfectHash.build(keys[:0]).lookup(keys)) == len(keys)
    with pytest.raises(ValueError):
        MinimalPerfectHash.build(np.array([1, 1], np.uint64))


def test_token_store(spark):
    encode = library("word_bpe_49k.json")
    given = sorted(((i, encode(t) + [2]) for i, t in rows()), key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    want, start = [], 0
    for i, ids in given:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    docs = table(spark, rows(), True).repartition(3)
    store = token_store.write_store(docs, P.path("word_bpe_49k.json"))
    assert len(store.totals) > 1 and sum(store.totals) == start
    assert sorted((tuple(r) for r in store.read(docs).collect()), key=str) == sorted(want, key=str)
    one = store.read(table(spark, [(103, None), (99999, None)])).collect()
    assert [tuple(r) for r in one] == [w for w in want if w[0] == 103]
    empty = token_store.write_store(table(spark, []), P.path("word_bpe_49k.json"))
    assert empty.read(docs).count() == 0


def check_pieces(pieces, want):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc, ids in want.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    sizes = []
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        sizes.append(at)
    return sizes


def test_packing(spark):
    encode = library("byte_bpe_50k.json")
    given = [(i, t) for k, (i, t) in enumerate(rows()) if i is not None and i != 107]
    want = {i: encode(t) + [1] for i, t in given}
    got = slack_packing.pack(table(spark, given, True).repartition(2), P.path("byte_bpe_50k.json")).collect()
    sizes = check_pieces([r.asDict() for r in got], want)
    assert all(s.bit_count() == 1 and s <= 2048 for s in sizes)  # nothing is padded
    assert slack_packing.pack(table(spark, []), P.path("byte_bpe_50k.json")).count() == 0
    twice = slack_packing.pack(table(spark, [(1, "a b"), (1, "a b"), (None, None)]), P.path("byte_bpe_50k.json")).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


def test_packer_is_full_with_few_cuts():
    rng = np.random.default_rng(6)
    ids = {k: rng.integers(0, 50000, int(n)).astype("<u2") for k, n in enumerate(rng.lognormal(6.5, 1, 800) + 1)}
    packer = slack_packing.Packer(0)
    for k, x in ids.items():
        packer.add(k, x)
    packer.end()
    rows_ = packer.taken().to_pylist()
    sizes = check_pieces(rows_, {k: x.tolist() for k, x in ids.items()})
    assert sum(s != 2048 for s in sizes) <= 11
    needed = sum(-(-len(x) // 2048) for x in ids.values())
    assert len(rows_) < needed * 1.1 + 12


def test_fullest_against_all_subsets():
    rng = random.Random(7)
    for _ in range(200):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 9))]
        capacity = rng.randrange(1, 80)
        counts = {x: items.count(x) for x in items}
        best = max(s for s in (sum(x for k, x in enumerate(items) if m >> k & 1) for m in range(1 << len(items))) if s <= capacity)
        found = slack_packing.fullest(counts, capacity)
        assert sum(k * v for k, v in found.items()) == best
        assert all(v <= counts[k] for k, v in found.items())
