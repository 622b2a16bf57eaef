import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from pointlake.llm import token_cache

from .test_tokens import ODD, library


def column():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeinorstüéßÄ") for _ in range(rng.randrange(1, 19)))
    texts = [rng.choice([" ", "  ", "\n", ". ", "\n\n"]).join(word() for _ in range(30)) for _ in range(60)]
    texts += ["".join(rng.choice(" \n\tabAB'sé1,.ΣΏİ ß　\xa0\x85 \0\x1c’日😀") for _ in range(rng.randrange(60))) for _ in range(600)]
    return pa.array([None, "", *ODD, *texts, None])[1:]


@pytest.mark.parametrize("remembered", [600_000, 300])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_columns_as_the_library(monkeypatch, name, remembered):
    monkeypatch.setattr(token_cache, "_encoders", {})
    encoder, kind = token_cache.library_encoder(P.path(name), remembered)
    encode, given = library(name), column()
    want = [encode(t) for t in given.to_pylist()]
    for low, high in ((0, len(want)), (40, len(want)), (0, 90)):
        got = encoder.encode_column(given[low:high])
        assert [np.frombuffer(x, kind).tolist() for x in got] == want[low:high]
    assert encoder.encode_column(pa.array([], pa.string())) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_plain_words_need_no_library(monkeypatch, name):
    monkeypatch.setattr(token_cache, "_encoders", {})
    encoder, kind = token_cache.library_encoder(P.path(name))
    rng = random.Random(6)
    text = ", ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 14))) for _ in range(3000))
    asked, encode_many = [], encoder.encode_many
    encoder.encode_many = lambda new: asked.extend(new) or encode_many(new)
    assert np.frombuffer(encoder.encode_column(pa.array([text]))[0], kind).tolist() == library(name)(text)
    assert asked == [","]
