import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from skerry.llm import tokens

BITS = ["word", "Word", "don't", "H̱", "İ", "é", "É", "ß", "ſ", "Σ", "!", "...", "'s", "'", "12", "3", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "\u0085", "\x1c", "​", "“", "日本", "🙂", "<|endoftext|>", ",", "-", "a.b", "A,'ll", "́"]


@pytest.mark.parametrize(("file", "scheme"), [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_chunks_give_the_ids_of_whole_texts(file, scheme):
    path = public_tokenizers.path(file)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [None, "", "  ", "x" * 50000, "lorem ipsum " * 9000]
    e = tokens.Encoder(path, scheme)
    for k in range(0, len(texts), 700):
        part = texts[k : k + 700]
        for text, ids in zip(part, e.encode(pa.array(part, pa.string()))):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_empty_and_sliced_arrays():
    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "bytes")
    assert e.encode(pa.array([], pa.string())) == []
    assert [x.tolist() for x in e.encode(pa.array([None, ""], pa.string()))] == [[], []]
    a, b = pa.array(["a b", "c d", "e"]), pa.array(["c d", "e"])
    assert all(np.array_equal(x, y) for x, y in zip(e.encode(a.slice(1)), e.encode(b)))


@pytest.mark.parametrize(("file", "scheme"), [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_strings_of_added_tokens_give_their_ids(file, scheme):
    path = public_tokenizers.path(file)
    plain = Tokenizer.from_file(path)
    rng = random.Random(4)
    bits = BITS + ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>"]
    texts = ["one <|endoftext|> two", None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000))]
    got = tokens.encoder(path, scheme, added=True).encode(pa.array(texts, pa.string()))
    assert len(got[0]) == {"bytes": 4, "words": 3}[scheme]
    for text, ids in zip(texts, got):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize(("file", "scheme"), [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_cache_is_bounded_and_starts_anew(monkeypatch, file, scheme):
    monkeypatch.setattr(tokens, "CACHED_BYTES", 20_000)
    path = public_tokenizers.path(file)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(5)
    e = tokens.Encoder(path, scheme)
    for k in range(30):
        texts = ["".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(rng.choice([3, 10, 400]))) + f" w{k} word" for _ in range(60)]
        got = e.encode(pa.array(texts))
        assert e.held < 60_000 and len(e.chunks) == len(e.lengths) and all(len(c.encode()) <= tokens.LONGEST for c in e.chunks.to_pylist())
        for text, ids in zip(texts[::9], got[::9]):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_many_texts_without_blanks_in_bounded_memory():
    rng = np.random.default_rng(6)
    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "bytes")
    for _ in range(20):
        texts = pa.array(["".join(map(chr, row)) for row in rng.integers(0x4E00, 0x9F00, (5_000, 24))])
        assert len(e.encode(texts)) == 5_000
        assert e.held <= tokens.CACHED_BYTES and len(e.chunks) == 0
