"""The transducer and its decoder against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelforge.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "s", "'", "'s", "'ll", "'re", "!", "!!", "1", "23", " ", "\n", " ", "é", "é", "́", "ß", "İ", "Σ", "日本", "Ǆ", "½", "Ⅷ", "<|endoftext|>", "<|endof", "|>", "한", "क्षि", "​", "﻿", "\U0001f44d\U0001f3fd", "\U0001d538", "th", "ing", "\x00", "\x1f", "\x85", " ", "x" * 90, "ab" * 60]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids(found):
    return np.frombuffer(found, "<u4").tolist()


def streamed(vocabulary, text, steps):
    stream, out, at = bpe.Transducer(vocabulary), [], 0
    while at < len(text):
        step = steps()
        out.append(stream.feed(text[at : at + step]))
        at += step
    return ids(b"".join([*out, stream.feed("", True)]))


def test_texts_of_awkward_parts(vocabulary, library):
    rng = random.Random(11)
    encoder = bpe.Encoder(vocabulary)
    for k in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(b"".join(encoder(text.encode()))) == want, text
        if k % 4 == 0:
            assert streamed(vocabulary, text, lambda: rng.randrange(1, 5)) == want, text


@pytest.mark.parametrize("unit", ["a", "the", "haha", "!", "é", "日本", "lolol", "random"])
def test_endless_pieces_in_constant_memory(vocabulary, library, unit):
    rng = random.Random(2)
    text = "".join(rng.choice(["the", "in", "er", "an", "s", "ing", "on", "a"]) for _ in range(12_000)) if unit == "random" else unit * 12_000
    stream, out, held = bpe.Transducer(vocabulary), [], 0
    for k in range(0, len(text), 500):
        out.append(stream.feed(text[k : k + 500]))
        held = max(held, stream.held)
    out.append(stream.feed("", True))
    assert ids(b"".join(out)) == library.encode(text, add_special_tokens=False).ids and held <= stream.limit + 4


def test_texts_longer_than_a_block(vocabulary, library):
    text = "word " * 30_000 + "x" * 200_000 + "é" * 50_000 + " tail\n" + "a<|endoftext|>b" * 20_000
    assert ids(b"".join(bpe.Encoder(vocabulary)(text.encode()))) == library.encode(text, add_special_tokens=False).ids


def plain_merges(symbols, ranks):
    symbols = [*symbols]
    while len(symbols) > 1 and (best := min((ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(symbols, symbols[1:]))))[0] < 1 << 60:
        symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
    return symbols


def test_lookahead_is_sufficient_on_small_merge_lists():
    """For random merge lists, no continuation changes a token that ends so far before the end."""
    rng = random.Random(4)
    needed = 0
    for _ in range(150):
        tokens, merges = ["a", "b"], []
        while len(merges) < 8:
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and len(u + v) < 9:
                tokens.append(u + v)
                merges.append((u, v))
        far, ranks = bpe.sufficient_lookahead(merges), {m: k for k, m in enumerate(merges)}
        for _ in range(60):
            text = "".join(rng.choice("ab") for _ in range(40))
            ends = lambda s: set(np.cumsum([len(t) for t in plain_merges(s, ranks)]).tolist())
            first, whole = ends(text[:30]), ends(text)
            unlike = [30 - k for k in (first ^ whole) if k < 30]
            needed = max([needed, *unlike])
            assert all(x < far for x in unlike), (merges, text)
    assert needed > 3


def test_short_and_long_pieces_are_merged_alike(vocabulary, monkeypatch):
    rng = random.Random(8)
    for _ in range(300):
        symbols = [rng.choice("theinrsao") for _ in range(rng.randrange(1, 60))]
        short = vocabulary.merge([*symbols])
        monkeypatch.setattr(bpe, "SHORT", 0)
        assert vocabulary.merge([*symbols]) == short == plain_merges(symbols, vocabulary.ranks)
        monkeypatch.undo()


def test_many_pieces_at_once_are_merged_like_one(vocabulary):
    rng = random.Random(9)
    pieces = ["".join(rng.choice("theinrsao'!0Ã©") for _ in range(rng.randrange(1, 25))) for _ in range(3000)] + ["a", "aaaaaaaa", "é"]
    want = [b"".join(vocabulary.ids[t].to_bytes(4, "little") for t in vocabulary.merge([*p[:-1], p[-1] + "</w>"])) for p in pieces]
    assert vocabulary.merge_many(pieces) == want


def test_decoder_in_any_portions(vocabulary, library):
    text = "Café 日本 don't <|endoftext|> \U0001f44d " * 40
    found = library.encode(text, add_special_tokens=False).ids
    raw = np.array(found, "<u4").tobytes()
    for step in (1, 3, 1000):
        plain, spelt = bpe.Decoder(vocabulary), bpe.Decoder(vocabulary, plain=False)
        portions = [raw[k : k + 4 * step] for k in range(0, len(raw), 4 * step)]
        assert b"".join(map(plain.feed, portions)).decode() == library.decode(found, skip_special_tokens=False)
        words = b"".join([*map(spelt.feed, portions), spelt.feed(b"", True)]).decode()
        assert words.split()[:5] == ["café", "日本", "don", "'t", "<|endoftext|>\U0001f44d"]
    broken = bpe.Decoder(vocabulary, plain=False)
    assert broken.feed(vocabulary.ids["Ã"].to_bytes(4, "little")) == b"" and broken.feed(b"", True).decode() == "�"


def test_merge_lists_of_unknown_stability_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        content = json.load(file)
    content["model"]["merges"].reverse()
    (tmp_path / "reversed.json").write_text(json.dumps(content))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "reversed.json"))


def test_awkward_rows(docs, plain, library):
    def want(doc_id, text):
        found = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return doc_id, len(found), digest(np.array(found, "<u4").tobytes()), digest(library.decode(found, skip_special_tokens=False).encode())

    assert sorted(map(tuple, bpe.digests(docs).collect())) == sorted(want(d, t) for d, t, *_ in plain)
    rows = [(r["doc_id"], r["portion"], r["ids"]) for r in bpe.encode(docs).collect()]
    assert sorted(x for _, _, found in rows for x in found) == sorted(x for _, t, *_ in plain for x in library.encode(t or "", add_special_tokens=False).ids)
    assert {d for d, *_ in rows} == {d for d, *_ in plain}


def test_empty_table(empty):
    assert bpe.digests(empty).collect() == [] and bpe.encode(empty).collect() == []
