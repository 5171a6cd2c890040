"""BPE against the public library, word by word and over whole texts."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillcast.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def own(text):
    import numpy as np
    return np.frombuffer(b"".join(e[0] for e in bpe.load(PATH).encode(text)), "<i4").tolist()


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own(text) == ids
    assert bpe.decode(PATH, ids) == library.decode(ids, skip_special_tokens=False)


TEXTS = ["", " ", "Hello, World! It's 1999's", "ΟΔΥΣΣΕΥΣ ΣΑΣ", "İstanbul ǅ ẞ", "é é ﬁ",
         "<|endoftext|>x<|startoftext|> <|endoftext|><|ENDOFTEXT|>", "a b c\x1cd\x85e​f",
         "👩‍👩‍👧 日本語 ١٢٣ ½ ②", "don't WE'LL i'Ve '''s", "a" * 500, "ab" * 700 + "z" * 63, "!?" * 300,
         "\x00\x01\x7f", "<|start<|endoftext|>oftext|>", "x﻿y z᠎", "\x1f\x1ca\x1d b"]


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(library, text):
    same(library, text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(library, text):
    same(library, text)


@pytest.mark.parametrize("around", ["a {}b", "a\u0301{}\u03231"])
def test_every_code_point(library, around):
    """Beside letters, and between marks that may combine or change places."""
    texts = [around.format(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000
             and (c < 0x34000 or c % 0x10000 < 0x400 or c % 0x10000 >= 0xFC00 or 0x3CF00 <= c < 0x3FD00)]
    found = library.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, found, strict=True) if own(t) != e.ids] == []


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from([chr(c) for c in bpe.LOWERED]),
                         st.characters(min_codepoint=0x300, categories=["Mn", "Mc", "Lo"]),
                         st.characters(max_codepoint=0x250)), max_size=20))
def test_marks_among_letters(library, text):
    same(library, text)


def test_scan_and_heap_agree():
    pieces, rng = bpe.load(PATH), random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 60)))
        parts = pieces._parts(word)
        assert pieces.merge([*parts]) == pieces._merge_long([*parts])


def test_whole_table(spark, small, library):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in frame.collect()}
    rows = bpe.encode(frame.select("doc_id", "text"), PATH).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == sha(" ".join(map(str, ids)))
        assert row.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    assert len(rows) == len(texts)


def test_awkward_rows_and_columns(awkward):
    got = bpe.encode(awkward, PATH)
    assert got.columns == [*(c for c in awkward.columns if c != "text"), "ids_", "n_tokens",
                           "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert len(rows) == 10 and [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert bpe.encode(awkward.limit(0), PATH).count() == 0


def test_words_in_use_outlive_rare_ones(monkeypatch):
    """A word met again and again is merged once, however many rare words pass between."""
    monkeypatch.setattr(bpe, "HALF", 10)
    pieces = bpe.WordPieces(PATH)
    merged = []
    monkeypatch.setattr(pieces, "merge", lambda parts, merge=pieces.merge: merged.append(len(parts)) or merge(parts))
    for n in range(200):
        pieces.encode("common " + "x" * (n % 50) + "abcdefghij"[n // 20] * 3)
    assert merged.count(len("common")) < 15
    assert len(pieces.seen) <= 10 and len(pieces.older) <= 10


def test_written_out_properties_split_alike():
    pieces = bpe.WordPieces(PATH)
    for n in [*range(0xD800), *range(0xE000, 0x10000)]:
        text = f"a{chr(n)}b'll1{chr(n)}{chr(n)} "
        assert pieces.plain_words.findall(text) == pieces.words.findall(text), hex(n)
        assert bool(bpe._NARROW_LATE.search(chr(n))) == bool(bpe._LATE.search(chr(n))), hex(n)


def test_properties_outside_a_class_are_not_written_out():
    assert bpe.plain(r"\p{L}+|[^\s]") is None
