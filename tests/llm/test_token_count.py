import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkfolio.llm import token_count as t
from sparkfolio.llm.queries import op13_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def theirs(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def own(text):
    cutter = t.load(PATH)
    return cutter.count(text, t.Lengths({}, cutter.length).__getitem__)


def test_every_character_and_hard_texts(library):
    for start in range(0, 0x20000, 64):
        chars = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000]
        text = " ".join("x" + c + "1 " + c + " e" + c for c in chars)
        assert own(text) == theirs(library, text), hex(start)
    for text in ("", " ", "a\x1cb\x85c", "ΑΣ ΣΑΣ", "İstanbul Ị̇", "é Ẹ́", "it's I'LL WE'VE'D", "x<|endoftext|>y <|ENDOFTEXT|>", "<|startoftext|><|endoftext|>",
                 "<|endoftext", "a" * 5000, "日本語" * 300, "1234567", "한국어 각", "K Ω", "\x00\x01", "🙂🙂 é", "don't 'tis '''s"):
        assert own(text) == theirs(library, text), repr(text[:60])


def test_random_texts_small_cache(library, monkeypatch):
    monkeypatch.setattr(t, "CACHE", 5)
    rng = random.Random(8)
    cutter = t.load(PATH)
    lengths = t.Lengths(t.table(["a", "the", "'s"], PATH), cutter.length)
    for _ in range(300):
        text = "".join(rng.choice("aabcdeTHthe fgh.'\n é0123ßΣỊ̇̇<|>") for _ in range(rng.randint(0, 300)))
        assert cutter.count(text, lengths.__getitem__) == theirs(library, text)
        assert len(lengths) <= 3 + 5


def test_query_against_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n := theirs(library, r.text), n > 2048) for r in docs)
    assert sorted(map(tuple, op13_token_counts(spark, sf).collect())) == want


def test_odd_rows_and_any_table(spark, library):
    rows = [(1, "Hello world", 1), (1, "Hello world", 2), (None, None, 3), (4, "", None), (5, "x " * 30000, 5), (6, "é" * 3000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = sorted(((a, len((b or "").encode()), n := theirs(library, b), n > 2048) for a, b, _ in rows), key=str)
    for known in (None, [], ["x", "hello", "never met"]):
        assert sorted(map(tuple, t.count_tokens(docs, PATH, known=known).collect()), key=str) == want
    assert t.count_tokens(docs.limit(0), PATH).count() == 0
    found = t.frequent(docs, most=3)
    assert len(found) <= 3 and "x" in found
