import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkfolio.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    return bpe.load(PATH), Tokenizer.from_file(PATH)


def same(pair, text):
    own, their = pair
    ids = their.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, repr(text[:80])
    assert own.decode(ids) == their.decode(ids, skip_special_tokens=False)


def test_every_character_and_hard_texts(pair):
    for start in range(0, 0x20000, 64):
        same(pair, " ".join("x" + chr(c) + "1 " + chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000))
    for text in ("", " ", "\n\n  a", "it's I'LL we've", "a<|endoftext|>b<|endoftext|>", "<|endoftext|", "a" * 5000,
                 "ab" * 3000 + " x", "\x1c\x1d \x85 ", "日本語" * 200, "é 🙂🙂", "  \t\r\n  end  "):
        same(pair, text)


def test_random_texts_and_both_merges(pair):
    rng = random.Random(5)
    letters = "aabbcde fgh.'\n é0123ßQ<|>"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        same(pair, text)
        word = text.replace(" ", "").encode()
        assert pair[0].merge_short(word) == pair[0].merge_long(word)


def test_query_shape(spark, pair):
    rows = [(1, "Hello world", 1), (1, "Hello world", 2), (None, None, 3), (4, "", None), (5, "x " * 20000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    assert bpe.round_trip(docs, PATH).count() == 5
    assert got[None].n_tokens == 0 and got[4].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(b"Hello world").hexdigest()
    ids = [r.ids for r in bpe.encode(docs, PATH).filter("doc_id = 1").collect()]
    assert ids == [pair[1].encode("Hello world").ids] * 2
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
