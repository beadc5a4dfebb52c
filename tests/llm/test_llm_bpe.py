import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from cases import ROWS, documents, table
from tokenizers import Tokenizer

from quarrydf.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def mine():
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    return bpe.PrefixBpe(spec), bpe.TokenTexts(spec)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(5)
    some = ["<|endoftext|>", "<|startoftext|>", "the", "ing", " ", "\n", "a", "I'LL", "ß</w>", "</w>", "<|", "İΣ", "\x1c", "\x85", "é", "é", "１", "²", "…", "it's", "--", "x×÷"]
    out = ["".join(rng.choice(some) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    ranges = [(1, 0x2FF), (0x300, 0xD7FF), (0xE000, 0xFFFF), (0x10000, 0x10FFFF)]
    out += ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(6)) for _ in range(3000)]
    plain = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x100), 9, 10, 13, 0x152, 0x153, 0x2019, 0x20AC, 0xBF]]
    out += ["x" + a + b + "9" for a in plain for b in plain]
    return out + ["", "a" * 5000, "the" * 2000, *[r[1] or "" for r in ROWS]]


def test_same_as_the_library(mine, library):
    some = texts()
    out, ends = bytearray(), [0]
    mine[0].encode_all(some, out, ends)
    ids = np.frombuffer(out, np.int32)
    for text, a, b, want in zip(some, ends, ends[1:], library.encode_batch(some, add_special_tokens=False)):
        assert ids[a:b].tolist() == want.ids, text[:80]
        assert mine[1].decode(ids[a:b]) == library.decode(want.ids, skip_special_tokens=False)


def test_small_caches_change_nothing(mine, monkeypatch):
    monkeypatch.setattr(mine[0]._pieces, "size", 3)
    words = [f"w{i}ords and thens" for i in range(50)] * 2
    assert [mine[0].encode(w) for w in words[:50]] == [mine[0].encode(w) for w in words[50:]]


def test_unknown_ids_are_passed_over(mine, library):
    assert mine[1].decode(np.array([320, -1, 10**6, 49407, 530], np.int32)) == library.decode([320, 49407, 530], skip_special_tokens=False)


def test_operators(spark, library):
    docs = documents(spark, ["IDS", "decoded"])
    encoded = bpe.encode(docs, PATH)
    assert sorted(c.lower() for c in encoded.columns) == sorted(c.lower() for c in docs.columns)
    assert {(r["text"] or "", tuple(r["ids"])) for r in encoded.collect()} == {(r[1] or "", tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS}
    back = bpe.decode(encoded, PATH)
    assert all(r["decoded"] == library.decode(list(r["ids"]), skip_special_tokens=False) for r in back.collect())
    assert bpe.encode_and_decode(docs.limit(0), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,), ([1, None],)], "ids array<int>"), PATH).filter("decoded IS NULL").count() == 0


def test_query(spark, library, tmp_path):
    folder = table(spark, tmp_path, documents=documents(spark, ["ids"]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op1_bpe(spark, folder).collect()), key=str) == sorted(want, key=str)
