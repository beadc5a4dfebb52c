import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from cases import ROWS, documents, table

from quarrydf.llm import langid


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = langid.op9_language_id(spark, sf).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(0)
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aba", "bb", "▁bab"]
    p = rng.random((len(pieces) + 1, 3))
    return langid.LanguageModel(["x", "y", "z"], pieces, p / p.sum(0))


def every_way(model, word, language):
    index = {p: i for i, p in enumerate(model.pieces)}
    word, total = "▁" + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(word[at:i])
                at = i
        if all(p in index or len(p) == 1 for p in parts):
            total += math.prod(model.probabilities[index.get(p, len(model.pieces)), language] for p in parts)
    return total


@pytest.mark.parametrize("word", ["a", "b", "ab", "abab", "babba", "aabbcab", "c", "ccc"])
def test_sums_all_segmentations(small, word):
    got = small.log_likelihood([word])
    assert np.allclose(np.exp(got), [every_way(small, word, k) for k in range(3)])
    small._ready()
    assert np.allclose(small._long(word), got)


def test_long_words_and_small_caches(small, monkeypatch):
    rng = random.Random(1)
    word = "".join(rng.choice("abc") for _ in range(60))
    assert np.allclose(small._block([word])[0], small._long(word))
    assert np.isfinite(small.log_likelihood(["ab" * 50_000])).all()
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    want = small.log_likelihood(words)
    monkeypatch.setattr(langid, "CACHE", 40)
    fresh = langid.LanguageModel(small.languages, small.pieces, small.probabilities)
    assert np.allclose(fresh.log_likelihood(words), want)


def test_expectation_improves_likelihood():
    words = {"a": Counter({"abab": 5, "aba": 3, "bab": 2, "ab": 9})}
    pieces = ["▁", "a", "b", "ab", "▁ab", "aba"]
    flat, fitted = langid.fit(words, pieces, rounds=0), langid.fit(words, pieces, rounds=6)
    bag = [w for w, n in words["a"].items() for _ in range(n)]
    assert fitted.log_likelihood(bag)[0] > flat.log_likelihood(bag)[0]


def test_learning_in_spark_is_learning_in_one_process(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").filter("doc_id % 4 = 0")
    pieces = ["▁", *"abcdefghijklmnopqrstuvwxyzéèêàçüöäßñáíóú", "▁de", "en", "er", "▁la", "ie", "qu", "sch"]
    counts = {}
    for r in docs.collect():
        if r["lang"] is not None:
            counts.setdefault(r["lang"], Counter()).update(langid.words_of(r["text"] or ""))
    want = langid.fit(counts, pieces)
    got = langid.learn(docs, pieces, docs_per_language=10**9)
    assert got.languages == want.languages and (got.probabilities == want.probabilities).all()


@pytest.mark.parametrize("word", ["abab", "aabbcab", "ab" * 12])
def test_shares_by_logs(small, word):
    small._ready()
    spans, prob = list(small._spans("▁" + word)), small.probabilities[:, 1].tolist()
    assert np.allclose(langid._spread(spans, len(word) + 1, prob), langid._spread_by_logs(spans, len(word) + 1, prob))


def test_a_very_long_word_is_learned_from():
    counts = {"a": Counter({"ab" * 4000: 1})}
    model = langid.fit(counts, ["▁", "a", "b", "ab", "c"], smoothing=1e-9)
    p = dict(zip(model.pieces, model.probabilities[:, 0]))
    assert p["ab"] + p["a"] + p["b"] > 0.99 and p["c"] < 1e-6


def test_query_against_brute_force(spark, sf):
    """The predictions from the model's probabilities alone: every word's segmentations summed by plain recursion."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learned_on_documents(docs.select("doc_id", "text", "lang"))
    index, top = {p: i for i, p in enumerate(model.pieces)}, max(map(len, model.pieces))
    none, known = len(model.pieces), {}

    def logs(word):
        ways = [np.ones(len(model.languages))]
        for end in range(1, len(word) + 1):
            parts = [(start, index.get(word[start:end], none if start == end - 1 else None)) for start in range(max(0, end - top), end)]
            ways.append(sum(ways[s] * model.probabilities[i] for s, i in parts if i is not None))
        return np.log(ways[-1])

    rows = {r["doc_id"]: r for r in langid.op9_language_id(spark, sf).collect()}
    for r in docs.filter("doc_id % 3 = 0").collect():
        words = regex.findall(r"\p{L}+", (r["text"] or "").lower())
        got = rows[r["doc_id"]]
        if not words:
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        for w in set(words) - set(known):
            known[w] = logs("▁" + w)
        total = sum(known[w] for w in words)
        assert got["lang_pred"] == model.languages[int(np.argmax(total))]
        assert abs(got["score"] - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_ties_go_to_the_first_by_name():
    model = langid.LanguageModel(["x", "y"], ["a"], np.full((2, 2), 0.5))
    assert model.judge(["aaa"]) == ("x", 0.5)


def test_names_of_its_own_may_be_taken(spark):
    names = ["unit", "__unit", "judged", "words", "piece"]
    df = documents(spark, names)
    got = langid.identify(df, langid.learn(df, ["▁", "a", "t"]))
    assert all(r[c] == "mine" for r in got.collect() for c in names)


def test_awkward_rows(spark, tmp_path):
    folder = table(spark, tmp_path, documents=documents(spark, ["score", "lang_pred", "judged", "word"]))
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.op9_language_id(spark, folder).collect()}
    found = {d: p for d, p in got if d is not None}
    assert {d for d, p in found.items() if p == "und"} == {2, 3, 4, 9}
    assert len(langid.op9_language_id(spark, folder).collect()) == len(ROWS)


def test_nothing_to_learn(spark):
    model = langid.learn(documents(spark).limit(0), ["a"])
    assert {r["lang_pred"] for r in langid.identify(documents(spark), model).collect()} == {"und"}
