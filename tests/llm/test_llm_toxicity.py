import math
import random
import time
import zlib

import numpy as np
import regex
from cases import ROWS, documents, table

from quarrydf.llm import toxicity


def test_held_out_accuracy(spark):
    """On the labelled documents that were not learned from: most toxic ones are found, few others."""
    sf = "/root/testdata/sf0.1"
    scored = toxicity.op8_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    hit = [r["predicted"] for r in rows if r["toxic"] == 1]
    false = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(hit) / len(hit) > 0.8 and sum(false) / len(false) < 0.03
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def gap(model):
    """The largest change of a neutral sentence's score by swapping the group that it mentions."""
    scores = [[model.score(f"{base} {term}") for term in kind] for kind in toxicity.IDENTITY_TERMS for base in ("", "the people said that they are", "elle parle avec les")]
    return max(max(s) - min(s) for s in scores)


def test_the_penalty_acts_in_the_model_of_the_query(spark):
    """Every labelled text gives a pair; with the penalty no neutral mention moves by more than the bound, without it some do."""
    sf = "/root/testdata/sf0.1"
    model = toxicity.learned_on_labels(spark, sf)
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert model.pairs == texts.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1").count()
    assert gap(model) < 0.0005 < gap(toxicity.learned_on_labels(spark, sf, pairing=0.0))


def test_identity_terms_do_not_move_the_score():
    """Labels that go with a group's mention: paired with swapped copies, the mention loses its weight."""
    rng = random.Random(0)
    labels, texts = [], []
    for _ in range(600):
        text = [f"w{chr(97 + rng.randrange(26))}" for _ in range(8)]
        toxic = rng.random() < 0.5
        if toxic and rng.random() < 0.7:
            text.append("idiot")
        if rng.random() < (0.8 if toxic else 0.1):
            text.append("muslim")
        elif rng.random() < 0.5:
            text.append(rng.choice(["christian", "jewish"]))
        labels.append(int(toxic))
        texts.append(" ".join(text))
    rows = [[np.array(x, np.int64) for x in toxicity.described(t)] for t in texts]
    model = lambda pairing: toxicity.fit(labels, [r[0] for r in rows], [r[1] for r in rows], [(r[2], r[3]) for r in rows], pairing=pairing)
    plain, paired = model(0.0), model(20.0)
    assert gap(plain) > 0.3 and gap(paired) < 0.25 * gap(plain)
    assert paired.score("you idiot") > 0.7 and paired.score("a muslim said") < 0.7


def test_screened_fit_is_the_whole_fit():
    """The weights are those of plain proximal gradient over all features, dense and unscreened."""
    rng = np.random.default_rng(2)
    n, f, sparsity = 40, 25, 0.05
    x = rng.random((n, f)) < 0.15
    y = (rng.random(n) < 0.3).astype(float)
    none = np.zeros(0, np.int64)
    model = toxicity.fit(y.astype(int).tolist(), [np.flatnonzero(r) for r in x], [none] * n, [(none, none)] * n, sparsity=sparsity, rounds=3000)
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, b, step = np.zeros(f), 0.0, 1.0 / (0.25 * np.linalg.norm(np.c_[x, np.ones(n)] * np.sqrt(balance)[:, None], 2) ** 2)
    for _ in range(60_000):
        off = balance * (1 / (1 + np.exp(-(x @ w + b))) - y)
        moved = w - step * (x.T @ off)
        w, b = np.sign(moved) * np.maximum(np.abs(moved) - step * sparsity, 0), b - step * off.sum()
    assert np.allclose([model.weights.get(i, 0.0) for i in range(f)], w, atol=1e-4) and abs(model.bias - b) < 1e-3


def test_query_against_brute_force(spark, sf):
    """Scores recomputed from the model's weights by the plain definition of features; long texts and repeats included."""
    model = toxicity.learned_on_labels(spark, sf)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = toxicity.op8_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = set(regex.findall(r"\p{L}+", texts[r["doc_id"]].lower()))
        features = words | {w[:k] + "*" for w in words for k in range(4, 9) if len(w) > k}
        z = model.bias + sum(model.weights.get(b, 0.0) for b in {zlib.crc32(f.encode()) % 2**20 for f in features})
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and r["predicted"] == (r["score"] >= 0.7)


def test_long_texts_take_linear_time():
    model = toxicity.ToxicityModel(0.0, {toxicity.bucket("idiot"): 3.0})

    def seconds(n):
        text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}z" for i in range(n)) + " idiot " + "q" * n
        began = time.perf_counter()
        assert model.score(text) > 0.9
        model.__dict__.pop("_kept")
        return time.perf_counter() - began

    short, long = (min(seconds(n) for _ in range(3)) for n in (50_000, 100_000))
    assert long < 3 * short + 0.1


def test_swapped():
    assert toxicity.swapped({"gay", "man"}) >= {"lesbian"} and "gay" not in toxicity.swapped({"gay"})
    assert toxicity.swapped({"nothing"}) is None


def test_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, "x"), (5, 1, "x"), (6, 0, "x"), (None, 1, "x"), (2, None, "x"), (7, 0, "x"), (7, 0, "x")], "doc_id long, toxic int, text string")
    folder = table(spark, tmp_path, documents=documents(spark, ["score", "toxic", "y"]), labels=labels)
    got = toxicity.op8_toxicity(spark, folder).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1


def test_without_labels(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none)
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).score("x") > 0.5
