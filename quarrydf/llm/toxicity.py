"""Toxicity by a counterfactually regularised classifier.

A sparse logistic regression over the words that a text holds and over their first letters, so that inflected and compound
forms share what their stem teaches. Features are hashed, so the model's size is fixed and no word is left out. Every labelled text is paired with
a copy in which each identity term is swapped for another of its kind, and the squared change of the logit between the two is
part of the loss: a mention of a group must not move the score by which group it is. A text without such a term gets
one, picked by a hash of the text, in a further training row of the same label, so that all terms are seen with all labels.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrydf.llm import common
from quarrydf.llm.langid import held_out_part, words_of

#: Terms that name groups of people, by kind; each is swapped for the next one of its kind that is not in the text.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys", "transgender", "nonbinary"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"],
    ["gay", "lesbian", "straight", "bisexual", "queer"],
    ["black", "white", "asian", "latino", "arab", "indigenous"],
    ["african", "european", "american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish"],
    ["immigrant", "refugee", "citizen", "foreigner"],
    ["immigrants", "refugees", "citizens", "foreigners"],
    ["deaf", "blind", "disabled", "autistic"],
    ["old", "young", "elderly", "teenage"],
    ["femmes", "hommes", "filles"],
    ["musulmans", "chrétiens", "juifs", "athées"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "atheisten"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["musulmanes", "cristianos", "judíos", "ateos"],
]


def swapped(words: set[str], terms: list[list[str]] = IDENTITY_TERMS) -> set[str] | None:
    """The words with every identity term swapped; None if there is none."""
    out, found = set(words), False
    for kind in terms:
        for at, term in enumerate(kind):
            if term in words:
                found = True
                out.discard(term)
                other = next((kind[(at + k) % len(kind)] for k in range(1, len(kind)) if kind[(at + k) % len(kind)] not in words), None)
                if other:
                    out.add(other)
    return out if found else None


#: Lengths of the word starts that count as features of their own.
STARTS = range(4, 9)
#: Words whose features a worker keeps; and the longest of them.
CACHE, CACHED_CHARS = 200_000, 48


def features_of(words: set[str]) -> set[str]:
    """The words, and the starts of longer ones marked by a star."""
    return words | {w[:k] + "*" for w in words for k in STARTS if len(w) > k}


#: Features are told apart by a hash of this many values.
BUCKETS = 1 << 20


def bucket(feature: str) -> int:
    """The number of a feature."""
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def _buckets(features: set[str]) -> set[int]:
    return {bucket(f) for f in features}


def mention(text: str, terms: list[list[str]] = IDENTITY_TERMS) -> str | None:
    """The identity term that a text without one is given, the same for equal texts."""
    every = [t for kind in terms for t in kind]
    return every[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(every)] if every else None


@dataclass
class ToxicityModel:
    """Logit: ``bias`` plus the weights of the buckets that a text's features fall into. ``pairs``: counterfactual pairs that it was learned from."""

    bias: float
    weights: dict[int, float]
    pairs: int = 0

    def _weighty(self, word: str) -> tuple[int, ...]:
        return tuple(b for b in _buckets(features_of({word})) if b in self.weights)

    def score(self, text: str | None) -> float:
        """Between 0 and 1."""
        kept = self.__dict__.setdefault("_kept", {})
        found: set[int] = set()
        for word in set(words_of(text or "")):
            has = kept.get(word)
            if has is None:
                has = self._weighty(word)
                if len(word) <= CACHED_CHARS:
                    if len(kept) >= CACHE:
                        kept.clear()
                    kept[word] = has
            if has:
                found.update(has)
        z = self.bias + sum(self.weights[b] for b in sorted(found))
        return float(1.0 / (1.0 + np.exp(-max(-30.0, min(30.0, z)))))


class _Rows:
    """A sparse matrix of few entries a row, kept by rows and by columns; entries are 1 unless values are given."""

    def __init__(self, lists: list[np.ndarray], width: int, values: list[np.ndarray] | None = None):
        sizes = [len(x) for x in lists]
        columns = np.concatenate(lists).astype(np.int64) if sizes else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        entries = None if values is None else np.concatenate(values) if sizes else np.zeros(0)
        order = np.argsort(columns, kind="stable")
        self.by_row = self._side(rows, columns, entries, len(sizes))
        self.by_column = self._side(columns[order], rows[order], None if entries is None else entries[order], width)

    @staticmethod
    def _side(groups, others, entries, n):
        """Where groups that have entries begin, which these are, the other coordinate and the value of each entry, and the number of groups."""
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
        return starts, groups[starts], others, entries, n

    @staticmethod
    def _sums(side, by):
        starts, groups, others, entries, n = side
        out = np.zeros(n)
        if len(starts):
            out[groups] = np.add.reduceat(by[others] if entries is None else by[others] * entries, starts)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.by_row, w)

    def back(self, z: np.ndarray) -> np.ndarray:
        return self._sums(self.by_column, z)


def fit(labels, own, added, swap, sparsity: float = 0.001, pairing: float = 1.0, rounds: int = 400) -> ToxicityModel:
    """Accelerated proximal gradient on: class-balanced logistic loss + ``sparsity`` x absolute weights + ``pairing`` x mean
    squared logit change of the counterfactual pairs.

    For each row its label and arrays of buckets: ``own``; ``added`` by an identity term that is put in, if it has none of its own (that is
    a row of its own with the same label); and ``swap``, what the swapped text has in their place: (buckets lost, buckets won).
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(0.0 if not len(y) else float(4 * y[0] - 2), {})
    extra = np.array([i for i, a in enumerate(added) if len(a)], np.int64)
    y_all = np.r_[y, y[extra]]
    balance = np.where(y_all == 1, 0.5 / y_all.sum(), 0.5 / (len(y_all) - y_all.sum()))
    pairs = [i for i, s in enumerate(swap) if len(s[0]) or len(s[1])]
    # a bucket whose rows weigh no more than the sparsity can have no weight, so leaving it out changes nothing
    reach = np.bincount(np.concatenate(own), np.repeat(balance[: len(y)] + np.bincount(extra, balance[len(y) :], len(y)), [len(o) for o in own]), BUCKETS)
    paired = np.concatenate([np.zeros(0, np.int64), *[np.concatenate([added[i], *swap[i]]) for i in range(len(y))]])
    keep = reach > sparsity
    keep[paired] = True
    used = np.flatnonzero(keep)
    width, place = len(used), lambda b: np.searchsorted(used, b[keep[b]])
    x = _Rows([place(o) for o in own], width)
    more = _Rows([place(added[i]) for i in extra], width)
    change = _Rows([place(np.concatenate(swap[i])) for i in pairs], width, [np.r_[np.full(len(swap[i][0]), -1.0), np.full(len(swap[i][1]), 1.0)] for i in pairs])
    pull = 2 * pairing / max(1, len(pairs))

    def logits(w, b):
        z = x.times(w)
        return np.r_[z, z[extra] + more.times(w)] + b

    def gradient(off, w):
        of_rows = off[: len(y)].copy()
        np.add.at(of_rows, extra, off[len(y) :])
        return x.back(of_rows) + more.back(off[len(y) :]) + pull * change.back(change.times(w))

    # a bound on the curvature by power iteration gives the step
    v, v_bias, curve = np.full(width, 1 / np.sqrt(width + 1)), 1 / np.sqrt(width + 1), 1.0
    for _ in range(12):
        z = balance * logits(v, v_bias) / 4
        u, u_bias = gradient(z, v), float(z.sum())
        curve = float(np.sqrt(u @ u + u_bias * u_bias)) or 1.0
        v, v_bias = u / curve, u_bias / curve
    step = 1 / (1.2 * curve)
    w, b = np.zeros(width), 0.0
    w_ahead, b_ahead, t = w, b, 1.0
    for _ in range(rounds):
        off = balance * (1 / (1 + np.exp(-np.clip(logits(w_ahead, b_ahead), -30, 30))) - y_all)
        moved = w_ahead - step * gradient(off, w_ahead)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * sparsity, 0)
        new_b = b_ahead - step * float(off.sum())
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_ahead, b_ahead = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return ToxicityModel(float(b), {int(used[i]): float(w[i]) for i in np.flatnonzero(w)}, len(pairs))


def described(text: str, terms: list[list[str]] = IDENTITY_TERMS) -> tuple[list[int], list[int], list[int], list[int]]:
    """The buckets of one labelled text: own, added by an identity term that is put in, lost and won by the swap."""
    words = set(words_of(text))
    own, put_in = _buckets(features_of(words)), set()
    swap = swapped(words, terms)
    if swap is None:
        term = mention(text, terms)
        if term is None:
            return sorted(own), [], [], []
        words = words | set(words_of(term))
        put_in = _buckets(features_of(words)) - own
        swap = swapped(words, terms) or words
    here, there = _buckets(features_of(words)), _buckets(features_of(swap))
    return sorted(own), sorted(put_in), sorted(here - there), sorted(there - here)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", rows_per_class: int = 3000, terms: list[list[str]] = IDENTITY_TERMS, pairing: float = 1.0) -> ToxicityModel:
    """Fit a model on a bounded sample of the labelled rows.

    The documented bound: about ``rows_per_class`` labelled rows of each class, chosen by a hash of the id (all, if there are fewer); every
    word of their whole texts counts. Null labels and ids take no part; of repeated labels of an id the higher holds; ids that the documents
    repeat give a row each. Without two classes the model is constant.
    """
    spark = docs.sparkSession
    common.ship(spark)
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, min(1.0, rows_per_class / sizes.get(1, 1))).otherwise(min(1.0, rows_per_class / sizes.get(0, 1)))
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), common.text_of(text).alias("text"))
    # the sample's size is bounded by its parameter, so it may be broadcast, and its features collected
    sample = texts.join(F.broadcast(chosen), "id").select("y", "text")

    def number(batches):
        kind = pa.list_(pa.int32())
        for batch in common.slices(batches):
            found = [described(t, terms) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], kind) for k in range(4)]], ["y", "own", "added", "lost", "won"])

    rows = sample.mapInArrow(number, "y int, own array<int>, added array<int>, lost array<int>, won array<int>").toArrow()
    columns = [[np.asarray(v.values.to_numpy(), np.int64) for v in rows[c]] for c in ("own", "added", "lost", "won")]
    order = sorted(range(rows.num_rows), key=lambda i: (rows["y"][i].as_py(), columns[0][i].tobytes()))
    pick = lambda c: [c[i] for i in order]
    return fit([rows["y"][i].as_py() for i in order], pick(columns[0]), pick(columns[1]), list(zip(pick(columns[2]), pick(columns[3]))), pairing=pairing)


def score(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each whole text (0 to 1); null and empty texts get that of a text without words. Row by row, no shuffle; repeated
    rows get equal scores, an empty table stays empty. The model (at most ``BUCKETS`` weights) is broadcast. A column named ``out`` is replaced."""
    common.ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.score(t.as_py()) for t in texts], pa.float64())

    return df.withColumn(out, F.arrow_udf(run, "double")(F.col(f"`{text}`").cast("string")))


def learned_on_labels(spark, sf_dir, **options) -> ToxicityModel:
    """The model of the query: learned from labels outside the held-out third."""
    docs = common.only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    labels = common.only(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic")
    return learn(docs, labels.filter(~held_out_part("doc_id", 3, 1)), **options)


def op8_toxicity(spark, sf_dir):
    """Score every text of ``documents`` with a model learned from labels outside the held-out third."""
    docs = common.only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    held: Column = held_out_part("doc_id", 3, 1)
    scored = score(docs, learned_on_labels(spark, sf_dir)).drop("text")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
