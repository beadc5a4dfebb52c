"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, found by a forward pass; a text's is the product over its words, and the languages are
compared by Bayes' rule with equal priors. Piece probabilities are learned by expectation maximisation: a forward and
a backward pass give each piece's expected count over all segmentations.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrydf.llm import common
from quarrydf.llm.automaton import Automaton

MAX_LANGUAGES = 500
#: Words longer than this take the rescaled pass; shorter ones are passed in blocks.
LONG = 64
#: Words that a worker keeps, and words passed at once: its memory is bounded.
CACHE, BLOCK = 200_000, 4096
_START = "▁"
_UNDEFINED = "und"


@cache
def _letters():
    import regex

    return regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """The runs of letters, lower-cased."""
    return _letters().findall(text.lower())


def load_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model that stand for text, in id order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class LanguageModel:
    """Piece probabilities by language, and the scoring of texts with them."""

    def __init__(self, languages: list[str], pieces: list[str], probabilities: np.ndarray):
        """probabilities: one row a piece, then one for any single character outside the vocabulary; one column a language."""
        self.languages, self.pieces = languages, pieces
        self.probabilities = probabilities

    def _index_pieces(self) -> None:
        n = len(self.pieces)
        self._index = {p: i for i, p in enumerate(self.pieces)}
        self._longest = max(map(len, self.pieces), default=1)
        self._unknown, self._none = n, n + 1

    def _ready(self) -> None:
        if hasattr(self, "_seen"):
            return
        self._index_pieces()
        size = np.array([len(p) for p in self.pieces] + [1, 1])
        #: The last row is for substrings that are no pieces. A constant for each character keeps products in range.
        self._scale = 30.0
        self._table = np.vstack([self.probabilities, np.zeros((1, len(self.languages)))]) * (self._scale ** size)[:, None]
        self._seen: dict[str, int] = {}
        self._logs = np.zeros((CACHE + 1, len(self.languages)))
        #: By state of the automaton, the pieces that end there and their lengths.
        self._automaton = Automaton([(p, (i, len(p))) for i, p in enumerate(self.pieces) if p])
        hits = self._automaton.hits
        self._hits = np.array([len(h) for h in hits], np.int32)
        self._ends = np.full((len(hits), max(1, int(self._hits.max()))), self._none, np.int32)
        self._sizes = np.ones_like(self._ends)
        for state, found in enumerate(hits):
            for k, (i, size) in enumerate(found):
                self._ends[state, k], self._sizes[state, k] = i, size

    def _spans(self, word: str):
        """(start, end, piece) of all pieces in the marked word, by end."""
        index, longest, none = self._index, self._longest, self._none
        n = len(word)
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                i = index.get(word[start:end], none)
                if i != none:
                    yield start, end, i
                elif start == end - 1:
                    yield start, end, self._unknown

    def _long(self, word: str) -> np.ndarray:
        """The forward pass of one long word, rescaled at every step."""
        index, table, longest = self._index, self._table, self._longest
        word = _START + word
        logs, ways = np.zeros(len(self.languages)), [np.ones(len(self.languages))]
        for end in range(1, len(word) + 1):
            total = np.zeros(len(self.languages))
            for back in range(1, min(longest, end, len(ways)) + 1):
                i = index.get(word[end - back : end])
                if i is None and back == 1:
                    i = self._unknown
                if i is not None:
                    total += ways[-back] * table[i]
            top = total.copy()
            logs += np.log(top)
            ways = [w / top for w in ways[len(ways) - min(len(ways), longest - 1) :]] + [total / top]
        return logs - len(word) * math.log(self._scale)

    def _block(self, words: list[str]) -> np.ndarray:
        """The forward pass of words of equal length; in sorted order neighbours share the states of their common start."""
        n, m = len(words[0]) + 1, len(words)
        states, unknown = np.zeros((n, m), np.int32), np.zeros((n, m), bool)
        path, before, step = [self._automaton.next(0, ord(_START))], "", self._automaton.next
        strange = {c for c in set().union(*words) if c not in self._index}
        unknown[0] = _START not in self._index
        for at, word in enumerate(words):
            same = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                same += 1
            del path[same + 1 :]
            for c in word[same:]:
                path.append(step(path[-1], ord(c)))
            states[:, at] = path
            before = word
            if strange:
                unknown[1:, at] = [c in strange for c in word]
        ways = np.ones((n + 1, m, len(self.languages)))
        for end in range(1, n + 1):
            total, here = np.zeros((m, len(self.languages))), states[end - 1]
            if unknown[end - 1].any():
                total += np.where(unknown[end - 1][:, None], ways[end - 1] * self._table[self._unknown], 0.0)
            count = self._hits[here]
            for k in range(int(count.max(initial=0))):
                rows = np.flatnonzero(count > k)
                at = here[rows]
                total[rows] += ways[end - self._sizes[at, k], rows] * self._table[self._ends[at, k]]
            ways[end] = total
        return np.log(np.maximum(ways[n], 1e-300)) - n * math.log(self._scale)

    def _learn_words(self, words: set[str]) -> None:
        """Score words that are not known yet; at most CACHE of them fit."""
        by_length = defaultdict(list)
        for w in sorted(words):
            by_length[len(w)].append(w)
        for n, group in by_length.items():
            for at in range(0, len(group), BLOCK):
                part = group[at : at + BLOCK]
                logs = self._block(part) if n <= LONG else np.array([self._long(w) for w in part])
                first = len(self._seen)
                self._logs[first : first + len(part)] = logs
                self._seen.update(zip(part, range(first, first + len(part))))

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """The sum over words of the log of the sum over segmentations; one number a language."""
        self._ready()
        total = np.zeros(len(self.languages))
        for at in range(0, len(words), CACHE // 2):
            part = words[at : at + CACHE // 2]
            new = {w for w in part if w not in self._seen}
            if new:
                if len(self._seen) + len(new) > CACHE:
                    self._seen.clear()
                    new = set(part)
                self._learn_words(new)
            seen = self._seen
            total += self._logs[[seen[w] for w in part]].sum(0)
        return total

    def prepare(self, texts: list[list[str]]) -> None:
        """Score the new words of many texts at once, as far as they fit."""
        self._ready()
        new = {w for words in texts for w in words if w not in self._seen}
        if new and len(self._seen) + len(new) > CACHE:
            self._seen.clear()
            new = {w for words in texts for w in words}
        if len(new) <= CACHE:
            self._learn_words(new)

    def judge(self, words: list[str]) -> tuple[str, float]:
        """The most likely language and its posterior probability; equal ones: the first by name."""
        if not words or not self.languages:
            return _UNDEFINED, 0.0
        logs = self.log_likelihood(words)
        best = int(np.argmax(logs))
        return self.languages[best], float(1.0 / np.exp(logs - logs[best]).sum())


#: Expected counts are added up as whole numbers of this part, so that sums do not depend on their order.
_PART = 1 << 24


def _spread(spans: list[tuple[int, int, int]], n: int, prob: list[float]) -> list[float]:
    """The share of all segmentations' probability that goes through each span of one text of ``n`` characters."""
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    forward[0] = backward[n] = 1.0
    for s, e, i in spans:
        forward[e] += forward[s] * prob[i]
    if not 1e-280 < forward[n] < 1e280:
        return _spread_by_logs(spans, n, prob)
    out = [0.0] * len(spans)
    for k in range(len(spans) - 1, -1, -1):
        s, e, i = spans[k]
        way = prob[i] * backward[e]
        backward[s] += way
        out[k] = forward[s] * way / forward[n]
    return out


def _spread_by_logs(spans, n: int, prob: list[float]) -> list[float]:
    """The same for texts so long that products leave the range of a float."""

    def more(a, b):
        return max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf < b else max(a, b)

    logs = {i: math.log(prob[i]) for _, _, i in spans}
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0] = backward[n] = 0.0
    for s, e, i in spans:
        forward[e] = more(forward[e], forward[s] + logs[i])
    out = [0.0] * len(spans)
    for k in range(len(spans) - 1, -1, -1):
        s, e, i = spans[k]
        way = logs[i] + backward[e]
        backward[s] = more(backward[s], way)
        out[k] = math.exp(min(0.0, forward[s] + way - forward[n]))
    return out


def expected(words, blank: "LanguageModel", probabilities: np.ndarray | None) -> Counter:
    """Expected counts of (language, piece), in units of ``1 / _PART``, over all segmentations of (language number, word, count); every
    piece that fits counts once if there are no probabilities yet."""
    out: Counter = Counter()
    columns = None if probabilities is None else [column.tolist() for column in probabilities.T]
    for language, word, count in words:
        spans = list(blank._spans(_START + word))
        shares = [1.0] * len(spans) if columns is None else _spread(spans, len(word) + 1, columns[language])
        for (_, _, i), share in zip(spans, shares):
            out[language, i] += round(share * count * _PART)
    return out


def _normalised(counts: np.ndarray, smoothing: float) -> np.ndarray:
    p = counts / _PART + smoothing
    return p / p.sum(0)


def fit(counts: dict[str, Counter], pieces: list[str], rounds: int = 2, smoothing: float = 0.05) -> LanguageModel:
    """Learn piece probabilities from word counts by language, in one process."""
    languages = sorted(counts)
    blank, p = LanguageModel(languages, pieces, np.ones((len(pieces) + 1, len(languages)))), None
    blank._index_pieces()
    for _ in range(rounds + 1):
        found = np.zeros((len(pieces) + 1, len(languages)))
        for (k, i), n in expected(((k, w, n) for k, x in enumerate(languages) for w, n in counts[x].items()), blank, p).items():
            found[i, k] = n
        p = _normalised(found, smoothing)
    return LanguageModel(languages, pieces, p)


def learn(df: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_per_language: int = 300, rounds: int = 2, smoothing: float = 0.05) -> LanguageModel:
    """Fit a model on a bounded sample of the rows of ``df`` whose ``lang`` is not null.

    The documented bound: each language gives about ``docs_per_language`` rows (chosen by a hash of the text and the row
    id, where there is one, so reruns agree; all rows if there are fewer), and of these every word of the whole texts. Words are counted, and the
    expected counts of pieces found and added up, in Spark; what comes to the driver is one number a piece and language, as many as the model has. At
    most ``MAX_LANGUAGES`` languages are learned, since the model is broadcast; more are an
    error. Null texts count as empty. An empty table gives a model without languages, which finds every text undefined.
    """
    spark = df.sparkSession
    common.ship(spark)
    known = [F.col(f"`{c}`").cast("string") for c in df.columns if c.lower() in (doc_id.lower(), text.lower())]
    unit = F.pmod(F.xxhash64(*known), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), common.text_of(text).alias("text"), unit.alias("unit")).filter("lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return fit({}, pieces)
    languages = sorted(sizes)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, docs_per_language / sizes[k])))])
    number = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    chosen = rows.filter(F.col("unit") < share[F.col("lang")]).select(number[F.col("lang")].alias("lang"), "text")

    def tally(batches):
        for batch in common.slices(batches):
            found = Counter()
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((language, w) for w in words_of(body))
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    with common.scratch(spark):
        counted = common.materialize(chosen.mapInArrow(tally, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
        p = None
        for _ in range(rounds + 1):
            shared = spark.sparkContext.broadcast((languages, pieces, p))

            def count(batches, shared=shared):
                own = LanguageModel(shared.value[0], shared.value[1], np.ones((0, 0)))
                own._index_pieces()
                for batch in batches:
                    found = expected(zip(*[batch.column(i).to_pylist() for i in range(3)]), own, shared.value[2])
                    keys = list(found)
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(found.values()), pa.int64())], ["lang", "piece", "n"])

            # one task a core would hold too many rows of one batch: words are dealt out by their hash
            summed = counted.repartition("lang", "word").mapInArrow(count, "lang int, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
            found = np.zeros((len(pieces) + 1, len(languages)))
            found[summed["piece"].to_numpy(), summed["lang"].to_numpy()] = summed["n"].to_numpy()
            p = _normalised(found, smoothing)
            shared.destroy()
    return LanguageModel(languages, pieces, p)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its posterior probability (0 to 1).

    ``und`` with score 0 for null texts and texts without a letter. Only the text is read; whole texts of any length;
    row by row, no shuffle; repeated rows get equal results, languages that are equally likely the first by name. The model is broadcast; its size is that of the vocabulary times the languages. Columns
    named like the results are replaced.
    """
    spark = df.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        m, langs, scores = shared.value, [], []
        for at in range(0, len(texts), 256):
            cut = [words_of(t or "") for t in texts.slice(at, 256).to_pylist()]
            if m.languages:
                m.prepare(cut)
            for words in cut:
                found, p = m.judge(words)
                langs.append(found)
                scores.append(p)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    held = common.fresh(df, "judged")
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (lang_pred.lower(), score.lower())]
    judged = df.withColumn(held, F.arrow_udf(run, "struct<lang_pred: string, score: double>")(F.col(f"`{text}`").cast("string")))
    return judged.select(*keep, F.col(f"{held}.lang_pred").alias(lang_pred), F.col(f"{held}.score").alias(score))


def held_out_part(doc_id: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % modulus == rest


def learned_on_documents(docs: DataFrame) -> LanguageModel:
    """The model of the query and the pipeline: learned on documents outside the held-out quarter."""
    import public_tokenizers

    return learn(docs.filter(~held_out_part("doc_id", 4, 2)), load_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op9_language_id(spark, sf_dir):
    """Predict the language of every text of ``documents``."""
    docs = common.only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learned_on_documents(docs))
    return found.select("doc_id", held_out_part("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
