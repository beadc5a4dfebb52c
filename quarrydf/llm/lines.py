"""Line dedup, with DataFrame functions only: later copies of repeated line runs are deleted.

Every line position of every text starts a suffix of that text's line sequence. Distributed prefix doubling sorts these suffixes: a suffix's
rank by its first line is the number of suffixes that a sort of all lines puts before it; its rank by twice as many lines
comes from the pair (its rank, the rank of the suffix that many lines later), sorted and counted again. Pairs overlap where the wanted number of
lines is not a power of two. Sorting is distributed: distinct pairs go to ranges of the array, a window counts inside each range, and
the ranges' totals are added up (:func:`_numbered`). A suffix whose rank is unique is in no interval and is left out of the next round.

The suffixes that share a rank by k lines are an interval of the suffix array, from the rank on, as long as there are of them, whose longest
common prefix is at least k. In each interval of enough lines, or of enough words, the first suffix in document order
stays and the others' first k lines are deleted; overlapping deletions unite to the maximal repeated runs. Deeper rounds would order
suffixes inside these intervals, which moves none of their ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrydf.llm import common

#: Suffixes in one range of the array while ranks are counted.
RANGE = 1 << 16
#: A run of fewer lines than asked for is also deleted if it holds this many words.
MIN_WORDS = 51


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _needed(words: Column, min_lines: int, min_words: int | None) -> Column:
    """For each line the fewest lines, from there on, that are a run long enough: ``min_words`` words, or else ``min_lines`` lines."""

    def at_most(need, total, k):
        return F.zip_with(need, total, lambda n, t: F.when((n == min_lines) & (t >= min_words), k).otherwise(n))

    need = F.transform(words, lambda w: F.lit(min_lines))
    if min_words is None:
        return need
    total = words
    for k in range(1, min_lines):
        if k > 1:
            total = F.zip_with(total, F.slice(words, F.lit(k), F.size(words)), lambda a, b: a + F.coalesce(b, F.lit(0)))
        need = at_most(need, total, k)
    return need


def _read(df: DataFrame, text: str, doc_id: str, min_lines: int, min_words: int | None) -> DataFrame:
    """For each row its id, a digest of its text (``a``, ``b``), and for each line its name (``x``, ``y``) and what :func:`_needed` says."""
    body = common.text_of(text)
    cut = df.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(body).alias("a"), F.xxhash64(F.lit("text"), body).alias("b"), _lines(body).alias("lines"))
    words = F.transform("lines", lambda s: F.regexp_count(s, F.lit(common.WORD)))
    cut = cut.select("id", "a", "b", "lines", (words if min_words is not None else F.transform("lines", lambda s: F.lit(0))).alias("words"))
    cut = cut.select("id", "a", "b", "lines", _needed(F.col("words"), min_lines, min_words).alias("need"))
    names = F.zip_with("lines", "need", lambda s, n: F.struct(F.xxhash64(s).alias("x"), F.xxhash64(F.lit("line"), s).alias("y"), n.alias("need")))
    return cut.select("id", "a", "b", names.alias("names"))


def _place(no_id: Column, doc_id: Column, digest: Column) -> Column:
    """What documents are ordered by: id, null last, then the digest of the text."""
    return F.struct(no_id.alias("no_id"), doc_id.alias("id"), digest.alias("a"))


def _numbered(groups: DataFrame, key: list[str], spot: Column) -> DataFrame:
    """Groups of ``n`` suffixes with ``r``, the number of suffixes in the groups before them in the order of ``key``. ``spot`` never falls in that
    order and cuts it into ranges; only the totals of the ranges are added up in one task."""
    ranged = groups.withColumn("range", spot)
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("n").alias("total")).select("range", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("range").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counted.join(totals, "range").withColumn("r", (F.col("ahead") + F.col("before")).cast("long")).drop("range", "before", "ahead")


def _level(rows: DataFrame, key: list[str], spot: Column, total: int, name: str) -> DataFrame:
    """Suffixes (``no_id``, ``id``, ``a``, ``at``, ``need`` and the key) that share their key with others: with their rank ``r``, the number
    ``n`` that share it, and whether an earlier one does (``later``)."""
    place = F.struct(_place(F.col("no_id"), F.col("id"), F.col("a")).alias("doc"), F.col("at"))
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    ranks = common.materialize(_numbered(groups, key, spot), f"{name}-ranks")
    met = common.attach(rows, ranks, key, total)
    return common.materialize(met.select("no_id", "id", "a", "at", "need", "r", "n", (place != F.col("first")).alias("later")), name)


def suffix_ranks(texts: DataFrame, depths: list[int], total: int) -> dict[int, DataFrame]:
    """For each depth k the suffixes that share their first k lines with others: see :func:`_level`.

    texts: a written table of ``no_id``, ``id``, ``a`` and ``names``, distinct documents; depths: rising from 1, each at most twice one before;
    total: the number of lines. A depth's table holds only suffixes of at least that many lines.
    """
    rows = texts.select("no_id", "id", "a", F.posexplode("names").alias("at", "name")).select("no_id", "id", "a", "at", "name.need", "name.x", "name.y")
    bits = max(0, (max(1, total) // RANGE).bit_length())
    levels = {1: _level(rows, ["x", "y"], F.shiftright("x", 64 - bits) if bits else F.lit(0), total, "depth-1")}
    for k in depths[1:]:
        half = max(d for d in levels if d < k)
        if 2 * half < k:
            raise ValueError(f"no depth between {half} and {k}")
        after = Window.partitionBy("id", "a").orderBy("at").rangeBetween(k - half, k - half)
        pairs = levels[half].select("no_id", "id", "a", "at", "need", F.col("r").alias("r1"), F.col("n").alias("n1"), F.first("r").over(after).alias("r2"))
        pairs = common.materialize(pairs.filter("r2 IS NOT NULL"), "pairs")
        # a group of equal r1 takes the places from r1 to r1 + n1, in the order of r2
        spot = F.floor((F.col("r1") + F.col("n1") * (F.col("r2") / float(total))) / RANGE)
        levels[k] = _level(pairs, ["r1", "n1", "r2"], spot, total, f"depth-{k}")
    return levels


def _depths(min_lines: int, min_words: int | None) -> list[int]:
    """Powers of two up to ``min_lines``, and itself; all depths if runs of fewer lines may count for their words."""
    return list(range(1, min_lines + 1)) if min_words is not None else sorted({1 << i for i in range(min_lines.bit_length())} | {min_lines})


def _deletions(df: DataFrame, text: str, doc_id: str, min_lines: int, min_words: int | None) -> DataFrame:
    """``id``, ``a``, ``copy`` and ``spans``: for each document with something to delete, whether it is a later copy of a whole text, and else
    (first line, lines) of the runs to delete."""
    read = common.materialize(_read(df, text, doc_id, min_lines, min_words), "lines")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id")
    texts = read.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"), F.first("names").alias("names"))
    texts = common.materialize(texts.select("a", "b", "first.no_id", "first.id", "last", "n", "names"), "texts")
    size = texts.agg(F.sum(F.size("names")), F.sum("n")).first()
    levels = suffix_ranks(texts, _depths(min_lines, min_words), size[0] or 0)
    spans = None
    for k, level in levels.items():
        if k == min_lines or min_words is not None:
            found = level.filter(F.col("later") & (F.col("need") <= k)).select("id", "a", F.struct("at", F.lit(k).alias("k")).alias("span"))
            spans = found if spans is None else spans.unionByName(found)
    gone = spans.groupBy("id", "a").agg(F.collect_set("span").alias("spans"))
    several = texts.filter(F.struct("no_id", "id") != F.col("last")).select("a", "b", "n", F.col("no_id").alias("first_no"), F.col("id").alias("first_id"))
    others = common.attach(read.select("id", "a", "b"), several, ["a", "b"], size[1] or 0).filter(~F.col("id").eqNullSafe(F.col("first_id")))
    copies = others.select("id", "a").distinct().select("id", "a", F.lit(True).alias("copy"), F.lit(None).cast("array<struct<at: int, k: int>>").alias("spans"))
    return common.materialize(gone.select("id", "a", F.lit(False).alias("copy"), "spans").unionByName(copies), "deletions")


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = 3, min_words: int | None = MIN_WORDS, stats: bool = False) -> DataFrame:
    """``df`` with later copies of repeated runs of at least ``min_lines`` lines, or of at least ``min_words`` words, deleted from ``text``.

    Copies are searched within and across all documents. The first copy is the one with the smallest id (null last), then the smallest
    text digest, then the first line. Rows that repeat both id and text are one document: each is treated alike. Rows
    stay even if all their lines go (the text is then empty). Lines are what single line feeds separate, words what ASCII white space does; a null text
    counts as empty and comes back empty. An empty table gives an empty one. With ``min_words=None`` only lines count. With ``stats`` three columns follow:
    ``n_lines``, ``n_removed`` (long) and ``removed`` (array of (first, last) line numbers, from 0); they replace columns of these names, all others stay.

    Equal texts enter the suffix array once, whatever their number. Lines are told apart by 128-bit digests. Lines and pairs that very many
    suffixes share are counted by partial aggregates and joined by broadcast. One table, of what to delete, stays in the shared folder.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be positive")
    with common.scratch(df.sparkSession) as own:
        gone = _deletions(df, text, doc_id, min_lines, min_words)
        own.keep(gone)
    body = common.text_of(text)
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), body.alias("body"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(body).alias("a"))
    same = keyed["id"].eqNullSafe(gone["id"]) & (keyed["a"] == gone["a"])
    # a merge join whatever the sizes: how much there is to delete grows with the input, so it is never broadcast
    marked = keyed.join(gone.hint("merge"), same, "left").select("row", "body", "copy", "spans", _lines(F.col("body")).alias("lines"))
    # of a later copy of a whole text goes every run that is long enough
    words = F.when(F.col("copy"), F.transform("lines", lambda s: F.regexp_count(s, F.lit(common.WORD)))).otherwise(F.array().cast("array<int>"))
    marked = marked.select("row", "body", "spans", "lines", words.alias("words")).select("row", "body", "spans", "lines", _needed(F.col("words"), min_lines, min_words).alias("need"))
    upto = lambda at: F.least(F.lit(min_lines), F.size("lines") - at)
    whole = F.filter(F.transform("need", lambda need, at: F.struct(at.alias("at"), F.when(need <= upto(at), upto(at)).alias("k"))), lambda s: s["k"].isNotNull())
    runs = F.coalesce("spans", whole)
    covered = F.array_distinct(F.flatten(F.transform(runs, lambda s: F.sequence(s["at"], s["at"] + s["k"] - 1))))
    marked = marked.select("row", "body", "lines", F.coalesce(covered, F.array().cast("array<int>")).alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    clean = F.when(F.size("gone") == 0, F.col("body")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n"))
    extra = ["n_lines", "n_removed", "removed"] if stats else []
    out = [clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns if c.lower() not in extra]
    if stats:
        begins = F.array_sort(F.array_except("gone", F.transform("gone", lambda i: i + 1)))
        ends = F.array_sort(F.array_except("gone", F.transform("gone", lambda i: i - 1)))
        out += [F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last"))).alias("removed")]
    return marked.select(*out)


def op3_line_dedup(spark, sf_dir):
    """Delete later copies of runs of three or more lines, or of more than 50 words, from all ``documents``; a digest of each cleaned text."""
    docs = common.only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    done = dedup(docs, stats=True)
    runs = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return done.select("doc_id", "n_lines", "n_removed", runs.alias("removed"), F.sha2("text", 256).alias("text_sha256"))


OP3_SQL = """
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), windows AS (
  SELECT doc_id, p, k, ls[p + 1 : p + k] AS run
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS p FROM docs), (VALUES (1), (2), (3)) AS t(k)
  WHERE p + k <= len(ls)
), later AS (
  SELECT doc_id, p, k FROM windows
  WHERE k = 3 OR list_sum(list_transform(run, lambda s: len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')))) > 50
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, p) > 1
), gone AS (
  SELECT DISTINCT doc_id, CAST(unnest(range(p, p + k)) AS BIGINT) AS line FROM later
), islands AS (
  SELECT doc_id, min(line) AS first, max(line) AS last
  FROM (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM gone)
  GROUP BY doc_id, island
), runs AS (
  SELECT doc_id, sum(last - first + 1) AS n, string_agg(first || '-' || last, ',' ORDER BY first) AS removed FROM islands GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, string_agg(d.line, chr(10) ORDER BY d.i) AS text
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM docs) d
  ANTI JOIN gone g ON d.doc_id = g.doc_id AND d.i = g.line
  GROUP BY d.doc_id
)
SELECT docs.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       coalesce(removed, '') AS removed, sha256(coalesce(text, '')) AS text_sha256
FROM docs LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
