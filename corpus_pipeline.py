"""A corpus pipeline over ``documents``: language ID, line dedup, near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. :func:`run` writes each result as Parquet to the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrydf.llm import bpe, common, langid, lines, mixing, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark, docs, sf_dir):
    """Documents in which no language is found (null texts, texts without a letter) go; all others stay as they are, repeated rows too.
    Columns beside those of ``documents`` are left out, here and in every stage; an empty table stays empty, here and in every stage."""
    docs = common.only(docs, *COLUMNS)
    judged = langid.identify(docs, langid.learned_on_documents(docs), lang_pred="__lang", score="__score")
    return judged.filter(F.col("__lang") != "und").select(*COLUMNS)


def line_dedup(spark, docs, sf_dir):
    """Later copies of runs of three or more lines, or of more than 50 words, are deleted from the texts; ``n_chars`` follows. Documents stay, even
    if empty; null texts come back empty; rows that repeat id and text are treated alike."""
    clean = lines.dedup(common.only(docs, *COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays, that with the smallest id (sets of five-word shingles, Jaccard similarity of exactly 0.8
    or more): SimHash links at three or fewer differing bits, then an exact check, then an exact way for the pairs that fingerprints miss. Null texts and texts without words are one group; of rows that repeat id and text one stays."""
    return simhash.one_of_each(common.only(docs, *COLUMNS))


def mix_sources(spark, docs, sf_dir):
    """Each document as often as the mix takes it: sources at weights 3, 1, 2, repeating, 150 % of all words, at most two epochs.
    Null sources are a source, the last one; null texts have no words; repeated rows are taken alike."""
    mixed = mixing.mix(common.only(docs, *COLUMNS), mixing.WEIGHTS)
    copies = F.explode(F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1), F.col("mix_copies"))))
    return mixed.withColumn("mix_copy", copies).select(*COLUMNS)


def encode(spark, docs, sf_dir):
    """The token ids of each text, their number, and a digest of what they decode to; null texts count as empty, repeated rows get equal ids."""
    import public_tokenizers

    both = bpe.encode_and_decode(common.only(docs, *COLUMNS), public_tokenizers.path("word_bpe_49k.json"))
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: SQL cannot express the learned, hashed and merged parts; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``. What a stage leaves in the shared folder is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with common.scratch(spark) as own:
            docs = common.materialize(stage(spark, before, sf_dir), f"stage-{name}")
            own.keep(docs)
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
