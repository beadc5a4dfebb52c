"""Documents with every awkward case, and helpers."""

from pyspark.sql import functions as F

BODY = "The cat sat on the mat and looked.\nIt was a fine day for it.\nThen came the rain.\nNobody minded much."
LONG = " ".join(f"word{i % 977} and more" for i in range(40_000))
#: doc_id, text, lang, source, n_chars
ROWS = [
    (1, BODY, "en", "s0", len(BODY)),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, " \t\n \r", "fr", None, 5),
    (5, BODY, "en", "s0", len(BODY)),
    (5, BODY, "en", "s0", len(BODY)),
    (None, "a text without an id", "en", "s2", 20),
    (None, None, None, "s0", None),
    (6, LONG, "en", "s0", len(LONG)),
    (7, "x" * 100_000, None, "s1", 100_000),
    (8, "Ünïcödé ٣ 😀 <|endoftext|> İΣ don't", "de", "", 30),
    (9, "123 456 +++ ...", "en", "s1", 15),
    (10, "The cat sat on the mat and looked.\nSomething else.\n" + BODY, "en", "s9", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, clash=()):
    """The rows, with further columns of these names."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for c in clash:
        df = df.withColumn(c, F.lit("mine"))
    return df


def write(df, path):
    df.write.parquet(str(path))
    return str(path)


def table(spark, folder, **tables):
    """A folder of tables as the queries read them."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
