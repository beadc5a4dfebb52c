"""Shared plumbing of the corpus operators: shared storage, code shipping and batch helpers."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
import weakref
import zipfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whole-sequence white space of the corpus contracts: words are what lies between these.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: "weakref.WeakKeyDictionary" = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only on a ``local`` master, where driver and executors are one process, an unset folder is replaced by a temporary one; on a
    cluster that is an error, since executors would write to their own disks.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarrydf-"))
        configured = sc.getCheckpointDir()
    return configured.rstrip("/")


class Scratch:
    """The tables that one piece of work writes to the shared folder, so that they can be deleted when it is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        for around in (self, *_open.get()):
            around.paths.discard(path)

    def release(self, *keep: DataFrame) -> None:
        """Delete all of them but those of ``keep``."""
        kept = {getattr(df, "_quarrydf_path", None) for df in keep}
        for path in sorted(self.paths - kept):
            self._delete(path)


_open: "contextvars.ContextVar[tuple[Scratch, ...]]" = contextvars.ContextVar("quarrydf_scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession, *keep: DataFrame):
    """Tables that are written inside the block are deleted at its end, but for those that it hands to ``keep``. An operator
    leaves one narrow table at most, which its lazy result reads; whoever has used the result may delete that one by a block around it."""
    own = Scratch(spark)
    token = _open.set((*_open.get(), own))
    kept: list[DataFrame] = list(keep)
    own.keep = kept.append
    try:
        yield own
    finally:
        _open.reset(token)
        own.release(*kept)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/quarrydf/{name}-{uuid.uuid4().hex}"
    for around in _open.get():
        around.paths.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarrydf_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that no later plan reads."""
    path = getattr(df, "_quarrydf_path", None)
    if path:
        Scratch(df.sparkSession)._delete(path)


#: Texts can be long, so batches for Python workers are bounded by bytes. Spark's own bound is 64 MB, which a worker and its
#: executor each hold more than once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, whatever their working folder is, and bound their batches.

    The bound is a setting of the session, read when a plan runs, so it stays lowered in the session of the caller.
    """
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="quarrydf-code-"), "quarrydf_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("quarrydf", os.path.relpath(full, root)))
    sc.addPyFile(target)
    _shipped[sc] = target


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a missing one is an error that names the columns there are."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_of(name: str) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def slices(batches, rows: int = 64, sized: int | None = None, most: int = 0):
    """Record batches cut into runs of a few rows, so that Python objects exist for a few texts at a time; with ``sized``, the number of
    a binary column, a run holds at most ``most`` bytes of it, or one row."""
    for batch in batches:
        if sized is None:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            continue
        at = held = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(sized)), 0).to_pylist()):
            if i > at and (i - at == rows or held + size > most):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        if batch.num_rows:
            yield batch.slice(at)


def with_columns(batch: pa.RecordBatch, new: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    """``batch`` with more columns at its end."""
    schema = batch.schema
    for name, values in new:
        schema = schema.append(pa.field(name, values.type))
    return pa.RecordBatch.from_arrays([*batch.columns, *[v for _, v in new]], schema=schema)


def fresh(df: DataFrame, base: str, *also: str) -> str:
    """A column name that neither ``df`` nor ``also`` has."""
    name, taken = base, {c.lower() for c in (*df.columns, *also)}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A key that more than this part of all rows have is heavy: there are at most as many heavy keys, so they may be broadcast.
HEAVY = 4096


def attach(rows: DataFrame, table: DataFrame, key: list[str], total: int, count: str = "n") -> DataFrame:
    """The inner join of ``rows`` with a table of distinct keys that ``count`` of at most ``total`` rows have. Heavy keys, at most ``HEAVY``
    of them, are broadcast; of the others none has more than that part of all rows, so no task gets a hot key. Both sides are read twice."""
    heavy = F.col(count) > total / HEAVY
    met = rows.join(F.broadcast(table.filter(heavy)), key, "left")
    rest = met.filter(F.col(count).isNull()).select(*rows.columns).join(table.filter(~heavy), key)
    return met.filter(F.col(count).isNotNull()).unionByName(rest)
