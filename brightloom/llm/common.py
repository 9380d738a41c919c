"""What the operators of this subpackage share: reading, lineage cuts and text rules."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
import weakref
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but the six ASCII white space characters.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Lower-cases A-Z only.
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: Most bytes of a side that may be broadcast.
BROADCAST_BYTES = 32 << 20

_own_dirs: dict[str, str] = {}
_paths: dict[int, tuple] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a temporary folder, which goes at exit; on a cluster, whose
    machines don't share one, it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="brightloom-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, in parts for each value of a column if `by`: cuts the lineage and survives
    lost executors. Its rows are measured while they are written, which small_side asks for."""
    path = f"{scratch(df.sparkSession)}/brightloom/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.sum(_row_bytes(df)).alias("bytes")).write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    measured = seen.get
    _paths[id(out)] = weakref.ref(out, lambda _, key=id(out): _paths.pop(key, None)), path, (measured["bytes"] or 0) if "bytes" in measured else None
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Arrow batches of what runs have so many rows at most: those of long texts and sets take room in the
    executors and their Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame, part: str = "") -> None:
    """Removes written tables (or a part of each) that nothing reads any more, as all that was made of them is written itself."""
    for df in tables:
        ref, path, _ = _paths.get(id(df), (None, None, None))
        if ref is not None and ref() is df:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what is done: it does so once the driver has collected its garbage, which
    otherwise may be after all stages. The last plan is held for a moment, hence twice."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)
    spark.sparkContext._jvm.System.gc()


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        inner = 4 if isinstance(kind.elementType, T.IntegerType) else 8 if not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)) else 64
        return F.coalesce(F.size(value), F.lit(0)) * inner + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(value[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def _row_bytes(df: DataFrame) -> Column:
    return sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(24)).cast("long")


def small_side(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows take at most most_bytes, else as it is: then Spark shuffles both sides.

    df should be a written table, whose bytes are known; the rows of another are measured here.
    """
    ref, _, size = _paths.get(id(df), (None, None, None))
    if ref is None or ref() is not df or size is None:
        size = df.agg(F.sum(_row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def crc_fold_of(doc_id: object, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def text_id(column: str) -> Column:
    """A long as text, for the way through pandas, which has no null among whole numbers."""
    return F.col(column).cast("long").cast("string").alias(column)
