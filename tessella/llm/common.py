"""What the corpus operators share: shared scratch space, byte views of Arrow columns, word rules."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run without ASCII white space (fixed value); bytes.split() follows the same rule.
WORD = r"[^\x20\x09-\x0D]+"


#: Temporary folders of applications without spark.checkpoint.dir.
_OWN: dict[str, str] = {}
#: Frames that materialize returned, by identity, and their paths.
_WRITTEN: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='tessella-')}")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, and lets the write's
    shuffle files go at its end. codec: Parquet compression, the session's if not given."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out, lambda _, key=id(out): _WRITTEN.pop(key, None)), path)
    return out


def release(*frames: DataFrame) -> None:
    """Delete what materialize wrote for these frames; nothing that is still to run may read them."""
    for df in frames:
        known = _WRITTEN.pop(id(df), None)
        if known:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(known[1])
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def word_count(text: Column) -> Column:
    """Number of words; null text has none. JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df plus `name`, its rows' 0-based position in the given order, with no task that holds all rows.

    The rows are range-partitioned; only the row counts of the partitions meet in one task."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "rank")
    from pyspark.sql import Window as W

    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = placed.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return ranked.join(before, "_part").withColumn(name, F.col("_before") + F.col("_k") - 1).drop("_part", "_k", "_before")


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 (or binary) contents of an Arrow column as one uint8 array and n + 1 int64 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(wide) else "")
    n, at = len(column), column.offset
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named text column has about most_bytes in each piece; a longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(byte_view(batch.column(column))[1])
        group = (np.cumsum(lengths) - 1).clip(0) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def clash_free(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns alone, in order; other columns cannot clash with what an operator adds."""
    return df.select(*(F.col(f"`{c}`") for c in needed))


def with_fields(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    """schema without fields of the new names, then the new ones (name, DDL type)."""
    new = [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]
    return T.StructType([f for f in schema.fields if f.name not in {n for n, _ in fields}] + new)
