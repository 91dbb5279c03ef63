"""Spark-side helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

#: Bytes up to which a side of a join may be broadcast, as estimated by ``row_bytes``.
BROADCAST_BYTES = 48 << 20


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or a new one where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            current = spark.sparkContext.getCheckpointDir()
        folder = current
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, column-pruned, safe from lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that no later plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def kept_apart(own: list[str], used: Iterable[str]) -> dict[str, str]:
    """A name for each own column under which it does not clash with the ``used`` ones."""
    used = {x.lower() for x in used}
    return {c: c if c.lower() not in used else f"__own{i}_{c}" for i, c in enumerate(own)}


def text_key(docs: DataFrame, *columns: str, first: Callable[..., Column] = F.xxhash64) -> Column:
    """A 64-bit key that rows of ``docs`` share only if they agree in ``columns``.

    Keys are hashes. Those that rows with different second hashes share (about three among 10**10
    rows) are looked for in one pass over both hashes, and their rows go by the second hash instead.
    """
    one, two = first(*columns), F.xxhash64(F.lit("second"), *columns)
    shared = docs.select(one.alias("one"), two.alias("two")).groupBy("one").agg((F.min("two") != F.max("two")).alias("differ")).where("differ")
    clashes = [r["one"] for r in shared.select("one").collect()]
    return F.when(one.isin(clashes), two).otherwise(one) if clashes else one


def row_bytes(schema: StructType) -> Column:
    """About how many bytes a row takes in a broadcast table; 32 bytes are taken for each string in an array."""
    total = F.lit(16 + 8 * len(schema))
    for field in schema:
        kind, c = field.dataType, F.col(field.name)
        if isinstance(kind, (StringType, BinaryType)):
            total += F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(kind, ArrayType):
            item = kind.elementType
            each = 16 + 8 * len(item) if isinstance(item, StructType) else 32 if isinstance(item, StringType) else 8
            total += 16 + each * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return total


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if a saved table has at most ``limit`` bytes; else leave the join to a shuffle."""
    n = df.agg(F.sum(row_bytes(df.schema).cast("long"))).first()[0] or 0
    return F.broadcast(df) if n <= limit else df
