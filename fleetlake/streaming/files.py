"""Files that land in a folder, taken into a table once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.storage import upsert_bucketed


def take_in(spark: SparkSession, folder: str, schema: StructType | str, table: str, checkpoint: str, fmt: str = "json", ord: str | None = None) -> int:
    """Upsert all files of ``folder`` that were not taken in before into the bucketed table ``table``; returns how many rows they had.

    A file stream that ends when it has caught up: ``checkpoint`` remembers which files are done. Each
    micro-batch is one upsert; a batch that is repeated after a failure changes nothing more. Rows
    with equal keys in one batch go by ``ord``, without it by the file's time and then its name. Bad
    JSON lines have null columns; rows whose keys are all null are left out.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(folder)
    order = F.col(ord) if ord else F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start")
    stream = stream.select("*", order.alias("__ord"))
    keys = spark.read.json(f"{table}/_layout").first()["keys"]
    rows = 0

    def take(batch: DataFrame, _: int) -> None:
        nonlocal rows
        batch = batch.where(F.coalesce(*(F.col(k).cast("string") for k in keys)).isNotNull())
        rows += batch.count()
        upsert_bucketed(batch, table, "__ord")

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows
