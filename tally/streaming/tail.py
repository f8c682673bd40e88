"""Following the log: volumes kept current from a stream of moves.

Backdated entries are never dropped, so there is no watermark: each micro-batch adds its sums to a versioned table of
volumes, and a batch that is run again (after a failure) writes the version that it wrote before. It needs the one before
that, so two versions are kept and older ones deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tally.operators import book


def follow(moves: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps volumes under path/v=N, N being the number of micro-batches, until the source has no more now."""
    spark = moves.sparkSession

    def add(batch: DataFrame, n: int) -> None:
        now = book.account_volumes(batch)
        if n:
            now = spark.read.parquet(f"{path}/v={n - 1}").unionByName(now).groupBy(*book.KEY).agg(F.sum("input").alias("input"), F.sum("output").alias("output"))
        now.write.mode("overwrite").parquet(f"{path}/v={n}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={n - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return moves.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(moves: DataFrame, every: str = "30 days") -> DataFrame:
    """Moves and amounts per asset and window of insertion time; works on streams and tables."""
    at = F.window(F.col("insertion_date").cast("timestamp"), every)
    return moves.groupBy(at.alias("w"), "asset").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
