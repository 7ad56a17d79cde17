"""Incremental access counters: exact counts by key, kept by Structured Streaming's state store.

Counters never expire, so there is no watermark: the state is one row a key. A replayed batch rewrites the same
totals, so a lost executor neither loses nor doubles an increment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.counters import DENYLIST, HEALTH_CHECKS, SCORE


def bucketed(requests: DataFrame) -> DataFrame:
    """``requests`` (ua, score, verified, key, kind) with the bucket that counts them; works on streams."""
    ua = F.lower(F.coalesce("ua", F.lit("")))
    any_of = lambda words: F.rlike(ua, F.lit("|".join("".join("\\" + c if c in ".|*+?()[]{}^$" else c for c in w) for w in words)))
    score = F.when(F.col("score") > 0, F.floor("score"))
    bot = any_of(HEALTH_CHECKS) | F.coalesce(F.col("verified"), F.lit(False)) | F.coalesce(score <= SCORE, F.lit(False)) | any_of(DENYLIST) | (F.trim(ua) == "")
    return requests.withColumn("bucket", F.when(bot, "bot").otherwise("human"))


def running(requests: DataFrame) -> DataFrame:
    """(key, kind, total, human, bot) so far."""
    return bucketed(requests).groupBy("key", "kind").agg(F.count("*").alias("total"), F.count(F.when(F.col("bucket") == "human", 1)).alias("human"), F.count(F.when(F.col("bucket") == "bot", 1)).alias("bot"))


def merged(totals: DataFrame, folder: str, batch: int, before: int | None) -> None:
    """Write the totals of all keys after a batch: those of ``totals``, and the older ones of keys that it lacks.

    ``folder``/<batch> holds the totals after that batch; a batch that is run again writes the same rows again.
    """
    spark = totals.sparkSession
    if before is not None:
        old = spark.read.parquet(f"{folder}/{before}")
        totals = totals.unionByName(old.join(totals.select("key", "kind"), ["key", "kind"], "left_anti"))
    totals.write.mode("overwrite").parquet(f"{folder}/{batch}")


def start(requests: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the totals of a stream of requests as tables below a shared folder, one a batch, written by executors.

    Only keys that a batch has changed come out of the state store. latest() reads the newest table.
    """

    def write(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        done = [b for b in batches(spark, folder) if b < batch]
        merged(changed, folder, batch, max(done, default=None))
        for b in done[:-1]:  # a batch may be run again, so the one before it stays
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{b}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return running(requests).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def batches(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose totals are complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, f"{n}/_SUCCESS")))


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """(key, kind, total, human, bot) after the last complete batch; no rows before the first one."""
    done = batches(spark, folder)
    empty = spark.createDataFrame([], "key string, kind string, total long, human long, bot long")
    return spark.read.parquet(f"{folder}/{done[-1]}") if done else empty
