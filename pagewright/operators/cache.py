"""The store of translations: 256 shards by key, latest entry of a key wins.

Writing replaces only the shards that change, merged with what they hold; a shard that cannot be read is as one that is
empty. Writers of one store take turns: use it in foreachBatch or one batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text as T
from ..schemas import CACHE
from ..session import cut


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries with a translation; an empty frame where there is no store."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], CACHE)
    rows = spark.read.schema(CACHE).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)
    return rows.where("translation <> ''")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of shards in the older form: one JSON object a file, keys to {zh, t}. Unreadable files hold nothing."""
    maps = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<zh:string, t:bigint>>").alias("m"))
    rows = maps.select(F.explode("m").alias("key", "e")).where("e.zh <> ''")
    return rows.select("key", F.col("e.zh").alias("translation"), F.timestamp_millis("e.t").alias("t"), keys.shard(F.col("key")).alias("shard"))


def merged(held: DataFrame, new: DataFrame) -> DataFrame:
    """The latest entry of each key; of entries of one time the greatest text, so that repeated runs agree."""
    new = new.where((F.col("key") != "") & (T.trim_blanks(F.col("translation")) != "")).select("key", "translation", "t", keys.shard(F.col("key")).alias("shard"))
    rows = held.select("key", "translation", "t", "shard").unionByName(new)
    return rows.groupBy("key", "shard").agg(F.max(F.struct("t", "translation")).alias("e")).select("key", "e.translation", "e.t", "shard")


def upsert(new: DataFrame, path: str) -> None:
    """Merge new(key, translation, t) into a store; shards without new keys are neither read nor written."""
    spark = new.sparkSession
    held = read(spark, path)
    touched = new.select(keys.shard(F.col("key")).alias("shard")).distinct()  # 256 at most
    shards = [r.shard for r in touched.collect()]
    # what is read must be held before its place is written: on shared storage, so that a lost executor loses nothing
    rows = cut(merged(held.where(F.col("shard").isin(shards)), new))
    rows.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    """Drop a store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def split(keyed: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in the store, with their translation, and the others."""
    held = store.select("key", "translation")
    return keyed.join(held, "key"), keyed.join(held, "key", "left_anti")
