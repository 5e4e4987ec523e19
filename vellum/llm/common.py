"""Helpers shared by the operators: written intermediate tables, column hygiene, order at scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.session import scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back: lineage ends at a stored table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: keys that `hot_join` broadcasts at most, and the least count of such a key
HOT_KEYS, HOT_ROWS = 1000, 256


def hot_join(many: DataFrame, one: DataFrame, key: str, total: int, count: str = "__n") -> DataFrame:
    """Inner join of `many` with `one`, which has a row for each key and in `count` the rows of `many` that hold it.

    Keys with at least a thousandth of the `total` rows of `many`, of which
    there are HOT_KEYS at most, are broadcast, so that none of them gathers its
    rows in one task; the others are shuffled. `count` is dropped.
    """
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot, rest = one.filter(F.col(count) >= least), one.filter(F.col(count) < least)
    left = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return many.join(F.broadcast(hot), key).unionByName(left).drop(count)


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` less the columns that an operator is about to add (compared as Spark does, ignoring case)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Range-partitioned written copy of a narrow table with its partition number as `part`.

    Order questions (running sums, next row) are then answered inside each part
    and carried across parts by one small row per part, so no task sees all rows.
    Nulls come first.
    """
    n = parts or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    return cut(ranged, name)


def running_start(df: DataFrame, order: list[str], weight: str, out: str) -> DataFrame:
    """Add `out`: the sum of `weight` over all rows before this one, for a table made by `in_order`."""
    w = Window.partitionBy("part").orderBy(*order)
    sums = df.groupBy("part").agg(F.sum(weight).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("part", before.alias("__before"))  # one row per part
    inside = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (df.withColumn("__inside", inside).join(F.broadcast(starts), "part")
            .withColumn(out, (F.col("__before") + F.col("__inside")).cast("long")).drop("__before", "__inside"))
