r"""S4 for one large file: a JSON array of objects read by many tasks.

The text source cuts the file at every `}`, each split on its own.  Whether a
piece begins inside a string follows from the quotes before it, how deep it
lies from the braces outside strings before it, and which object it belongs to
from the objects that ended before it: three running sums, each taken inside a
split and carried over the splits by one small row for each.  An object's
pieces are joined again by their order.

A piece never begins inside an escape, as `\}` is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PLACE = ["file", "block"]


def _running(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over all pieces of the file before this one."""
    df = df.withColumn("_v", value.cast("long"))
    sums = df.groupBy(*_PLACE).agg(F.sum("_v").alias("_sum"))  # a row a split
    carried = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy(*_PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inside", inside).join(F.broadcast(carried), _PLACE).withColumn(out, F.col("_before") + F.col("_inside")) \
        .drop("_v", "_inside", "_before")


def _braces(segments: Column, first: int) -> Column:
    """Opening braces in every second segment, from `first` on."""
    picked = F.filter(segments, lambda _s, i: i % 2 == first)
    return F.aggregate(picked, F.lit(0), lambda n, s: n + F.length(s) - F.length(F.replace(s, F.lit("{"), F.lit(""))))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, json): the objects of each file's array, numbered from 0, as text.

    `spark.sql.files.maxPartitionBytes` sets the split size. A file that is no
    array of objects is an error when its rows are read.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    bare = F.regexp_replace("value", r'(?s)\\.', "")
    cut = F.split(bare, '"', -1)
    df = raw.repartition(*_PLACE).withColumns({"quotes": F.size(cut) - 1, "open_out": _braces(cut, 0), "open_in": _braces(cut, 1)})
    tail = df.groupBy("file").agg(F.max(F.struct("block", "at")).alias("end"))  # a row a file
    df = df.join(F.broadcast(tail), "file").withColumn("last", (F.col("end.block") == F.col("block")) & (F.col("end.at") == F.col("at"))).drop("end")
    df = _running(df, F.col("quotes"), "quotes_before")
    within = F.col("quotes_before") % 2 == 1
    closed = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0) & ~F.col("last")  # by the brace after the piece
    df = df.withColumn("closed", closed).withColumn("opened", F.when(within, F.col("open_in")).otherwise(F.col("open_out")))
    df = _running(df, F.col("opened") - F.col("closed").cast("int"), "depth")
    df = df.withColumn("done", F.col("closed") & (F.col("depth") + F.col("opened") == 1))
    df = _running(df, F.col("done"), "n")
    whole = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    objects = df.where(~F.col("last")).groupBy("file", "n").agg(F.array_join(F.transform(whole, lambda p: p["value"]), "}").alias("text"), F.max("done").alias("done"))
    lead = r"^\s*[\[,]?\s*(?=\{)"
    text = F.col("text")
    good = F.col("done") & F.when(F.col("n") == 0, text.rlike(r"^\s*\[\s*\{")).otherwise(text.rlike(r"^\s*,\s*\{"))
    wrong = F.raise_error(F.lit("Invalid format: expected an array"))
    objects = objects.select("file", "n", F.when(good, F.concat(F.regexp_replace(text, lead, ""), F.lit("}"))).otherwise(wrong).alias("json"))
    # what follows the last object ends the array; an empty array is that piece alone
    ends = df.where("last").select("file", "n", F.when(F.col("value").rlike(r"^\s*\]\s*$") & (F.col("n") > 0) | F.col("value").rlike(r"^\s*\[\s*\]\s*$") & (F.col("n") == 0),
                                                       F.lit(None)).otherwise(wrong).cast("string").alias("json"))
    return objects.unionByName(ends).where("json IS NOT NULL")
