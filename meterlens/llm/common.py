"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlens.session import estimated_bytes, shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A to Z (and nothing else) in lower case."""
    return F.translate(text, UPPER, UPPER.lower())


def parts_for(df: DataFrame, part_bytes: int = 64 << 20) -> int:
    """Partitions for a shuffle of all of ``df``: the session's, more if its files are large."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, -(-estimated_bytes(df) // part_bytes))


def running_base(counted: DataFrame, group: list[str], part: str, n: str, name: str) -> DataFrame:
    """Adds to per-partition counts the sum of ``n`` over the earlier partitions of each group."""
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn(name, F.coalesce(F.sum(n).over(before), F.lit(0)))


def part_bases(counted: DataFrame, part: str, n: str) -> dict[int, int]:
    """Rows before each partition. The driver holds one number per partition, not per row."""
    bases, total = {}, 0
    for row in counted.groupBy(part).agg(F.sum(n).alias("n")).orderBy(part).collect():
        bases[row[0]] = total
        total += row["n"]
    return bases


def drop_settled(df: DataFrame) -> None:
    """Delete the files of an intermediate table that ``settle`` wrote and nothing reads any more."""
    spark = df.sparkSession
    root = shared_folder(spark).rstrip("/")
    jvm = spark._jvm
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getName().startswith("meterlens-") and root.split(":", 1)[-1].lstrip("/") in path:
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def small_side(settled: DataFrame, rows: int = 1_000_000, file_bytes: int = 32 << 20) -> DataFrame:
    """A settled table, marked for broadcast if its own files and rows are few; else unmarked."""
    if estimated_bytes(settled) <= file_bytes and settled.count() <= rows:
        return F.broadcast(settled)
    return settled


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lanes_for_join(
    left: DataFrame, counted: DataFrame, key: str, row: Column, total: int,
    share: int = 1000, lanes: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``lane``, so that a join on (key, lane) splits hot keys.

    ``counted`` has one row per key, with ``n``, the rows of ``left`` that hold it. A key is
    hot if it holds more than one of ``share`` parts of the ``total`` rows, so fewer than
    ``share`` keys are, and those are broadcast. ``row`` deals the rows of a hot key, and
    those without a key, to its lanes; ``counted`` gets a copy of its hot rows per lane.
    """
    hot = F.col("n") * share > total
    few = F.broadcast(counted.filter(hot).select(F.col(key).alias("_hot")))
    dealt = F.when(
        F.col("_hot").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(row), F.lit(lanes)).cast("int")
    ).otherwise(0)
    return (
        left.join(few, F.col(key) == F.col("_hot"), "left").withColumn("lane", dealt).drop("_hot"),
        counted.withColumn("lane", F.explode(F.sequence(F.lit(0), F.when(hot, lanes - 1).otherwise(0)))),
    )
