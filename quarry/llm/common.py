"""Expressions shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: runs of ASCII characters other than 0-9 and a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that results don't depend on Unicode tables."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


#: Bytes that separate words become spaces; those of characters beyond ASCII all belong to words.
GAP_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else 0x20 for b in range(256))


def split_words(text: str) -> list[bytes]:
    """The same words, in Python."""
    return text.encode("utf-8", "surrogatepass").lower().translate(GAP_BYTES).split()


def regex_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as array<struct<start,end,found>>, code points, end exclusive.

    Positions follow from the lengths of the pieces between matches. ``found`` is the given group.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("gap"), whole.alias("whole"), part.alias("part"))
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["part"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    return F.when(F.size(whole) > 0, F.aggregate(parts, start, step)["spans"]).otherwise(empty)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a session on one machine may go without: it gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"{tempfile.gettempdir()}/quarry-checkpoints"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove what an operator wrote and no longer needs, wherever Spark keeps it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as what they were made for is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def spread(frame: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Dealt by ``keys`` to more tasks than the session's setting where the input asks for more; Spark then needs no further shuffle by them."""
    return frame.repartition(tasks, *keys) if tasks > int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) else frame
