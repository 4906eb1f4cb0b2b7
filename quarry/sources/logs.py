"""Log sources: text, gzip, csv and folders, with line numbers and byte offsets in file order."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import parse
from quarry.functions import patterns as P
from quarry.functions.parse import basename, epoch_ns_iso, once


class UnreadableLog(ValueError):
    """The input is empty, missing, binary or a broken archive."""


def number_lines(lines: DataFrame) -> DataFrame:
    """Add line_no, byte_off, total_bytes and head_no (the line of the event a line belongs to) per source.

    All four are counted within a split, in one pass over its lines, and moved by the splits' totals.
    """
    inner = parse.envelope(F.col("raw"))["inner"]
    head = once(inner, lambda x: (F.trim(x) != "") & ~parse.is_continuation(x))
    lines = lines.withColumns({"bytes": F.octet_length("raw") + 1, "is_head": head})
    inside = Window.partitionBy("source", "split").orderBy("seq")
    counted = lines.withColumns({"nth": F.row_number().over(inside), "upto": F.sum("bytes").over(inside)}).withColumn("last_head", F.max(F.when(F.col("is_head"), F.col("nth"))).over(inside))
    splits = counted.groupBy("source", "split").agg(F.max("nth").alias("c"), F.max("upto").alias("b"), F.max("last_head").alias("h"))
    before = Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = splits.withColumns({"c0": F.coalesce(F.sum("c").over(before), F.lit(0)), "b0": F.coalesce(F.sum("b").over(before), F.lit(0)), "total_bytes": F.sum("b").over(Window.partitionBy("source"))})
    starts = sums.withColumn("carry", F.max(F.col("c0") + F.col("h")).over(before)).select("source", "split", "c0", "b0", "total_bytes", "carry")
    out = counted.join(starts, ["source", "split"])
    return out.select(
        "source", (F.col("c0") + F.col("nth")).alias("line_no"), (F.col("b0") + F.col("upto") - F.col("bytes")).alias("byte_off"), "total_bytes", "raw",
        F.coalesce(F.col("c0") + F.col("last_head"), "carry").alias("head_no"),
    )


def _heads(spark: SparkSession, path: str, size: int = 8192) -> list[tuple[str, int, bytes]]:
    """(path, length, first bytes) of every file of a path, folder-free, or glob; only the first bytes are read, wherever the files are."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.globStatus(where) or [])
    if not found:
        raise UnreadableLog(f"{path}: missing")
    out = []
    for status in found:
        name = status.getPath().toString()
        if status.isDirectory():
            raise UnreadableLog(f"{name}: a folder, not a log")
        stream = fs.open(status.getPath())
        try:
            head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
        finally:
            stream.close()
        out.append((name, status.getLen(), head))
    return out


def _encoding(path: str, length: int, head: bytes) -> str | None:
    """Encoding by the first bytes; raises where they are no text."""
    if length == 0:
        raise UnreadableLog(f"{path}: empty")
    if path.endswith(".gz"):
        if head[:2] != b"\x1f\x8b":
            raise UnreadableLog(f"{path}: not gzip")
        try:
            head = zlib.decompressobj(31).decompress(head, 8192)
        except zlib.error as broken:
            raise UnreadableLog(f"{path}: broken gzip") from broken
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16LE" if head[:1] == b"\xff" else "UTF-16BE"
    shown = sum(32 <= b < 127 or b >= 128 or b in b"\t\n\r\f\x1b" for b in head)
    if b"\0" in head or shown < 0.75 * len(head):
        raise UnreadableLog(f"{path}: binary")
    return None


def probe(spark: SparkSession, path: str) -> tuple[str, int, str | None]:
    """(path, length, encoding) of one readable file."""
    (name, length, head), *_ = _heads(spark, path)
    return name, length, _encoding(name, length, head)


def read_lines(spark: SparkSession, path: str, encoding: str | None = None, longest: int = P.LONGEST_LINE) -> DataFrame:
    """Lines of text or gzip files, by path, list or glob. A split is one input block of one file; a source is a file, by its full path. Lines of over ``longest`` characters become pieces, each a line."""
    paths = [path] if isinstance(path, str) else list(path)
    kinds = {encoding or _encoding(name, length, head) for p in paths for name, length, head in _heads(spark, p)}
    if len(kinds) > 1:
        raise UnreadableLog(f"{path}: files of different encodings; read them apart")
    encoding = kinds.pop()
    reader = spark.read.option("encoding", encoding).option("lineSep", "\n") if encoding else spark.read
    # with an encoding, Spark splits lines by it but leaves the bytes as they are
    raw = F.regexp_replace(F.decode(F.col("value").cast("binary"), encoding), "^\ufeff|\r$", "") if encoding else F.regexp_replace("value", "^\ufeff", "")
    rows = reader.text(paths).select(raw.alias("raw"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("raw"), F.lit(1)), F.lit(longest))
    pieces = F.when(F.length("raw") > longest, F.transform(starts, lambda i: F.substring("raw", i, longest))).otherwise(F.array("raw"))
    rows = rows.select("source", "split", "id", F.posexplode(pieces).alias("piece", "raw")).withColumn("seq", F.struct("id", "piece")).drop("id", "piece")
    return number_lines(rows).withColumn("file", basename(F.col("source")))


def read_stdin(spark: SparkSession, stream, folder: str) -> DataFrame:
    """Lines of a stream, spooled to a file in a folder that all executors share."""
    path = f"{folder}/stdin-{uuid.uuid4().hex}.log"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        while piece := stream.read(1 << 20):
            out.write(piece)
    finally:
        out.close()
    return read_lines(spark, path)


def line_estimate(spark: SparkSession, path: str, size: int = 1 << 20) -> int:
    """Lines of a file, from those in its first bytes; gzip counts as it lies."""
    (_, length, head), *_ = _heads(spark, path, size)
    return round(head.count(b"\n") * length / max(1, len(head)))


def read_sources(frames: list[DataFrame], least: float = 0.5) -> DataFrame:
    """Chronological merge of several logs, each line tagged with its file, in ``seq``, the order of the input.

    Lines without a time take the last one of their source. Where at most ``least`` of all lines have
    a time, the logs follow each other as they are given.
    """
    out = frames[0].withColumn("nth", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("nth", F.lit(i)), allowMissingColumns=True)
    file = F.coalesce("file", basename(F.col("source"))) if "file" in out.columns else basename(F.col("source"))
    out = out.withColumn("ts", parse.time_value(parse.time_text(F.col("raw")))).withColumn("raw", F.concat("raw", F.lit(" src="), file))
    dated = out.agg(F.avg(F.col("ts").isNotNull().cast("int"))).first()[0] or 0
    return merged(out, "nth") if dated > least else out.withColumn("ts_filled", F.col("ts")).orderBy("nth", "source", "line_no")


def merged(lines: DataFrame, order: str = "source", run: int = 1 << 16) -> DataFrame:
    """In order of time, then ``order``. Times are carried over runs of lines, so that one log's lines come from many tasks."""
    dealt = lines.withColumn("run", F.expr(f"line_no div {run}"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    edges = dealt.groupBy("source", "run").agg(F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("last"))
    carry = edges.select("source", "run", F.last("last", ignorenulls=True).over(before).alias("carry"))
    inside = F.last("ts", ignorenulls=True).over(Window.partitionBy("source", "run").orderBy("line_no"))
    filled = dealt.withColumn("inside", inside).join(carry, ["source", "run"]).withColumn("ts_filled", F.coalesce("inside", "carry")).drop("run", "inside", "carry")
    return filled.orderBy(F.col("ts_filled").asc_nulls_first(), order, "line_no")


def read_csv_messages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """timestamp (ns), container_name, pod_name, message -> lines; blank messages go; a limit is the caller's."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).filter(F.trim("message") != "")
    line = F.concat_ws(" ", epoch_ns_iso(F.col("timestamp").cast("long")), F.concat(F.lit("service="), "container_name"), F.concat(F.lit("pod="), "pod_name"), "message")
    out = rows.select(line.alias("raw"), F.col("container_name").alias("svc"))
    return out.limit(limit) if limit else out


def find_logs(spark: SparkSession, folder: str, least_bytes: int = 0) -> DataFrame:
    """Log files under a folder, largest first."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.log").load(folder)
        .select("path", "length").filter(F.col("length") >= least_bytes).orderBy(F.col("length").desc(), "path")
    )
