"""Secret scans [native]: candidates told apart by who owns them, corpus-wide.

Texts are scanned once; what is found is stored without them. Every candidate's value is hashed and
aggregated by distinct owners (groups of near copies of a text, whatever their ids) and repositories
(the least ``source`` of each owner). A key that works has one owner, or two where a person or a fork
holds it too; what stands in texts of more owners, or in more than one repository though the texts
aren't copies of each other, is an example that people copy. So values of more than ``max_repos``
repositories or ``max_owners`` owners are taken for examples; the others look live. The three base
kinds are always reported; the provider formats of ``MORE`` only where they look live.

Defined cases: null text is empty and has no spans; a null source is one repository; repeated rows
and copies of a text count as one owner and give repeated rows; spans of equal start go by kind;
very long texts are scanned whole; empty tables give empty ones; extra columns are ignored, and kept
by ``redact``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint_dir, regex_spans, words

#: Fixed values. kind, pattern, group with the value, least characters of it
BASE = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: A whole key block. The value is what follows the header up to END or, where a key is cut off, to the end of its base64 lines.
PRIVATE = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----("
    r"[^-]*+(?:-(?!----)[^-]*+){0,99}+(?=-----END [A-Z ]*PRIVATE KEY-----)"
    r"|(?:(?:\s|\\[nr])*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+){0,9}+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{24,}+){0,2000}+"
    r"(?:(?<=[A-Za-z0-9+/=]{24})(?:\s|\\[nr])++[A-Za-z0-9+/]{1,23}+={0,2}+(?=[\x20\t\"']*+(?:\r|\n|\\[nr]|$)))?+"
    r")(?:-----END [A-Z ]*PRIVATE KEY-----)?+"
)
MORE = (
    ("forge", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("private", PRIVATE, 1, 0),
)
#: Line ends within a key, as they are or escaped in a string; copies of one key differ in them.
LINE_ENDS = r"\\[nrt]|\s+"


#: Texts with four fifths of their shingles in common share one of so many bands but for one pair in a thousand.
BANDS = 8
KEY, SPANS = "secrets_row_key", "secrets_row_spans"


def _found(text: Column, gate: Column, pattern: str, group: int, least: int, kind: str, nth: int) -> Column:
    spans = F.filter(regex_spans(text, pattern, group), lambda x: F.length(x["found"]) >= least)
    value = lambda x: F.regexp_replace(x["found"], LINE_ENDS, "") if kind == "private" else x["found"]
    row = lambda x: F.struct(x["start"].alias("start"), F.lit(nth).alias("nth"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.md5(value(x)).alias("value"))
    none = F.array().cast("array<struct<start:int,nth:int,end:int,kind:string,value:string>>")
    return F.when(gate, F.transform(spans, row)).otherwise(none)


def _bands(text: Column) -> Column:
    """Hashes that near copies share: of pairs of minima over the shingles of five words."""
    def of(w: Column) -> Column:
        shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 5)))
        least = lambda h, k: F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(k))))
        return F.transform(F.array(shingles), lambda h: F.array(*[F.xxhash64(F.lit(k), least(h, 2 * k), least(h, 2 * k + 1)) for k in range(BANDS)]))

    return F.flatten(F.flatten(F.transform(F.array(words(text)), of)))


def row_key() -> Column:
    """Names rows of one id, source and text."""
    return F.md5(F.concat(F.to_json(F.struct("doc_id", "source")), F.coalesce("text", F.lit(""))))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (of equal rows), copy (of equal texts), bands of texts with spans, spans ordered by start, then kind; stored."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    each = [_found(text, F.col("text").rlike(p), p, g, n, kind, i) for i, (kind, p, g, n) in enumerate(BASE + MORE)]
    out = docs.select("doc_id", "source", "text", row_key().alias("key"), F.array_sort(F.concat(*each)).alias("spans"))
    some = F.size("spans") > 0
    out = out.withColumns({"copy": F.when(some, F.md5("text")), "bands": F.when(some, _bands(F.col("text")))}).drop("text")
    path = f"{checkpoint_dir(spark)}/candidates-{uuid.uuid4().hex}"
    out.write.parquet(path)
    return spark.read.parquet(path)


def ownership(found: DataFrame) -> DataFrame:
    """value -> repos, owners. An owner is a group of near copies, found by two rounds of the least name over shared bands; its repository is the least."""
    seen = found.filter(F.size("spans") > 0).select("copy", "source", "bands", F.explode(F.array_distinct(F.transform("spans", lambda x: x["value"]))).alias("value"))
    texts = seen.groupBy("value", "copy").agg(F.min("source").alias("source"), F.first("bands").alias("bands"))
    links = texts.select("value", "copy", "source", F.explode("bands").alias("band"), F.col("copy").alias("owner"))
    for _ in range(2):
        least = links.groupBy(F.col("value").alias("v"), F.col("band").alias("b")).agg(F.min("owner").alias("least"))
        near = links.join(least, (F.col("value") == F.col("v")) & (F.col("band") == F.col("b")))
        named = near.groupBy("value", "copy").agg(F.min("least").alias("owner"), F.first("source").alias("source"), F.collect_set("band").alias("bands"))
        links = named.select("value", "copy", "source", "owner", F.explode("bands").alias("band"))
    owners = named.groupBy("value", "owner").agg(F.min("source").alias("source"))
    repos = owners.groupBy("value", "source").agg(F.count(F.lit(1)).alias("owners"))
    return repos.groupBy("value").agg(F.sum("owners").alias("owners"), F.count(F.lit(1)).alias("repos"))


def scan(docs: DataFrame, max_repos: int = 1, max_owners: int = 2) -> DataFrame:
    """Per row: doc_id, spans (all reported), n_live, n_example."""
    found = candidates(docs)
    live = ownership(found).filter((F.col("repos") <= max_repos) & (F.col("owners") <= max_owners)).select("value")
    # A live value has few owners, so what is joined is small and even on both sides; the rest never meets it.
    hits = (
        found.select("key", F.explode(F.array_distinct(F.transform("spans", lambda x: x["value"]))).alias("value"))
        .join(live, "value", "left_semi")
        .groupBy("key").agg(F.collect_set("value").alias("live"))
    )
    live = F.coalesce("live", F.array().cast("array<string>"))
    kept = F.filter("spans", lambda x: (x["nth"] < len(BASE)) | F.array_contains(live, x["value"]))
    count = F.size(F.filter("spans", lambda x: F.array_contains(live, x["value"])))
    return found.join(hits, "key", "left").select("doc_id", "key", kept.alias("spans"), count.cast("long").alias("n_live"), (F.size("spans") - count).cast("long").alias("n_example"))


def _without(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by <secret>, one character after the other."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("gaps"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("begin"), x["start"].alias("end")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"))

    def joined(chars: Column) -> Column:
        done = F.aggregate(spans, zero, step)
        gaps = F.concat(done["gaps"], F.array(F.struct(done["at"].alias("begin"), F.size(chars).alias("end"))))
        return F.array_join(F.transform(gaps, lambda g: F.array_join(F.slice(chars, g["begin"] + 1, g["end"] - g["begin"]), "")), "<secret>")

    # the array of one element names the characters, which are then split once
    return F.transform(F.array(F.split(text, "", -1)), joined)[0]


def redact(docs: DataFrame) -> DataFrame:
    """The documents, secrets of the base kinds and live ones replaced by <secret>; no row goes. ``n_chars``, where there is one, follows the text."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/secrets-{uuid.uuid4().hex}"
    scan(docs).filter(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias(SPANS)).withColumnRenamed("key", KEY).write.parquet(path)
    # read back, its size is known: Spark sends it to every task if small, and joins by key if not
    out = docs.withColumn(KEY, row_key()).join(spark.read.parquet(path), KEY, "left")
    clean = F.when(F.col(SPANS).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(SPANS)))
    out = out.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(SPANS).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["nth"] < len(BASE))
    nth = F.transform("spans", lambda x: x["nth"])
    counts = [(F.size(nth) - F.size(F.array_remove(nth, i))).cast("long").alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE)]
    return scan(docs).select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), "n_live", "n_example")
