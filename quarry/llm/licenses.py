"""License scans [native]: ordered signature rules behind a keyword gate.

Texts become their words, with one blank between them, and the hand-written rules of
``signatures`` are regexes over those words. A section of rules is looked at only where a text holds
one of its gate words; within a section the first rule that fits at a place wins. Of all sections'
intervals, those contained in others go; of equal ones, the section listed first stays. The three
base phrases are always reported.

Defined cases: null and empty texts have no words and empty labels; repeated rows give repeated
rows; an empty table gives an empty one; extra columns are ignored. Texts are scanned whole, in time
in proportion to their length, but for the intervals found: to drop contained ones copies a list of
references for each.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import words
from quarry.llm.signatures import rules

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Control characters stand in no word.
BEGIN, END = "\x01", "\x02"
FOUND = "array<struct<label:string,start:int,end:int,prio:int>>"


def _phrase_starts(w: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    spots = F.sequence(F.lit(0), F.size(w) - len(parts))
    hit = lambda i: F.forall(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(parts)]), lambda x: F.get(w, i + x["k"]) == x["p"])
    possible = (F.size(w) >= len(parts)) & F.array_contains(w, parts[0])
    return F.when(possible, F.filter(spots, hit)).otherwise(F.array().cast("array<int>"))


def _detections(gate: tuple[str, ...], section: list[tuple[str, str]], prio: int) -> Column:
    """Intervals of a section's matches in words, each with the label of the rule that fits."""
    any_rule = rf"(?<![^ ])(?:{'|'.join(p for _, p in section)})(?![^ ])"
    marked = F.split(F.regexp_replace("line", any_rule, f"{BEGIN}$0{END}"), " ", -1)
    at = lambda fits: F.filter(F.transform(marked, lambda x, i: F.when(fits(x), i)), lambda i: i.isNotNull())
    both = F.arrays_zip(at(lambda x: x.startswith(BEGIN)).alias("start"), at(lambda x: x.endswith(END)).alias("last"))

    def one(x: Column) -> Column:
        text = F.array_join(F.slice("w", x["start"] + 1, x["last"] - x["start"] + 1), " ")
        label = F.coalesce(*[F.when(text.rlike(f"^(?:{p})$"), F.lit(name)) for name, p in section])
        return F.struct(label.alias("label"), x["start"].alias("start"), (x["last"] + 1).alias("end"), F.lit(prio).alias("prio"))

    return F.when(F.arrays_overlap("gates", F.array(*[F.lit(k) for k in gate])), F.transform(both, one)).otherwise(F.array().cast(FOUND))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base starts by phrase, found (array of label, start, end in words)."""
    sections = [(gate, [(label, p) for _, label, p in part]) for gate, part in groupby(rules(), key=lambda r: r[0])]
    gates = sorted({word for gate, _ in sections for word in gate})
    table = docs.select("doc_id", words(F.col("text")).alias("w"))
    table = table.withColumns({"gates": F.array_distinct(F.filter("w", lambda x: x.isin(*gates)))})
    table = table.withColumn("line", F.when(F.size("gates") > 0, F.array_join("w", " ")))
    found = F.concat(*[_detections(gate, section, prio) for prio, (gate, section) in enumerate(sections)])
    starts = [_phrase_starts(F.col("w"), phrase).alias(label) for phrase, label in BASE]
    table = table.withColumn("found", F.when(F.size("gates") > 0, found).otherwise(F.array().cast(FOUND)))
    return table.select("doc_id", F.size("w").cast("long").alias("n_words"), F.struct(*starts).alias("base"), outermost(F.col("found")).alias("found"))


def outermost(found: Column) -> Column:
    """Drop intervals contained in others, by one pass in order of start, longest first."""
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("neg"), x["prio"].alias("prio"), x["label"].alias("label"))))
    zero = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<label:string,start:int,end:int>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        one = F.struct(x["label"].alias("label"), x["start"].alias("start"), (-x["neg"]).alias("end"))
        new = -x["neg"] > acc["end"]
        return F.struct(F.greatest(acc["end"], -x["neg"]).alias("end"), F.when(new, F.concat(acc["kept"], F.array(one))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(order, zero, step)["kept"]


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, and found. ``score``: the share of a text's words, at most 50 of them, in found intervals; a base phrase counts 3 words."""
    starts = [F.col("base").getField(label) for _, label in BASE]
    hits = F.concat(*starts)
    names = F.filter(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for s, (_, label) in zip(starts, BASE)]), lambda x: x.isNotNull())
    covered = F.aggregate("found", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return scan(docs).select(
        "doc_id", "n_words", F.size(hits).cast("long").alias("n_base"),
        F.array_min(hits).cast("long").alias("first_word"), F.array_max(hits).cast("long").alias("last_word"),
        F.array_join(F.array_sort(names), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(names, F.transform("found", lambda x: x["label"])))), ",").alias("labels"),
        F.least(F.lit(1.0), (covered + 3 * F.size(hits)) / F.greatest(F.lit(1), F.least(F.col("n_words"), F.lit(50)))).cast("double").alias("score"),
        "found",
    )
