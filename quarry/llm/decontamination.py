"""Benchmark decontamination over a distributed positional inverted index.

Training texts are dealt to segments of about ``SEGMENT`` bytes, as they lie; a segment's index has
for each term the places where it stands, and is stored in the shared folder. Only the benchmark's
terms are kept: beyond ``MAX_TERMS`` of them by a join, else as the index is written. A window is
``n`` consecutive item words (a shorter item is one window). Each window is sent to the segments
that hold its rarest terms, by the stored lists' lengths; there its lists, moved by their offsets,
are intersected from the rarest on until none is left. What is left are exact phrases. Near matches
have all words of a window but ``missing`` at their offset or up to ``slop`` words later (windows of
fewer than ``n`` words need all); they start from the lists of the ``missing`` + 1 rarest terms, one
of which any match has. No text and no document is in a shuffle, only places and windows.

Defined cases: null and empty texts have no words; very long texts are indexed whole; repeated rows
give repeated rows; items of equal words all count; equal list lengths go by offset; empty tables
give n_items 0; extra columns of ``docs`` are kept, but for those named as a result, which give way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint_dir, split_words, spread, words

SEGMENT = 24 << 20
#: Up to so many terms, of so many bytes, go to every task.
MAX_TERMS, MAX_TERM_BYTES = 1 << 20, 16 << 20
INDEX = "segment string, term string, n long, places binary, ids array<string>, keys array<string>, sizes array<long>"
KEY = "decontamination_key"


def windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(win, item): a window's words and an item that has it."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("win")).distinct()


def row_key() -> Column:
    """Names rows of one id and text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.coalesce("text", F.lit(""))))


def _indexed(known: frozenset[bytes] | None, gap: int):
    """Segments: a row of places for each term, and one row of documents. Places count words over a segment's texts, ``gap`` apart."""
    names = {w: i for i, w in enumerate(known)} if known is not None else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, nth = TaskContext.get().partitionId(), 0
        terms = dict(names) if names is not None else {}
        docs, found, at, size = [], [], 0, 0

        def segment() -> pd.DataFrame:
            rows = [(f"{part}-{nth}", None, 0, None, [d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs])]
            who = np.concatenate([w for w, _ in found]) if found else np.empty(0, np.int64)
            where = np.concatenate([p for _, p in found]) if found else who
            order = np.argsort(who, kind="stable")
            who, where = who[order], where[order]
            firsts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.empty(0, np.int64)
            words_of = list(terms)
            for a, b in zip(firsts, np.r_[firsts[1:], len(who)]):
                rows.append((f"{part}-{nth}", words_of[who[a]].decode(), b - a, np.diff(where[a:b], prepend=0).astype("<u4").tobytes(), None, None, None))
            return pd.DataFrame(rows, columns=["segment", "term", "n", "places", "ids", "keys", "sizes"])

        for f in frames:
            for doc, key, text in zip(f.doc_id, f["key"], f.text):
                w = split_words(text)
                if names is not None:
                    ids = np.fromiter((terms.get(x, -1) for x in w), np.int64, len(w))
                    here = np.flatnonzero(ids >= 0)
                else:
                    ids, here = np.fromiter((terms.setdefault(x, len(terms)) for x in w), np.int64, len(w)), np.arange(len(w))
                found.append((ids[here], here + at))
                docs.append((doc, key, len(w)))
                at += len(w) + gap
                size += len(text)
                if size >= SEGMENT or at >= 1 << 31:
                    yield segment()
                    docs, found, at, size, nth = [], [], 0, 0, nth + 1
                    terms = dict(names) if names is not None else {}
        if docs:
            yield segment()

    return run


def index(docs: DataFrame, terms: DataFrame, gap: int) -> DataFrame:
    """The positional index of ``terms`` over ``docs``, stored."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    n, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    small = n <= MAX_TERMS and size <= MAX_TERM_BYTES
    known = frozenset(r.term.encode() for r in terms.collect()) if small else None
    path = f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    rows.mapInPandas(_indexed(known, gap), INDEX).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    if small:
        return stored
    return stored.filter("term is null").unionByName(stored.filter("term is not null").join(terms, "term", "left_semi").select(*stored.columns))


def _exact(lists: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Starts where every list has its offset; lists come from the shortest on."""
    offset, places = lists[0]
    starts = places - offset
    for offset, places in lists[1:]:
        at = np.searchsorted(places, starts + offset)
        at[at == len(places)] = 0
        starts = starts[places[at] == starts + offset]
        if not len(starts):
            break
    return starts


def _near(lists: list[tuple[int, np.ndarray]], need: int, slop: int) -> np.ndarray:
    """Starts where ``need`` of the lists have their offset or up to ``slop`` more."""
    first = [p - o - s for o, p in lists[: len(lists) - need + 1] for s in range(slop + 1)]
    starts = np.unique(np.concatenate(first))
    short = np.zeros(len(starts), np.int64)
    for offset, places in lists:
        if not len(places):
            short += 1
            continue
        at = np.searchsorted(places, starts + offset)
        last = at == len(places)
        at[last] = 0
        short += last | (places[at] > starts + offset + slop)
        keep = short <= len(lists) - need
        if not keep.all():
            starts, short = starts[keep], short[keep]
    return starts


def _matched(n: int, slop: int, missing: int):
    def run(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Of each document of a segment, how many words exact windows cover, and the windows found exactly and nearly."""
        about = stored[stored.term.isna()].iloc[0]
        lists = {t: np.cumsum(np.frombuffer(p, "<u4"), dtype=np.int64) for t, p in zip(stored.term, stored.places) if t is not None}
        sizes = np.asarray(about["sizes"], np.int64)
        begin = np.cumsum(np.r_[0, sizes[:-1] + n + slop]) if len(sizes) else sizes
        covered, exact, near = [], [set() for _ in sizes], [set() for _ in sizes]
        none = np.empty(0, np.int64)
        for name, win in zip(asked["name"], asked.win):
            of = sorted(((j, lists.get(t, none)) for j, t in enumerate(win)), key=lambda x: (len(x[1]), x[0]))
            if len(of[0][1]):
                starts = _exact(of)
                if len(starts):
                    covered.append(np.c_[starts, starts + len(win)])
                    for d in np.unique(np.searchsorted(begin, starts, side="right") - 1):
                        exact[d].add(name)
            need = len(win) if len(win) < n else max(1, len(win) - missing)
            if slop or missing:
                starts = _near(of, need, slop)
                if len(starts):
                    # the word that shows where the window stands is one that is there
                    at = np.searchsorted(begin, starts + len(win) - 1, side="right") - 1
                    for d in np.unique(np.maximum(at, 0)):
                        near[d].add(name)
        hits = np.zeros(len(sizes), np.int64)
        if covered:
            spans = np.concatenate(covered)
            spans = spans[np.argsort(spans[:, 0])]
            reach = np.maximum.accumulate(spans[:, 1])
            fresh = spans[:, 1] - np.maximum(spans[:, 0], np.r_[np.int64(-1), reach[:-1]])
            np.add.at(hits, np.searchsorted(begin, spans[:, 0], side="right") - 1, np.maximum(fresh, 0))
        return pd.DataFrame({"doc_id": about["ids"], "key": about["keys"], "n_words": sizes, "n_hit": hits, "exact": [sorted(x) for x in exact], "near": [sorted(x) for x in near]})

    return run


def matches(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0, missing: int = 0) -> DataFrame:
    """Per row of docs: doc_id, key, n_words, n_hit, items and near_items (ids of items with windows that occur exactly, nearly), sorted."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/matches-{uuid.uuid4().hex}"
    windows(benchmark, n).select(F.md5(F.array_join("win", " ")).alias("name"), "win", "item").write.parquet(f"{folder}/windows")
    wins = spark.read.parquet(f"{folder}/windows")
    distinct = wins.groupBy("name").agg(F.first("win").alias("win"))
    stored = index(docs, distinct.select(F.explode("win").alias("term")).distinct(), n + slop)
    lengths = stored.filter("term is not null").groupBy("term").agg(F.sum("n").alias("freq"))
    terms = distinct.select("name", "win", F.posexplode("win").alias("at", "term")).join(lengths, "term", "left")
    by_freq = F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "at", "term")))
    plans = terms.groupBy("name").agg(F.first("win").alias("win"), by_freq.alias("by_freq"))
    anchors = F.when(F.size("win") < n, F.lit(1)).otherwise(F.least(F.lit(missing + 1), F.size("win")))
    asked = plans.select("name", "win", F.explode(F.slice("by_freq", F.lit(1), anchors)).alias("x")).select("name", "win", F.col("x.term").alias("term"))
    sent = asked.join(stored.filter("term is not null").select("term", "segment"), "term").select("segment", "name", "win").distinct()
    tasks = stored.filter("term is null").count() // 4  # of four segments each
    lists = spread(stored.select("segment", "term", "places", "ids", "keys", "sizes"), tasks, "segment")
    found = lists.groupBy("segment").cogroup(spread(sent, tasks, "segment").groupBy("segment")).applyInPandas(
        _matched(n, slop, missing), "doc_id string, key string, n_words long, n_hit long, exact array<string>, near array<string>"
    )
    found.write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")
    ids = wins.select("name", "item")

    def items(names: str, to: str) -> DataFrame:
        each = found.filter(F.size(names) > 0).select("key", names).distinct().select("key", F.explode(names).alias("name")).join(ids, "name")
        return each.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias(to))

    none = F.array().cast("array<string>")
    out = found.select(F.col("doc_id").cast("long").alias("doc_id"), "key", "n_words", "n_hit").join(items("exact", "items"), "key", "left")
    out = out.join(items("near", "near_items"), "key", "left") if slop or missing else out.withColumn("near_items", none)
    return out.withColumns({"items": F.coalesce("items", none), "near_items": F.coalesce("near_items", none)})


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0, missing: int = 0) -> DataFrame:
    """docs' columns with n_words, n_hit, hit_items, near_items."""
    results = ("n_words", "n_hit", "hit_items", "near_items")
    per_row = matches(docs, benchmark, n, slop, missing).dropDuplicates(["key"]).select(F.col("key").alias(KEY), "n_words", "n_hit", F.col("items").alias("hit_items"), "near_items")
    kept = [c for c in docs.columns if c not in results]
    return docs.withColumn(KEY, row_key()).select(*kept, KEY).join(per_row, KEY).select(*kept, *results)


def proximity(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 1, missing: int = 1) -> DataFrame:
    """docs' columns with n_near_items, near_items (ids with windows that occur exactly or nearly)."""
    out = decontaminate(docs, benchmark, n, slop, missing).drop("n_words", "n_hit", "hit_items")
    return out.withColumn("n_near_items", F.size("near_items").cast("long"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents without any window of the benchmark; their columns as they are."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/contaminated-{uuid.uuid4().hex}"
    matches(docs, benchmark, n).filter("n_hit > 0").select(F.col("key").alias(KEY)).distinct().write.parquet(path)
    # read back, its size is known: Spark sends it to every task if small, and joins by key if not
    return docs.withColumn(KEY, row_key()).join(spark.read.parquet(path), KEY, "left_anti").select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, slop: int = 1, missing: int = 1) -> DataFrame:
    """The contract's exact columns, and n_near_items."""
    return matches(docs.select("doc_id", "text"), benchmark, slop=slop, missing=missing).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )
