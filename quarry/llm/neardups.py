"""N-gram Jaccard join: MinHash banding, verified on full shingle sets.

Shingles are runs of five words (a shorter text is one shingle). ``BANDS`` bands of ``ROWS`` rows
find a pair of similarity 0.8 with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.99998. Texts of equal
words have one representative first, so copies are never paired. Representatives that share a band
are joined to the band's least one only, and the connected groups of these edges hold every
candidate pair. A group is verified on full sets in blocks: its members are dealt to cells of about
``CELL`` shingles, one bounded task takes two cells, counts the links of each member and keeps a
spanning star of each connected part. No pair becomes a row, and no link is lost.

Defined cases: null and wordless texts join nothing and are classes of their own; repeated rows
fall into one class; an empty table gives an empty one; extra columns are kept aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint_dir, split_words

BANDS, ROWS, SHINGLE, LIMIT, CELL = 36, 6, 5, 0.8, 1 << 17
#: A text takes room for so many shingles of a cell at least, which bounds a cell's members to 2,048.
LEAST_ROOM = 64
KNOWN = 1 << 20


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_known = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(w: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted."""
    if not w:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_known.__getitem__, w), np.uint64, len(w))
    n = min(n, len(w))
    grams = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        grams = _mix(grams * np.uint64(0xD6E8FEB86659FD93) + each[i : len(w) - n + 1 + i])
    return np.unique(grams)


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return tuple(rng.integers(1, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1) for _ in range(2))


FIRST, SECOND = _mixers()


def bands(hashes: np.ndarray) -> list[int]:
    """One 64-bit key per band, in bounded memory for texts of any length."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), 512):
        part = short[None, at : at + 512] * FIRST
        part ^= part >> np.uint32(15)
        part *= SECOND
        np.minimum(low, part.min(axis=1), out=low)
    raw = low.tobytes()
    return [xxhash.xxh64_intdigest(raw[4 * ROWS * i : 4 * ROWS * (i + 1)], seed=i) - (1 << 63) for i in range(BANDS)]


def _signatures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text, the name of its word sequence, its number of shingles and its bands; nulls without words."""
    for f in frames:
        out = []
        for text in f.text:
            w = split_words(text)
            s = shingle_hashes(w)
            out.append((xxhash.xxh128_hexdigest(b" ".join(w)), len(s), bands(s)) if w else (None, 0, None))
        yield pd.DataFrame({"doc_id": f.doc_id, **{k: pd.Series([x[i] for x in out], dtype=object) for i, k in enumerate(("same", "n", "bands"))}})


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingle sets of representatives; rows of their id with other words go, repeated rows go where they meet."""
    met = set()
    for f in frames:
        if len(met) > KNOWN:  # rows met twice all the same go where they meet
            met.clear()
        w = [split_words(t) for t in f.text]
        names = [xxhash.xxh128_hexdigest(b" ".join(x)) for x in w]
        keep = []
        for i, key in enumerate(zip(f.rep, names)):
            if names[i] == f.same.iloc[i] and key not in met:
                met.add(key)
                keep.append(i)
        out = f.iloc[keep].drop(columns="text")
        yield out.assign(shingles=[shingle_hashes(w[i]).view(np.int64) for i in keep])


def _linked(rows: list[np.ndarray], cols: list[np.ndarray], limit: float) -> np.ndarray:
    """Which of rows and cols have similarity of at least ``limit``; common counts by blocks of shingles."""
    both = rows + cols
    _, at = np.unique(np.concatenate(both), return_inverse=True)
    who = np.repeat(np.arange(len(both)), [len(x) for x in both])
    left = who < len(rows)
    shared = (np.bincount(at[left], minlength=at.max() + 1) > 0) & (np.bincount(at[~left], minlength=at.max() + 1) > 0)
    name = np.cumsum(shared) - 1
    keep = shared[at]
    who, at = who[keep], name[at[keep]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    common = np.zeros((len(rows), len(cols)), np.float64)
    step = max(64, min(8192, (1 << 22) // len(both)))
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(at, [lo, lo + step])
        part = np.zeros((len(both), step), np.float32)
        part[who[a:b], at[a:b] - lo] = 1
        common += part[: len(rows)] @ part[len(rows) :].T
    sizes = np.array([len(x) for x in both])
    return common >= limit * (sizes[: len(rows), None] + sizes[None, len(rows) :] - common) - 1e-9


def _verify(group: pd.DataFrame, limit: float) -> pd.DataFrame:
    """Links inside one cell or between two: rep, root (least member it is connected to here), linked (rows linked to it here)."""
    group = group.drop_duplicates(["rep", "same"])
    rep, copies, sets = group.rep.to_numpy(), group.copies.to_numpy(), list(group.shingles)
    first = group.cell.to_numpy() == group.i.iloc[0]
    r = np.flatnonzero(first)
    c = r if group.i.iloc[0] == group.j.iloc[0] else np.flatnonzero(~first)
    root, linked = rep.copy(), np.zeros(len(rep), np.int64)
    if len(r) and len(c):
        link = _linked([sets[x] for x in r], [sets[x] for x in c], limit) & (rep[r][:, None] != rep[c][None, :])
        linked[r] += link @ copies[c]
        if r is not c:
            linked[c] += copies[r] @ link
        top = np.iinfo(np.int64).max
        while True:
            was = root.copy()
            root[c] = np.minimum(root[c], np.where(link, root[r][:, None], top).min(axis=0))
            root[r] = np.minimum(root[r], np.where(link, root[c][None, :], top).min(axis=1))
            if (root == was).all():
                break
    some = linked > 0
    return pd.DataFrame({"rep": rep[some], "root": root[some], "linked": linked[some]})


def _verified(limit: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups come sorted; the last one of a batch waits for the next batch."""
        wait = None
        for f in frames:
            f = f if wait is None else pd.concat([wait, f], ignore_index=True)
            if not len(f):
                continue
            keys = f[["grp", "i", "j"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)]
            out = [_verify(f.iloc[a:b], limit) for a, b in zip(cuts, cuts[1:])]
            wait = f.iloc[cuts[-1] :]
            if out:
                yield pd.concat(out, ignore_index=True)
        if wait is not None:
            yield _verify(wait, limit)

    return run


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, same (name of the word sequence, null without words), n (shingles), bands."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    plain = texts.filter("doc_id is not null").mapInPandas(_signatures, "doc_id long, same string, n long, bands array<long>")
    return plain.unionByName(texts.filter("doc_id is null").select("doc_id", F.lit(None).cast("string").alias("same"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<long>").alias("bands")))


def candidates(reps: DataFrame) -> DataFrame:
    """rep, grp of every representative that shares a band with another; all that could be linked have one grp."""
    keys = reps.select("rep", F.explode("bands").alias("band"))
    hubs = keys.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("hub")).filter("k > 1").select("band", "hub")
    edges = keys.join(hubs, "band").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    return components(edges).select(F.col("node").alias("rep"), F.col("c").alias("grp"))


def links(docs: DataFrame, reps: DataFrame, limit: float = LIMIT) -> DataFrame:
    """rep, root, linked: per bounded task and linked representative, a member it is connected to and the rows linked to it."""
    held = reps.select("rep", "same", "n", "copies").join(candidates(reps), "rep").checkpoint()
    cells = held.groupBy("grp").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST_ROOM))) / CELL).cast("int").alias("cells"))
    held = held.join(cells, "grp").withColumn("cell", F.pmod(F.xxhash64("rep", "same"), F.col("cells")).cast("int")).drop("n")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("rep is not null and text is not null")
    sets = texts.join(held, "rep").select("rep", "same", "copies", "grp", "cells", "cell", "text").mapInPandas(_sets, "rep long, same string, copies long, grp long, cells int, cell int, shingles array<long>")
    dealt = (
        sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        .withColumn("i", F.least("cell", "other")).withColumn("j", F.greatest("cell", "other")).select("grp", "i", "j", "cell", "rep", "same", "copies", "shingles")
    )
    return dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInPandas(_verified(limit), "rep long, root long, linked long")


def components(edges: DataFrame) -> DataFrame:
    """node -> least node of its connected component, by label spreading with pointer jumps and cut lineage."""
    checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    label = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("node"), "c").checkpoint()
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.col("a").alias("node")).agg(F.min("cb").alias("cb"))
        step = label.join(near, "node", "left").select("node", F.col("c").alias("old"), F.least("c", F.coalesce("cb", "c")).alias("c"))
        jump = step.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = step.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("cc", "c")).alias("c")).checkpoint()
        if new.filter("c <> old").isEmpty():
            return new.select("node", "c")
        label = new.select("node", "c")


def classes(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, class_id (least doc_id of the group), n_links (rows linked to this one)."""
    checkpoint_dir(docs.sparkSession)
    rows = signatures(docs).checkpoint()
    reps = rows.filter("same is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    found = links(docs, reps, limit).checkpoint()
    degree = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    label = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    member = (
        reps.select("same", "rep", "copies").join(degree, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .select("same", F.coalesce("c", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"))
    )
    alone = rows.filter("same is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.filter("same is not null").select("doc_id", "same").join(member, "same").select("doc_id", "class_id", "n_links").unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, one of each group; rows without a doc_id all stay."""
    stay = classes(docs).filter("class_id = doc_id").select("doc_id").distinct()
    once = docs.filter("doc_id is not null").join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(docs.filter("doc_id is null")).select(*docs.columns)
