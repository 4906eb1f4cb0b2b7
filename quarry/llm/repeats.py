"""Removal of 50-byte strings that start in an earlier document, by prefix doubling.

A position's rank at 8 bytes is those bytes, packed. The rank at a longer length is named from the
pair of ranks at the position and at an offset: 8, 16, 32, then 50 bytes. At each length of
``rounds`` Spark deals the ranks by range to buckets, sorts them, and answers for each whether it
stands elsewhere; a position whose rank stands nowhere else is unique and drops out, so later
rounds move less. Before the last length a string is asked for by the least rank inside it, which
equal strings share, so few ranks are sent for many positions; at the last length every position
left is asked for by its own rank.

Texts lie in chunks of about ``CHUNK`` bytes in order of doc_id, in a table bucketed by chunk, so
the rounds move ranks and answers, never texts. A chunk sends each rank once, as the difference to
the one before, in as few bytes as hold it; a hot passage is one rank a chunk. Answers are bits.
Names of pairs are hashes; at the last length they have 2 log2(bytes) + 20 bits at least, so that
two different strings of a corpus share one in about one corpus in a million. Texts equal as a
whole take part once, by the least doc_id.

Defined cases: null text is empty; texts under 50 bytes lose nothing; rows of one doc_id are never
earlier than each other, whether their texts differ or not, and repeated rows give repeated rows;
a null doc_id loses nothing and takes from no one; an empty table gives an empty one; extra columns
are ignored. A text is handled whole by one task, at about 100 bytes of memory a byte of it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint_dir, remove_folder, tidy

LENGTH, ROUNDS = 50, (32, 50)
CHUNK, BUCKET_BYTES, TABLE_BYTES = 4 << 20, 1 << 20, 64 << 20
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
REPLY = "chunk long, sub int, round int, bucket long, data binary"


def packed(data: np.ndarray) -> np.ndarray:
    """Rank of the 8 bytes at every position: the bytes themselves."""
    rank = data.astype(np.uint64)
    for have in (1, 2, 4):
        rank = (rank[:-have] << np.uint64(8 * have)) | rank[have:]
    return rank


def pair(first: np.ndarray, second: np.ndarray, lane: int) -> np.ndarray:
    """Names of pairs of ranks."""
    one = first * np.uint64(0x9E3779B97F4A7C15 + 2 * lane)
    one ^= one >> np.uint64(29 + lane)
    one += second
    one *= np.uint64(0xBF58476D1CE4E5B9 + 4 * lane)
    one ^= one >> np.uint64(32)
    one *= np.uint64(0x94D049BB133111EB)
    one ^= one >> np.uint64(31)
    return one


def doubled(rank: np.ndarray, have: int, length: int, lane: int = 0) -> np.ndarray:
    """Rank of ``length`` bytes at every position, from that of ``have``."""
    while have < length:
        step = min(have, length - have)
        rank, have = pair(rank[:-step], rank[step:], lane), have + step
    return rank


def doubled_at(rank: np.ndarray, have: int, length: int, at: np.ndarray, lane: int = 0) -> np.ndarray:
    """The same at some positions only."""
    if length == have:
        return rank[at]
    half = have
    while 2 * half < length:
        half *= 2
    return pair(doubled_at(rank, have, half, at, lane), doubled_at(rank, have, half, at + (length - half), lane), lane)


def least(rank: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        rank = np.minimum(rank[:-step], rank[step:])
        have += step
    return rank


class Plan:
    """Sizes that follow from the corpus alone: bits of a rank and buckets, by length."""

    def __init__(self, total: int, rounds: tuple[int, ...] = ROUNDS):
        log = max(total, 2).bit_length()
        self.rounds = rounds
        self.bits = {n: 64 if n == LENGTH else min(64, log + 8) for n in rounds}
        self.low = min(8, max(1, -(-(2 * log + 20 - 64) // 8)))  # bytes of the second name at the last length
        self.split = {n: min(self.bits[n] - 1, (total // (BUCKET_BYTES * (1 if n == LENGTH else 2))).bit_length()) for n in rounds}


def pack(values: np.ndarray, base: int, low: np.ndarray | None, low_bytes: int) -> bytes:
    """Sorted values as differences of equal width; then the second names."""
    gaps = np.diff(values, prepend=np.uint64(base))
    width = max(1, -(-int(gaps.max()).bit_length() // 8))
    cut = lambda x, n: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()
    return bytes([width]) + cut(gaps, width) + (cut(low, low_bytes) if low is not None else b"")


def unpack(data: bytes, base: int, low_bytes: int) -> tuple[np.ndarray, np.ndarray | None]:
    width = data[0]
    n = (len(data) - 1) // (width + low_bytes)

    def wide(raw: bytes, k: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :k] = np.frombuffer(raw, np.uint8).reshape(n, k)
        return out.view("<u8").ravel()

    values = np.cumsum(wide(data[1 : 1 + n * width], width), dtype=np.uint64) + np.uint64(base)
    return values, wide(data[1 + n * width :], low_bytes) if low_bytes else None


def _sorted_groups(values: np.ndarray, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(order by value, where in it each distinct value begins)."""
    order = np.argsort(values)
    v = values[order]
    new = v[1:] != v[:-1]
    if low is not None:
        lo = low[order]
        if (~new & (lo[1:] != lo[:-1])).any():  # hardly ever: one first name, two second names
            order = np.lexsort((low, values))
            v, lo = values[order], low[order]
            new = (v[1:] != v[:-1]) | (lo[1:] != lo[:-1])
    return order, np.flatnonzero(np.r_[True, new]) if len(v) else np.empty(0, np.int64)


class Chunk:
    """The texts of a chunk that take part, and which of their positions may still be repeated."""

    def __init__(self, rows: pd.DataFrame, live: frozenset[bytes]):
        rows = rows.sort_values("doc_id", kind="stable")
        self.rows = rows
        self.bytes = [t.encode("utf-8", "surrogatepass") for t in rows.text]
        self.takes = np.array([len(b) >= LENGTH and s in live for b, s in zip(self.bytes, rows["key"])], bool)
        parts = [b for b, t in zip(self.bytes, self.takes) if t]
        sizes = np.array([len(b) for b in parts], np.int64)
        self.ends = np.cumsum(sizes)
        ids = rows.doc_id.to_numpy()
        rank = np.cumsum(np.r_[0, ids[1:] != ids[:-1]])[self.takes] if len(ids) else np.empty(0, np.int64)
        self.doc = np.repeat(rank.astype(np.int32), sizes)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.alive = np.ones(len(self.data), bool)
        for end in self.ends:
            self.alive[end - LENGTH + 1 : end] = False
        self.ranks = (8, packed(self.data)) if parts else None
        self.bytes8 = self.ranks and self.ranks[1]

    def round(self, plan: Plan, length: int, reply: dict[int, bytes] | None) -> list[tuple[int, bytes]] | None:
        """Without a reply, the distinct ranks by bucket; with one, drops the positions it shows to be unique."""
        at = np.flatnonzero(self.alive)
        if not len(at):
            return []
        last = length == LENGTH
        bits, split = plan.bits[length], plan.split[length]
        have, rank = self.ranks
        doc, run, low = self.doc[at], None, None
        if last:
            value = doubled_at(rank, have, length, at)
            low = doubled_at(self.bytes8, 8, length, at, 1) >> np.uint64(64 - 8 * plan.low)
        else:
            rank = doubled(rank, have, length)
            self.ranks = (length, rank) if reply is not None else self.ranks
            value = least(rank, LENGTH - length + 1)[at]
            new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]
            run = np.cumsum(new) - 1  # neighbours that ask by one rank ask once
            doc = doc[new]
            value = pair(value[new], value[new], 2) >> np.uint64(64 - bits)  # least ranks are small; their names are even
        order, firsts = _sorted_groups(value, low)
        distinct = value[order[firsts]]
        buckets = distinct >> np.uint64(bits - split)
        names_of, starts = np.unique(buckets, return_index=True)
        stops = np.r_[starts[1:], len(distinct)]
        if reply is None:
            seconds = low[order[firsts]] if last else None
            return [(int(b), pack(distinct[i:j], int(b) << (bits - split), None if seconds is None else seconds[i:j], plan.low)) for b, i, j in zip(names_of, starts, stops)]
        said = np.concatenate([np.unpackbits(np.frombuffer(reply[int(b)], np.uint8), count=j - i) for b, i, j in zip(names_of, starts, stops)]).astype(bool)
        sizes = np.diff(np.r_[firsts, len(order)])
        doc = doc[order]
        first_doc = np.minimum.reduceat(doc, firsts)
        stays = np.empty(len(order), bool)
        if last:
            stays[order] = np.repeat(said, sizes) | (doc > np.repeat(first_doc, sizes))
        else:
            stays[order] = np.repeat(said | (np.maximum.reduceat(doc, firsts) > first_doc), sizes)
        self.alive[at] = stays if run is None else stays[run]
        return None

    def covered(self) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """Of each text, its row, its bytes and which of them go."""
        step = np.zeros(len(self.data) + 1, np.int64)
        at = np.flatnonzero(self.alive)
        step[at] += 1
        step[at + LENGTH] -= 1
        hit, nth = np.cumsum(step)[:-1] > 0, 0
        for i, data in enumerate(self.bytes):
            if self.takes[i]:
                yield i, data, hit[self.ends[nth] - len(data) : self.ends[nth]]
                nth += 1
            else:  # a copy of an earlier document's whole text
                yield i, data, np.full(len(data), len(data) >= LENGTH)


def _chunked(chunk_bytes: int):
    """Names the chunks of rows sorted by doc_id and key; equal rows become one with ``times``.

    A chunk is named by its first doc_id. One whose doc_id fills more than a chunk has chunks of its
    own (``sub``), so chunks of one name never hold documents that come before each other.
    """

    def out(part: list[list], sub: int) -> pd.DataFrame:
        f = pd.DataFrame([(r[0], r[1], r[3], r[4]) for r in part], columns=["doc_id", "key", "text", "times"])
        return f.assign(chunk=part[0][0], sub=sub)[["chunk", "sub", "doc_id", "times", "key", "text"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[list] = []
        size = begin = sub = 0
        for f in frames:
            for doc, key, n, text in zip(f.doc_id, f["key"], f.n, f.text):
                key = bytes(key)
                if rows and rows[-1][0] == doc and rows[-1][1] == key:
                    rows[-1][4] += 1
                    continue
                if rows and rows[-1][0] != doc:
                    if sub or size + n > chunk_bytes:
                        yield out(rows, sub)
                        rows, size, sub = [], 0, 0
                    begin = len(rows)
                elif rows and size + n > chunk_bytes:
                    if begin:
                        yield out(rows[:begin], 0)
                        rows = rows[begin:]
                        size, begin = sum(r[2] for r in rows), 0
                    if size + n > chunk_bytes:
                        yield out(rows, sub)
                        rows, size, sub = [], 0, sub + 1
                rows.append([doc, key, n, text, 1])
                size += n
        if rows:
            yield out(rows, sub)

    return run


def _chunk_and_replies(texts: pd.DataFrame, replies: pd.DataFrame) -> tuple[Chunk, dict[int, dict[int, bytes]]]:
    said: dict[int, dict[int, bytes]] = {}
    for r, b, data in zip(replies["round"], replies.bucket, replies.data):
        said.setdefault(int(r), {})[int(b)] = bytes(data)
    live = frozenset(k for v in said.pop(0, {}).values() for k in (v[i : i + 16] for i in range(0, len(v), 16)))
    return Chunk(texts.assign(key=[bytes(k) for k in texts["key"]]), live), said


def _asks(plan: Plan, length: int):
    def run(texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["chunk", "sub", "bucket", "data"]
        if not len(texts):
            return pd.DataFrame({c: [] for c in columns})
        chunk, said = _chunk_and_replies(texts, replies)
        for done in plan.rounds[: plan.rounds.index(length)]:
            chunk.round(plan, done, said.get(done, {}))
        blocks = chunk.round(plan, length, None)
        return pd.DataFrame([(texts.chunk.iloc[0], texts["sub"].iloc[0], b, data) for b, data in blocks], columns=columns)

    return run


def _answers(plan: Plan, length: int):
    """For one bucket: of each chunk's ranks, whether another chunk has it (the last length: an earlier one)."""
    last, shift = length == LENGTH, plan.bits[length] - plan.split[length]

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values(["chunk", "sub"], kind="stable")
        base = int(blocks.bucket.iloc[0]) << shift
        parts = [unpack(bytes(d), base, plan.low if last else 0) for d in blocks.data]
        who = np.repeat(np.arange(len(parts)), [len(v) for v, _ in parts])
        order, firsts = _sorted_groups(np.concatenate([v for v, _ in parts]), np.concatenate([w for _, w in parts]) if last else None)
        sizes = np.diff(np.r_[firsts, len(order)])
        bit = np.empty(len(order), bool)
        if last:
            name = blocks.chunk.to_numpy()[who]
            bit[order] = name[order] > np.repeat(np.minimum.reduceat(name[order], firsts), sizes)
        else:
            bit[order] = np.repeat(sizes > 1, sizes)
        ends = np.cumsum([len(v) for v, _ in parts])
        data = [np.packbits(bit[e - len(v) : e]).tobytes() for e, (v, _) in zip(ends, parts)]
        return pd.DataFrame({"chunk": blocks.chunk, "sub": blocks["sub"], "round": length, "bucket": blocks.bucket, "data": data})

    return run


def _removed(plan: Plan, keep_text: bool):
    def run(texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(texts):
            chunk, said = _chunk_and_replies(texts, replies)
            for length in plan.rounds:
                chunk.round(plan, length, said.get(length, {}))
            ids, times = chunk.rows.doc_id.to_numpy(), chunk.rows.times.to_numpy()
            for i, data, hit in chunk.covered():
                spans = int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~hit].tobytes() if spans else data
                out += [(ids[i], len(data), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None)] * int(times[i])
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def removed(docs: DataFrame, keep_text: bool = True, rounds: tuple[int, ...] = ROUNDS, chunk_bytes: int = CHUNK) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the text left, cut characters dropped; null without ``keep_text``)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.octet_length("text"))
    takes = F.col("doc_id").isNotNull() & (F.col("n") >= LENGTH)
    zero = F.lit(0).cast("long")
    rest = rows.filter(~takes).select("doc_id", F.col("n").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), (F.col("text") if keep_text else F.lit(None).cast("string")).alias("kept"))
    total = rows.filter(takes).agg(F.sum("n")).first()[0] or 0
    if not total:
        return rest
    plan = Plan(total, rounds)
    name = f"quarry_repeats_{uuid.uuid4().hex}"
    folder = f"{checkpoint_dir(spark)}/{name}"
    tasks = max(1, min(-(-total // chunk_bytes), max(4096, -(-total // (16 * chunk_bytes)))))
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TABLE_BYTES)))
    dealt = rows.filter(takes).withColumn("key", F.unhex(F.md5("text"))).repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "key")
    with tidy(spark):
        (
            dealt.select("doc_id", "key", "n", "text").mapInPandas(_chunked(chunk_bytes), "chunk long, sub int, doc_id long, times int, key binary, text string")
            .write.bucketBy(buckets, "chunk", "sub").option("path", f"{folder}/texts").option("compression", "zstd").saveAsTable(name)
        )
        texts = spark.table(name)
        # of equal texts the one of the least doc_id takes part
        reps = texts.groupBy("key").agg(F.min(F.struct("doc_id", "chunk", "sub")).alias("at")).select("at.chunk", "at.sub", "key")
        live = reps.groupBy("chunk", "sub").agg(F.collect_list("key").alias("keys")).select("chunk", "sub", F.lit(0).alias("round"), F.lit(0).cast("long").alias("bucket"), F.expr("aggregate(keys, x'', (a, k) -> a || k)").alias("data"))
        live.write.parquet(f"{folder}/replies-0")
        replies = [spark.read.parquet(f"{folder}/replies-0")]
        by_chunk = lambda x: x.groupBy("chunk", "sub")
        for length in rounds:
            told = reduce(DataFrame.unionByName, replies)
            asked = by_chunk(texts).cogroup(by_chunk(told)).applyInPandas(_asks(plan, length), "chunk long, sub int, bucket long, data binary")
            asked.groupBy("bucket").applyInPandas(_answers(plan, length), REPLY).write.parquet(f"{folder}/replies-{length}")
            replies.append(spark.read.parquet(f"{folder}/replies-{length}"))
        told = reduce(DataFrame.unionByName, replies)
        by_chunk(texts).cogroup(by_chunk(told)).applyInPandas(_removed(plan, keep_text), OUT).write.parquet(f"{folder}-result")
    spark.sql(f"drop table {name}")
    remove_folder(spark, folder)
    return spark.read.parquet(f"{folder}-result").unionByName(rest)
