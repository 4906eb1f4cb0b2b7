"""Mixing sources to target weights [native].

Texts of a source, in hash order, are packed into blocks of ``block_words`` words. A source's
target is its share of ``share`` times all words, at most ``ceiling`` times its size, and gives its
number of slots. Each slot draws an output shard, so a source's counts in the shards are a
multinomial draw; the counts then decide which run of slots a shard gets. Slot k takes block
perm(k mod blocks), where perm is a keyed swap-or-not shuffle of the source's block indices: in each
round x and (key - x) mod blocks change places or not, by a hash of the larger, which permutes any
number of indices. Blocks and slots are joined by index. The last slot is cut so that the words
taken equal the target, rounded down.

Defined cases: null or empty text has size 0 and takes 0; a null source is a source, the last;
repeated rows are rows of their own; equal hashes go by doc_id, then text, and what is still equal is
interchangeable; very long texts span many blocks; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint_dir, spread, tidy

SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BLOCK_WORDS, SHARDS, ROUNDS = 256, 64, 32
SEED = 17
#: About 32 MB of text.
BLOCKS_A_TASK = 20_000


def targets(sizes: DataFrame, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size) -> with weight and target. One row per source, so the windows are small.

    With the sources in order of size per weight, the capped ones come first; the first source
    whose share of what is left stays under its cap gives the level for all the rest.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = sizes.withColumn("weight", F.element_at(picks, (F.pmod(F.row_number().over(rank) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    full = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(full) - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= ceiling * F.col("source_size"))
    first = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(full.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        levels.withColumn("fill", first)
        .withColumn("target", F.when(F.col("fill").isNull(), ceiling * F.col("source_size")).otherwise(F.least(F.col("fill") * F.col("weight"), ceiling * F.col("source_size"))))
        .select("source", "source_size", "weight", "target")
    )


def _dealt(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, text_hash, size, bucket: buckets by hash, of about the square root of all rows, so that neither a bucket nor a source's buckets are many."""
    n = docs.count()
    buckets = max(1, -(-n // max(1024, math.isqrt(n))))
    return docs.select(
        "doc_id", "source", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NON_SPACE)).cast("long").alias("size"),
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("bucket")), F.lit(buckets)))


def _placed(dealt: DataFrame, sums: DataFrame) -> DataFrame:
    """With nth and ``begin``, the text's first word in its source's stream: prefix sums over buckets, then inside one."""
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", "text_hash", F.lit("order")), "doc_id", "text_hash")
    running = dealt.withColumn("nth", F.row_number().over(inner)).withColumn("inside", F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = running.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("begin", F.col("base") + F.col("inside")).select("doc_id", "source", "text", "size", "bucket", "nth", "begin")


def shuffled(k: Column, rounds: Column, blocks: Column) -> Column:
    """Swap-or-not: a permutation of 0 .. blocks - 1. ``rounds`` is an array of (nth, key); in reverse order it is the inverse."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(r["key"] - x, blocks)
        return F.when(F.xxhash64(F.greatest(x, other), r["nth"]).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(rounds, k, step)


def _plan(sizes: DataFrame, block_words: int, seed: int, share: float, ceiling: float) -> DataFrame:
    """Per source: sizes, target, number of blocks and slots, the keys of its permutation, where its short last block comes."""
    goal = targets(sizes, share, ceiling)
    key = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed))
    rounds = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda i: F.struct((i + key).alias("nth"), F.pmod(F.xxhash64(key, i), F.greatest("blocks", F.lit(1))).alias("key")))
    return (
        goal.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn("goal_words", F.floor("target").cast("long"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("goal_words div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("goal_words") - F.col("whole") * F.col("source_size"))
        .withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block_words)
        .withColumn("rounds", rounds)
        .withColumn("short_k", F.when(F.col("blocks") > 0, shuffled(F.col("blocks") - 1, F.reverse("rounds"), F.col("blocks"))))
        # of the cut round, slots until the rest is full: the short block may come among them
        .withColumn("slots", F.col("whole") * F.col("blocks") + F.least("blocks", F.ceil(F.col("rest") / block_words).cast("long") + 1))
    )


def _slots(plan: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    """source, shard, slot, block, take."""
    span = 1 << 16  # slots are made in runs, so that a hot source's come from many tasks
    some = plan.filter("source_size > 0 and goal_words > 0")
    runs = some.select("source", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {span})")).alias("run")).repartition(F.col("source"), F.col("run"))
    each = runs.select("source", F.explode(F.expr(f"sequence(run * {span}, least(slots - 1, run * {span} + {span - 1}))")).alias("draw"))
    drawn = each.groupBy("source", F.pmod(F.xxhash64("source", "draw", F.lit(seed)), F.lit(shards)).alias("shard")).agg(F.count(F.lit(1)).alias("count"))
    until = F.sum("count").over(Window.partitionBy("source").orderBy("shard"))
    counts = drawn.select(F.col("source").alias("s"), "shard", "count", (until - F.col("count")).alias("from"))
    pieces = some.join(counts, F.col("source").eqNullSafe(F.col("s"))).withColumn("run", F.explode(F.expr(f"sequence(0L, (count - 1) div {span})")))
    return (
        pieces.repartition(F.col("source"), F.col("shard"), F.col("run"))
        .withColumn("slot", F.explode(F.expr(f"sequence(from + run * {span}, from + least(count - 1, run * {span} + {span - 1}))")))
        .withColumn("k", F.expr("slot % blocks"))
        .withColumn("block", shuffled(F.col("k"), F.col("rounds"), F.col("blocks")))
        .withColumn("len", F.when(F.expr("block = blocks - 1"), F.col("short")).otherwise(F.lit(block_words)))
        # words before slot k of the cut round: k full blocks, less what the short one lacks if it came earlier
        .withColumn("ahead", F.expr(f"k * {block_words} - if(k > short_k, {block_words} - short, 0)"))
        .withColumn("take", F.expr("if(slot >= whole * blocks, least(len, rest - ahead), len)"))
        .filter("take > 0")
        .select("source", "shard", "slot", "block", "take")
    )


def _packed(rows: DataFrame, slots: DataFrame, block_words: int, n_blocks: int) -> DataFrame:
    """source, shard, slot, block, take, pieces: of each slot, the stretches of texts that fill it, in order.

    Words are sliced into blocks where the texts lie; blocks and slots meet in one grouping by
    (source, block).
    """
    tokens = F.array_remove(F.split("text", SPACE, -1), "")
    first, last = F.expr(f"begin div {block_words}"), F.expr(f"(begin + size - 1) div {block_words}")

    def piece(w: Column, block: Column) -> Column:
        lo = F.greatest(block * block_words - F.col("begin"), F.lit(0)).cast("int")
        hi = F.least((block + 1) * block_words - F.col("begin"), F.col("size")).cast("int")
        at = (F.col("begin") + lo - block * block_words).cast("int")
        return F.struct(block.alias("block"), at.alias("at"), (hi - lo).alias("n"), F.array_join(F.slice(w, lo + 1, hi - lo), " ").alias("text"))

    # the array of one element names the tokens, which are then split once a text
    cut = F.flatten(F.transform(F.array(tokens), lambda w: F.transform(F.sequence(first, last), lambda b: piece(w, b))))
    pieces = rows.filter("size > 0").select("source", "bucket", "nth", "doc_id", F.explode(cut).alias("x")).select("source", "bucket", "nth", "doc_id", "x.*")
    none = lambda kind: F.lit(None).cast(kind)
    part, to = "struct<at:int,bucket:bigint,nth:int,n:int,doc_id:bigint,text:string>", "struct<shard:bigint,slot:bigint,take:bigint>"
    both = pieces.select("source", "block", F.struct("at", "bucket", "nth", "n", F.col("doc_id").cast("long").alias("doc_id"), "text").cast(part).alias("part"), none(to).alias("to")).unionAll(
        slots.select("source", "block", none(part).alias("part"), F.struct("shard", "slot", "take").cast(to).alias("to"))
    )
    # a block has at most ``block_words`` pieces and, but for one, ``ceiling`` slots
    met = spread(both, n_blocks // BLOCKS_A_TASK, "source", "block").groupBy("source", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.collect_list("to").alias("to"))
    full = met.select("source", "block", "parts", F.explode("to").alias("to")).select("source", "block", "parts", "to.*")

    def kept(x: Column) -> Column:
        rest = F.col("take") - x["at"]
        text = F.when(x["n"] > rest, F.array_join(F.slice(F.split(x["text"], " ", -1), 1, rest.cast("int")), " ")).otherwise(x["text"])
        return F.struct(x["at"].alias("at"), x["bucket"].alias("bucket"), x["nth"].alias("nth"), F.least(x["n"], rest).alias("n"), x["doc_id"].alias("doc_id"), text.alias("text"))

    cut_off = F.transform(F.filter("parts", lambda x: x["at"] < F.col("take")), kept)
    return full.select("source", "shard", "slot", "block", "take", cut_off.alias("pieces"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, share: float = 1.5, ceiling: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: the texts with their places; plan, a row a source; the mix: source, shard, slot, block, take, pieces)."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/mix-{uuid.uuid4().hex}"
    dealt = _dealt(docs.select("doc_id", "source", "text"))

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    with tidy(spark):
        sums = stored(dealt.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "sums")
        plan = stored(_plan(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), block_words, seed, share, ceiling), "plan")
        rows = stored(_placed(dealt, sums), "rows")
    n_blocks = plan.agg(F.sum("blocks")).first()[0] or 0
    return rows, plan, _packed(rows, _slots(plan, block_words, shards, seed), block_words, n_blocks)


def blocks(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: source, shard, slot, block, text (the block's words with one blank between them) and doc_ids, of the texts it comes from."""
    ids = F.array_compact(F.array_distinct("pieces.doc_id"))
    return mix(docs, **options)[2].select("source", "shard", "slot", "block", F.array_join("pieces.text", " ").alias("text"), ids.alias("doc_ids"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Words taken from each text, counted in the blocks."""
    rows, plan, made = mix(docs, **options)
    per_text = (
        made.select("source", F.explode("pieces").alias("x")).groupBy("source", "x.bucket", "x.nth").agg(F.sum("x.n").alias("words"))
        .select(F.col("source").alias("s3"), F.col("bucket").alias("b3"), F.col("nth").alias("n3"), "words")
    )
    goal = plan.select(F.col("source").alias("s4"), "source_size", "target")  # stored, so Spark knows whether it is small enough to broadcast
    return (
        rows.select("doc_id", "source", "size", "bucket", "nth")
        .join(per_text, F.col("source").eqNullSafe(F.col("s3")) & (F.col("bucket") == F.col("b3")) & (F.col("nth") == F.col("n3")), "left")
        .join(goal, F.col("source").eqNullSafe(F.col("s4")), "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))
    )
