"""Exact top-k search by inner product over length buckets.

Vectors become integers, so scores are exact. Candidates are dealt to cells in order of length
(Euclidean norm), the longest first. Every query meets the longest cell first; its k-th best score
there is its threshold, and it goes on only to the cells whose longest vector, times the query's
length, reaches it: a prefix of the cells. Queries that need equally many cells share a query cell,
and each pair of cells that is needed is one bounded task. In a task the candidates fall into
buckets of similar length, longest first. With a query's k-th best score so far, a bucket's local
cosine threshold is that score over both lengths: above 1 the bucket goes; a high threshold prunes
by the query's largest coordinates, a low one by length alone. What is left is multiplied out. Every
bucket has this exact way; nothing is capped.

Defined cases: null vectors and those with null or non-finite components take no part; missing
components of shorter vectors count as 0; rows of the query's own id are no candidates; repeated
rows are rows of their own, as candidates and as queries, and rows of one query id are ranked
together; equal scores go to the smaller vec_id; components whose floor is beyond a long become the
nearest long, and so do scores; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint_dir

CELL, QUERY_CELL, BUCKET = 8192, 1024, 256
SCHEMA = "query_id long, vec_id long, score long"
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    """Floats while they hold the components exactly, else Python's integers."""
    large = any(len(r) and (max(r) >= 2**53 or min(r) <= -(2**53)) for r in rows)
    out = np.zeros((len(rows), dim), object if large else float)
    for i, r in enumerate(rows):
        out[i, : len(r)] = list(map(int, r)) if large else r
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: in floats while every partial sum is an integer below 2**53, else in Python's integers."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    if a.dtype != object and b.dtype != object and np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return a @ b.T
    whole = lambda m: m if m.dtype == object else np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return whole(a) @ whole(b).T


def cell_top(cands: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top k of one cell of candidates for one cell of queries."""
    if not len(cands) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    dim = max(1, max(map(len, cands.v)), max(map(len, queries.v)))
    c, q = _matrix(cands.v, dim), _matrix(queries.v, dim)
    cid, qid = cands.vec_id.to_numpy(), queries.vec_id.to_numpy()
    least = queries.least.to_numpy() if "least" in queries else np.full(len(q), LEAST)
    order = np.lexsort((cid, -np.linalg.norm(c.astype(float), axis=1)))
    c, cid = c[order], cid[order]
    near_c, near_q = c.astype(float), q.astype(float)
    clen, qlen = np.linalg.norm(near_c, axis=1), np.linalg.norm(near_q, axis=1)
    unit_c = near_c / np.maximum(clen, 1e-12)[:, None]
    unit_q = near_q / np.maximum(qlen, 1e-12)[:, None]
    focus = np.abs(near_q).argmax(axis=1)
    best: list[list] = [[] for _ in qid]  # (-score, vec_id), at most k
    for lo in range(0, len(c), BUCKET):
        hi = min(lo + BUCKET, len(c))
        floor = np.array([max(-b[-1][0] if len(b) == k else LEAST, int(t)) for b, t in zip(best, least)], dtype=float)
        floor[floor <= LEAST] = -np.inf
        product = qlen * clen[lo]
        local = np.full(len(q), -np.inf)
        np.divide(floor, product, out=local, where=product > 0)
        live = np.flatnonzero(~((floor > product * (1 + 1e-9)) & np.isfinite(floor)))
        if not len(live):
            continue
        scores = None
        for j, i in enumerate(live):
            t = local[i]
            if t > 0.5:  # coordinate pruning: |c_f - q_f cos| <= sin sin for the unit vectors
                f, x = focus[i], unit_q[i, focus[i]]
                slack = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - x * x)) + 1e-9
                cos = unit_c[lo:hi, f]
                # over all cosines from t to 1, c_f is at least x t - slack if x > 0 and at most x t + slack if x < 0
                keep = lo + np.flatnonzero((cos >= x * t - slack) if x > 0 else (cos <= x * t + slack))
                if not len(keep):
                    continue
                s = _products(q[i : i + 1], c[keep])[0]
            else:  # length pruning: the bucket is a prefix in order of length
                end = hi if not np.isfinite(floor[i]) or qlen[i] == 0 else lo + int(np.searchsorted(-clen[lo:hi], -(floor[i] / qlen[i]) * (1 - 1e-9), side="right"))
                if scores is None:
                    scores = _products(q[live], c[lo:hi])
                keep, s = np.arange(lo, max(lo, end)), scores[j][: max(0, end - lo)]
            other = cid[keep] != qid[i]
            keep, s = keep[other], s[other]
            bar = [-best[i][-1][0]] if len(best[i]) == k else []
            bar += [int(least[i])] if least[i] > LEAST else []
            if bar:
                enough = s >= max(bar)
                keep, s = keep[enough], s[enough]
            if len(s):
                top = np.lexsort((cid[keep], np.array([-int(v) for v in s], dtype=object) if s.dtype == object else -s))[:k]
                best[i] = sorted(best[i] + [(-int(s[p]), int(cid[keep[p]])) for p in top])[:k]
    rows = [(int(qid[i]), v, min(max(-s, LEAST), MOST)) for i, b in enumerate(best) for s, v in b]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    v = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    v = v.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    n = v.count()
    cells, qcells = max(1, -(-n // CELL)), max(1, -(-n // (every * QUERY_CELL)))
    # Edges are quantiles of (length, hash), so copies of one vector spread over cells; there is one for some thousand vectors.
    keyed = v.withColumn("at", -F.col("length") - F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / (1 << 20))
    edges = np.array(keyed.approxQuantile("at", [i / cells for i in range(1, cells)], 1 / (4 * cells)) if cells > 1 else [])
    celled = keyed.withColumn("cell", F.pandas_udf(lambda at: pd.Series(np.searchsorted(edges, at.to_numpy()).astype("int32")), "int")("at") if cells > 1 else F.lit(0))
    longest = np.zeros(cells)
    for r in celled.groupBy("cell").agg(F.max("length").alias("length")).collect():
        longest[r.cell] = r.length
    reach = np.maximum.accumulate(longest[::-1])[::-1]  # of a cell and all after it

    def met(cands: DataFrame, queries: DataFrame) -> DataFrame:
        return cands.groupBy("cell", "qcell").cogroup(queries.groupBy("cell", "qcell")).applyInPandas(lambda c, q: cell_top(c, q, k), SCHEMA)

    every_qcell = F.explode(F.sequence(F.lit(0), F.lit(qcells - 1)))
    queries = v.filter(F.col("vec_id") % every == 0)
    hashed = queries.withColumn("qcell", F.pmod(F.xxhash64("vec_id"), F.lit(qcells)).cast("int")).withColumn("cell", F.lit(0)).withColumn("least", F.lit(LEAST))
    first = _best(met(celled.filter("cell = 0").withColumn("qcell", every_qcell).select("cell", "qcell", "vec_id", "v"), hashed.select("cell", "qcell", "vec_id", "v", "least")), k)
    if cells == 1:
        return first
    path = f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
    first.drop("rank").write.parquet(f"{path}/first")
    first = spark.read.parquet(f"{path}/first")
    least = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))

    def needed(least: pd.Series, length: pd.Series) -> pd.Series:
        """How many cells, from the longest on, may hold a score of at least that."""
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = least.to_numpy(float) / length.to_numpy(float) * (1 - 1e-9)
        cut = np.searchsorted(-reach, -np.nan_to_num(bound, nan=-np.inf, posinf=0.0, neginf=-np.inf), side="right")
        return pd.Series(np.where(least.to_numpy(float) > 0, cut, cells).astype("int32"))

    wanted = queries.join(least.withColumnRenamed("query_id", "q"), F.col("vec_id") == F.col("q"), "left").withColumn("least", F.coalesce("least", F.lit(LEAST)))
    wanted.select("vec_id", "v", "least", F.pandas_udf(needed, "int")("least", "length").alias("cells")).filter("cells > 1").write.parquet(f"{path}/queries")
    wanted = spark.read.parquet(f"{path}/queries").withColumn("at", F.col("cells") + F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / (1 << 20))
    parts = np.array(wanted.approxQuantile("at", [i / qcells for i in range(1, qcells)], 1 / (4 * qcells)) if qcells > 1 else [])
    wanted = wanted.withColumn("qcell", F.pandas_udf(lambda at: pd.Series(np.searchsorted(parts, at.to_numpy()).astype("int32")), "int")("at") if len(parts) else F.lit(0))
    most = np.zeros(qcells, np.int64)
    for r in wanted.groupBy("qcell").agg(F.max("cells").alias("cells")).collect():
        most[r.qcell] = r.cells
    to = F.pandas_udf(lambda cell: pd.Series([np.flatnonzero(most > c).astype("int32") for c in cell]), "array<int>")
    cands = celled.filter("cell > 0").withColumn("qcell", F.explode(to("cell"))).select("cell", "qcell", "vec_id", "v")
    asked = wanted.withColumn("cell", F.explode(F.sequence(F.lit(1), F.col("cells") - 1))).select("cell", "qcell", "vec_id", "v", "least")
    return _best(first.unionByName(met(cands, asked)), k)
