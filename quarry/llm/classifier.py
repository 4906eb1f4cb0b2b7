"""Quality classifier: positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are rows labelled 1; labels 0 are never used. Unlabelled texts are a sample of
``documents`` itself. The class prior is estimated from both: a first model tells positives from
unlabelled texts, and on positives it hasn't seen the least ratio of unlabelled to positive texts
above a score bounds the prior, most closely where negatives have no share. Then the risk
pi R+(1) + max(0, Ru(0) - pi R+(0)) with the logistic loss is minimised by gradient steps on a
logistic model over rates of pairs of neighbouring character classes and a few counts of words and
lines. Both samples are bounded by ``max_rows`` ids each, in order of a hash of the id; of several
texts of one id the least is taken. Scoring reads whole texts.

Defined cases: null text counts as empty and gets a score; very long texts are read whole, in time
in proportion to their length; repeated rows give repeated rows; equal scores stay equal; a null
doc_id is never held out and never sampled; of several labels of one id the largest counts; without
labelled positives every score is 0.5; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 4000
#: Character classes that neighbours are counted by; signs not listed are one class, letters beyond ASCII another.
SIGNS = ".,!?|%#$&*-_'\"()/:;@<>"
CLASSES = 7 + len(SIGNS) + 1
COUNTS = 6


def _table() -> np.ndarray:
    out = np.full(256, CLASSES - 1, np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = 6 if b >= 0x80 else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 if c in " \t" else 4 if c in "\r\n" else 5 if b < 0x20 or b == 0x7F else 7 + SIGNS.index(c) if c in SIGNS else CLASSES - 1
    return out


TABLE = _table()


def features(text: str | None) -> np.ndarray:
    """Rates that don't depend on language, source or id."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds = TABLE[np.frombuffer(data, np.uint8)]
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES) if len(kinds) > 1 else np.zeros(CLASSES * CLASSES)
    words = data.split()
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = data.split(b"\n")
    counts = (same / n, len(set(words)) / n, min(30.0, len(data) / n) / 30, np.log1p(len(data)) / 10, 1 - len(set(lines)) / len(lines), float(not words))
    return np.concatenate([np.sqrt(pairs / max(1, len(kinds) - 1)), counts]).astype(np.float32)


def _fit(n: int, kind: np.dtype, gradient, steps: int, rate: float) -> np.ndarray:
    """Adam, full batch, to a rate of zero."""
    w, m, v = np.zeros(n, kind), 0.0, 0.0
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights (last one the intercept) that minimise the non-negative risk."""
    p, u = (np.c_[x, np.ones(len(x), x.dtype)] for x in (pos, unl))

    def gradient(w: np.ndarray) -> np.ndarray:
        gp, gu = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = -np.log(1 - gu + 1e-12).mean() + prior * np.log(1 - gp + 1e-12).mean()
        plus = -prior * p.T @ (1 - gp) / len(p)
        minus = u.T @ gu / len(u) - prior * p.T @ gp / len(p)
        return (plus + minus if negative >= 0 else -minus) + decay * w

    return _fit(p.shape[1], p.dtype, gradient, steps, rate)


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled, from positives and unlabelled texts alone."""
    if len(pos) < 20 or len(unl) < 20:
        return 0.5
    fit_p, new_p, fit_u, new_u = pos[::2], pos[1::2], unl[::2], unl[1::2]
    x = np.c_[np.r_[fit_p, fit_u], np.ones(len(fit_p) + len(fit_u), pos.dtype)]
    y = np.r_[np.ones(len(fit_p), pos.dtype), np.zeros(len(fit_u), pos.dtype)]
    weight = np.where(y == 1, 0.5 / len(fit_p), 0.5 / len(fit_u)).astype(pos.dtype)
    w = _fit(x.shape[1], x.dtype, lambda w: x.T @ (weight * (_sigmoid(x @ w) - y)) + 1e-2 * w, 200, 0.05)
    sp, su = np.sort(new_p @ w[:-1]), np.sort(new_u @ w[:-1])
    cuts = np.quantile(sp, np.linspace(0.02, 0.4, 20))
    share_p, share_u = 1 - np.searchsorted(sp, cuts) / len(sp), 1 - np.searchsorted(su, cuts) / len(su)
    return float(np.clip((share_u / share_p).min(), 0.05, 0.95))


def _ordered(ids: DataFrame, max_rows: int) -> DataFrame:
    return ids.filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float] | None:
    """Weights on features and the intercept, fit on rows outside the held-out fifth."""
    mine = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    plain = docs.select("doc_id", "text")
    trusted = labels.filter(mine & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    ids = _ordered(trusted, max_rows).withColumn("is_positive", F.lit(True)).unionByName(_ordered(plain.filter(mine).select("doc_id"), max_rows).withColumn("is_positive", F.lit(False)))
    of = F.pandas_udf(lambda texts: pd.Series([features(t).tobytes() for t in texts]), "binary")
    texts = plain.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "is_positive").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = texts.select("doc_id", "is_positive", of("text").alias("x")).toPandas().sort_values(["is_positive", "doc_id"])
    chosen = rows.is_positive.to_numpy(bool)
    if not chosen.any() or chosen.all():
        return None
    x = np.stack([np.frombuffer(v, np.float32) for v in rows.x])  # 3.6 KB a row, at most 2 * max_rows rows
    rng = np.random.default_rng(5)
    pos, unl = rng.permutation(x[chosen]), rng.permutation(x[~chosen])
    mean, scale = unl.mean(0), unl.std(0) + 0.01
    pos, unl = (pos - mean) / scale, (unl - mean) / scale
    w = nnpu(pos, unl, class_prior(pos, unl))
    return (w[:-1] / scale).astype(np.float64), float(w[-1] - (mean / scale) @ w[:-1])


def score(text: Column, model: tuple[np.ndarray, float] | None) -> Column:
    """0 to 1, higher where label 1 is likelier."""
    if model is None:
        return F.lit(0.5)
    weights, intercept = model

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([float(features(t) @ weights) for t in texts], dtype=float).add(intercept).clip(-30, 30).map(lambda z: 1 / (1 + np.exp(-z)))

    return F.pandas_udf(of, "double")(F.coalesce(text, F.lit("")))


def scored(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """docs with the score in column ``name``."""
    return docs.withColumn(name, score(F.col("text"), model))


def kept(docs: DataFrame, model, least: float = 0.3) -> DataFrame:
    """The documents with at least that score; their columns as they are."""
    return docs.filter(score(F.col("text"), model) >= least)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    plain = docs.select("doc_id", "text")
    return scored(plain, train(plain, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
