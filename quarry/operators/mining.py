"""Template mining: a prefix tree trained on a bounded sample, then frozen and matched everywhere.

Clusters are looked up by token count and up to three leading tokens (tokens with digits count as
wildcards). Within a leaf the cluster with most equal positions wins, then the one with fewer
wildcards, then the older; at least ``similarity`` of the positions must be equal. Positions that
differ become wildcards; one that saw exactly two values in a large cluster is a category and
keeps its value in the template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import patterns as P

WILD = "<*>"
TRAINING_LINES = 20_000
_MASKS = [re.compile(m) for m in P.MASKS]
_SEPARATORS = re.compile(P.SEPARATORS)


def tokenise(line: str) -> list[str]:
    for m in _MASKS:
        line = m.sub(WILD, line)
    return _SEPARATORS.split(line.strip())


@dataclass
class Cluster:
    tokens: list[str]
    count: int = 1
    seen: dict[int, set[str] | None] = field(default_factory=dict)  # None: too many values
    categories: frozenset[int] = frozenset()

    def absorb(self, tokens: list[str], most: int = 2) -> None:
        self.count += 1
        for i, (a, b) in enumerate(zip(self.tokens, tokens)):
            if a != b:
                if a != WILD:
                    self.seen[i], self.tokens[i] = {a}, WILD
                values = self.seen.get(i)
                if values is not None:
                    values.add(b)
                    if len(values) > most:
                        self.seen[i] = None


class Miner:
    def __init__(self, depth: int = 3, branches: int = 30, similarity: float = 0.4):
        self.depth, self.branches, self.similarity = depth, branches, similarity
        self.root: dict = {}
        self.clusters: list[Cluster] = []

    def _leaf(self, tokens: list[str], grow: bool) -> list[Cluster] | None:
        node = self.root.setdefault(len(tokens), {}) if grow else self.root.get(len(tokens))
        for t in tokens[: self.depth]:
            if node is None:
                return None
            key = WILD if any(c.isdigit() for c in t) else t
            if key not in node:
                if not grow:
                    key = WILD
                elif len(node) >= self.branches:
                    key = WILD
            node = node.setdefault(key, {}) if grow else node.get(key)
        if node is None:
            return None
        return node.setdefault(None, []) if grow else node.get(None)

    def _best(self, leaf: list[Cluster], tokens: list[str]) -> Cluster | None:
        ranked = [(sum(a == b != WILD for a, b in zip(c.tokens, tokens)), -c.tokens.count(WILD), -i) for i, c in enumerate(leaf)]
        top = max(ranked, default=None)
        return leaf[-top[2]] if top and top[0] >= self.similarity * len(tokens) else None

    def train(self, lines: list[str]) -> Miner:
        for line in lines:
            tokens = tokenise(line)
            leaf = self._leaf(tokens, True)
            hit = self._best(leaf, tokens)
            if hit:
                hit.absorb(tokens)
            else:
                leaf.append(Cluster(list(tokens)))
                self.clusters.append(leaf[-1])
        return self

    def state(self, least: int = 500) -> list[tuple[list[str], list[int]]]:
        return [(c.tokens, [i for i, v in c.seen.items() if v is not None and len(v) == 2 and c.count >= least]) for c in self.clusters]

    @classmethod
    def frozen(cls, state: list[tuple[list[str], list[int]]]) -> Miner:
        out = cls()
        for tokens, categories in state:
            c = Cluster(list(tokens), categories=frozenset(categories))
            out._leaf(c.tokens, True).append(c)
            out.clusters.append(c)
        return out

    def match(self, line: str) -> str:
        tokens = tokenise(line)
        leaf = self._leaf(tokens, False)
        hit = self._best(leaf, tokens) if leaf else None
        if hit is None:
            return " ".join(WILD if any(c.isdigit() for c in t) else t for t in tokens)
        return " ".join(t if i in hit.categories else c for i, (c, t) in enumerate(zip(hit.tokens, tokens)))


def train(ev: DataFrame, column: str = "probe", lines: int = TRAINING_LINES) -> list[tuple[list[str], list[int]]]:
    """Train on the first lines in file order. The sample is the operator's own definition and is bounded."""
    sample = ev.filter(F.col(column).isNotNull()).orderBy("line_no").limit(lines).select(column)
    return Miner().train([r[0] for r in sample.collect()]).state()


def match(ev: DataFrame, state: list[tuple[list[str], list[int]]], column: str = "probe") -> DataFrame:
    """Add template. The frozen model is bounded by the training sample and travels with the tasks."""

    def rows(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        miner, memo = Miner.frozen(state), {}
        for f in frames:
            if len(memo) > 100_000:
                memo.clear()
            yield pd.Series([None if x is None else memo[x] if x in memo else memo.setdefault(x, miner.match(x)) for x in f])

    return ev.withColumn("template", _udf(rows)(F.col(column)))


def _udf(rows):
    from pyspark.sql.functions import pandas_udf

    rows.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(rows, "string")
