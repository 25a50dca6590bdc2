"""Pairs within groups, without a row per pair and without a group in one task,
and connected components of the links found."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywatch.llm.common import materialize, release


def tiled(members: DataFrame, keys: list[str], by: str, tiles: Column) -> DataFrame:
    """``members`` of groups ``keys`` dealt to ``tiles`` tiles by a hash of ``by``, once for every pair of tiles
    (ti <= tj) that its own (tile) is in; so every pair of members meets in exactly one pair of tiles."""
    n = F.greatest(tiles.cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64(by, F.lit(11)), n).cast("int")
    rows = members.withColumn("n_tiles", n).withColumn("tile", own)
    other = F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))
    rows = rows.select("*", other.alias("other"))
    return rows.select(*members.columns, "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"))


def each_group(rows: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """``fn`` for the rows of each group. Like grouping with applyInPandas, but many small groups share a batch.
    ``order``: a group's parts by these columns come one after the other, in their order, in one task."""

    parts = [*keys, *order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        held_key = None
        out: list[pd.DataFrame] = []
        n_out = 0
        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            new[0] = True
            for k in parts:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            cuts = [*np.flatnonzero(new).tolist(), len(pdf)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = pdf.iloc[a:b]
                key = tuple(part[k].iloc[0] for k in parts)
                if held and key != held_key:
                    got = fn(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))
                    if got is not None and len(got):
                        out.append(got)
                        n_out += len(got)
                    held = []
                    if n_out > 10_000:
                        yield pd.concat(out, ignore_index=True)
                        out, n_out = [], 0
                held.append(part)
                held_key = key
        if held:
            got = fn(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))
            if got is not None and len(got):
                out.append(got)
        if out:
            yield pd.concat(out, ignore_index=True)
        release()

    return rows.repartition(*keys).sortWithinPartitions(*parts).mapInPandas(run, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of edges (a, b) on 0..n-1."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = root(x), root(y)
        if i != j:
            up[max(i, j)] = min(i, j)
            out.append((x, y))
    return out


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the smallest node of its component.

    Alternating stars: every node hangs its larger neighbours, then its smaller ones, on its smallest; the edges
    shrink to one star per component in a logarithmic number of rounds. Each round is two aggregates and two joins
    on the edges, written to the checkpoint folder; nothing is collected but a count and a checksum."""
    def undirected(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def mark(e: DataFrame) -> tuple:
        # exact in the sum of 64-bit hashes, as decimals
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = mark(e)
    if not seen[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = undirected(e)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, name)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = down.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), name)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
