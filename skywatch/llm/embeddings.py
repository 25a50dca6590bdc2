"""Operator 8: near-duplicate embeddings by a subspace pigeonhole join.

Vectors of equal label are linked if their cosine, in double precision, is at
least 0.98. For unit vectors that is a squared distance of at most
2 - 2 * 0.98. Vectors are normalised and rotated by a fixed random rotation
(which spreads every direction over all coordinates) and cut into ``BLOCKS``
blocks. A block of a share s of the dimensions gets a share s of the squared
distance: of any pair within the whole budget at least one block is within its
own (pigeonhole), so the union of the blocks' range joins misses no pair.

The range joins compare *codes*, one byte a coordinate, in two steps that write
a vector's own numbers at most once for each vector that has a near one:

* *Candidates.* Codes of a label lie in tiles; a task holds one tile and meets
  half of the others, so that each pair of tiles meets once and a code is
  written about half as often as its label has tiles. In a pair of tiles each
  block is a range join on the cells of a k-d tree over the block's principal
  axes. Budgets are widened by what rounding to a code can change, so no pair
  is lost. A task returns a spanning forest of its candidates, never pairs.
* *Verification.* Vectors are fetched for the connected components of the
  candidates only. Within a component all pairs are settled by their exact
  cosine; a large component is cut into tiles and cells as above, under the
  whole budget. Tasks return numbers of links and spanning forests.

Equal vectors (of a label) are one class throughout, however many there are;
rows find their class by a 128-bit digest of the vector.

Result per vector: n_links (other vectors linked directly), component_id
(smallest id reachable by links), kept (the id is that).

Cases: null labels, null or zero vectors and vectors with null or non-finite
components link with nothing and are components of their own; vectors of
different length are never linked; a null id sorts last, and is the
component_id only where no other is reachable (then kept is true); rows that
repeat an id count as vectors of their own; an empty table gives an empty
result; other columns are ignored. The table is read twice.
"""

from __future__ import annotations

import functools
import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.llm.common import materialize, small_batches, table
from skywatch.llm.groups import components, each_group
from skywatch.llm.packs import NO_ID
from skywatch.session import default_parallelism, scratch_path

COSINE = 0.98
BLOCKS = 4
TILE = 1 << 19  # vectors of 64 dimensions whose codes a task holds at a time; an eighth of them if not codes
FINE = 8  # vectors in a leaf of a k-d tree
CELL_LEVELS = 4  # of the tree within a cell
BOX_DIMS = 6  # dimensions of boxes, at most
ROWS = 1024  # vectors compared with a cell at a time
DENSE = 0.02  # share of near pairs from which a comparison is passed on as a whole
HELD = 100_000  # near pairs passed on together
PACK = 1 << 16  # vectors whose codes leave a task together
SMALL = 32  # vectors in a component that is settled beside others
BIN = 4096  # vectors of small components settled together
SUB = 14  # bits: vectors fetched together
BUCKET_BYTES = 24 << 20  # bytes of vectors that one task looks through
SLACK = 1e-9


@functools.cache
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(8).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def budget(dims: int, a: int, b: int, cosine: float) -> float:
    """Squared distance allowed in dimensions a..b."""
    return (2 - 2 * cosine + SLACK) * (b - a) / dims


def code_step(dims: int) -> float:
    """Width of a code's step: codes reach three times a coordinate's mean square; what lies beyond is moved to the
    end, which brings no two vectors further apart."""
    return min(1.0, 3 / math.sqrt(dims)) / 127


def code_budget(dims: int, a: int, b: int, cosine: float) -> float:
    """Squared distance allowed in dimensions a..b between codes: each can be half a step off in each dimension."""
    return (math.sqrt(budget(dims, a, b, cosine)) + math.sqrt(b - a) * code_step(dims)) ** 2


def _units(values: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors; values of one length."""
    v = np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype("<f8")
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow or underflow in the squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _codes(units: np.ndarray) -> np.ndarray:
    dims = units.shape[1]
    return np.clip(np.rint(units @ rotation(dims) / code_step(dims)), -127, 127).astype(np.int8)


def _axes(points: np.ndarray) -> np.ndarray:
    """Orthonormal axes, those along which the points vary most first."""
    mean = points.mean(0, dtype=np.float64)
    return np.linalg.eigh(points.T @ points / np.float32(len(points)) - np.outer(mean, mean))[1][:, ::-1].astype(np.float32)


def _n_tiles(n: int, dims: int, most: int) -> int:
    return max(1, -(-n * max(dims, 64) // (64 * max(1, most))))


def _tile_of(cls: np.ndarray, tiles: int) -> np.ndarray:
    h = cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(tiles)).astype(np.int64)


def _meetings(tile: int, tiles: int) -> list[tuple[int, int]]:
    """(tile that a task holds, step): where a tile goes. Step 0 is the held tile itself; then each pair of tiles once."""
    return [((tile - step) % tiles, step) for step in range(tiles // 2 + 1) if not step or 2 * step < tiles or tile >= step]


class _Cells:
    """Points in the order of a k-d tree's leaves, which are FINE points each; a few leaves beside each other are a cell."""

    def __init__(self, points: np.ndarray) -> None:
        self.n, w = points.shape
        self.leaves = -(-self.n // FINE)
        levels = math.ceil(math.log2(self.leaves))
        self.dims = min(w, BOX_DIMS, max(1, round(levels / 4)))
        leaf, order = np.arange(self.n) // FINE, np.arange(self.n)
        apart = 4.0 * float(np.abs(points[:, :self.dims]).max()) + 1
        for level in range(levels):
            order = order[np.argsort(((leaf << level) // self.leaves) * apart + points[order, level % self.dims])]
        order = np.append(order, np.full(self.leaves * FINE - self.n, order[-1]))  # the last leaf is filled up
        points = points[order]
        self.order, self.points = order.reshape(-1, FINE), points
        cells = max(0, levels - CELL_LEVELS)
        self.starts = -((-(np.arange(1 << cells) * self.leaves)) >> cells)
        self.ends = np.append(self.starts[1:], self.leaves)
        boxed = points[:, :BOX_DIMS].T.reshape(min(w, BOX_DIMS), -1, FINE)
        self.low, self.high = boxed.min(2), boxed.max(2)
        self.cell_low, self.cell_high = np.minimum.reduceat(self.low, self.starts, 1), np.maximum.reduceat(self.high, self.starts, 1)

    def factors(self, first: bool) -> np.ndarray:
        """The product of a row of the first side's and one of the other side's is minus half their squared distance."""
        half = np.einsum("ij,ij->i", self.points, self.points)[:, None] / np.float32(-2)
        return np.hstack((self.points, half, np.ones_like(half)) if first else (self.points, np.ones_like(half), half))


def _apart(low: np.ndarray, high: np.ndarray, of: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Squared distances of the boxes ``of`` to another box: no two points within are nearer."""
    far = np.zeros(len(of), np.float32)
    for d in range(len(other_low)):
        gap = np.maximum(np.maximum(low[d].take(of) - other_high[d], other_low[d] - high[d].take(of)), 0)
        far += gap * gap
    return far


def _close(left: np.ndarray, right: np.ndarray | None, most: float, open_: Callable[[np.ndarray, np.ndarray], np.ndarray | None] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """All pairs whose squared distance is at most ``most``, and few others beyond it by rounding; each once: (row of left,
    row of right) of many, None, or where most are near (rows of left, rows of right, matrix of pairs). Without ``right``,
    pairs within left. ``open_``: which of some leaves of left are still of interest beside rows of right, None for all.
    Points are single precision, of lengths up to about one."""
    if not len(left) or right is not None and not len(right):
        return
    a = _Cells(left)
    b = a if right is None else _Cells(right)
    most = most + 2e-6 * (left.shape[1] + 16)
    depth, width = max(a.dims, b.dims), left.shape[1] + 2
    factors, other_factors = a.factors(True).reshape(-1, FINE * width), b.factors(False)
    every, sizes, rows_of, others_of = np.arange(len(a.starts)), a.ends - a.starts, a.order.ravel(), b.order.ravel()
    xs, ys, n_held = [], [], 0
    for k, (start, end) in enumerate(zip((b.starts * FINE).tolist(), np.minimum(b.ends * FINE, b.n).tolist(), strict=True)):
        low, high, others = b.cell_low[:depth, k], b.cell_high[:depth, k], others_of[start:end]
        cells = every[k if right is None else 0:]
        cells = cells[_apart(a.cell_low, a.cell_high, cells, low, high) <= most]
        n = sizes[cells]
        leaves = np.arange(n.sum()) + np.repeat(a.starts[cells] - np.cumsum(n) + n, n)
        leaves = leaves[_apart(a.low, a.high, leaves, low, high) <= most]
        if open_ is not None and len(leaves):
            some = open_(a.order[leaves], others)
            leaves = leaves if some is None else leaves[some]
        turned = np.ascontiguousarray(other_factors[start:end].T)
        for i in range(0, len(leaves), ROWS // FINE):
            of = leaves[i:i + ROWS // FINE]
            got = factors.take(of, 0).reshape(-1, width) @ turned
            some = np.flatnonzero(got.reshape(len(of), -1).max(1) >= -most / 2)
            if not len(some):
                continue
            place = (of[some][:, None] * FINE + np.arange(FINE)).ravel()
            hits = got.reshape(len(of), -1)[some].reshape(len(place), -1) >= -most / 2
            hits, place = hits[place < a.n], place[place < a.n]
            if right is None:
                hits &= place[:, None] > np.arange(start, end)
            if np.count_nonzero(hits) > DENSE * got.size:
                yield rows_of[place], others, hits
                continue
            x, y = np.nonzero(hits)
            xs.append(rows_of[place[x]])
            ys.append(others[y])
            n_held += len(x)
        if n_held > HELD:
            yield np.concatenate(xs), np.concatenate(ys), None
            xs, ys, n_held = [], [], 0
    if n_held:
        yield np.concatenate(xs), np.concatenate(ys), None


def _pairs(rows: np.ndarray, others: np.ndarray, hits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if hits is None:
        return rows, others
    i, j = np.nonzero(hits)
    return rows[i], others[j]


class _Forest:
    """Components of 0..n-1 as edges come, and the edges of a spanning forest."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.x, self.y = [], []

    def root(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                break
            r = s
        self.up[x] = r
        return r

    def new(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.root(x) != self.root(y)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            i, j = self.root(x), self.root(y)
            some = i != j
            x, y, high, low = x[some], y[some], np.maximum(i, j)[some], np.minimum(i, j)[some]
            high, first = np.unique(high, return_index=True)  # each root is hung once a round, on a smaller one
            self.up[high] = low[first]
            self.x.append(x[first])
            self.y.append(y[first])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *self.x]), np.concatenate([none, *self.y])


class _Candidates:
    """For tiles of codes, the held one first: a spanning forest of the candidates in the held tile and between it and
    each other one. An object per task."""

    def __init__(self, cosine: float) -> None:
        self.cosine, self.held = cosine, None

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame | None:
        dims, step = int(pdf["dims"].iloc[0]), int(pdf["step"].iloc[0])
        cls = np.frombuffer(b"".join(map(bytes, pdf["cls"])), "<i8")
        codes = np.frombuffer(b"".join(map(bytes, pdf["codes"])), np.int8).reshape(-1, dims)
        key = tuple(pdf[["label", "dims", "held"]].iloc[0])
        if not step:
            self.held = (key, cls, codes)
            x, y = self._forest(codes, None, dims).edges()
            return pd.DataFrame({"a": cls[x], "b": cls[y]})
        held_key, held_cls, held = self.held or (None, None, None)
        if held_key != key:
            return None  # the held tile is empty
        x, y = self._forest(held, codes, dims).edges()
        both = np.concatenate((held_cls, cls))
        return pd.DataFrame({"a": both[x], "b": both[y]})

    def _forest(self, left: np.ndarray, right: np.ndarray | None, dims: int) -> _Forest:
        shift = 0 if right is None else len(left)
        step, other = code_step(dims), left if right is None else right
        forest = _Forest(shift + len(other))
        most = code_budget(dims, 0, dims, self.cosine) / step ** 2

        def open_(rows: np.ndarray, others: np.ndarray) -> np.ndarray | None:
            of = forest.root(others + shift)
            return None if (of != of[0]).any() else (forest.root(rows) != of[0]).any(1)

        for a, b in blocks(dims):
            axes = _axes(left[:, a:b]) * np.float32(step)
            turned = [None if v is None else v[:, a:b].astype(np.float32) @ axes for v in (left, right)]
            for rows, others, hits in _close(*turned, code_budget(dims, a, b, self.cosine), open_):
                x, y = _pairs(rows, others, hits)
                some = forest.new(x, y + shift)
                x, y = x[some], y[some]
                d = left[x].astype(np.int32) - other[y]
                near = (d * d).sum(1) <= most
                forest.add(x[near], y[near] + shift)
        return forest


class _Links:
    """For components, or tiles of a large one, the held one first: numbers of links by exact cosine, and a spanning
    forest of them. An object per task."""

    def __init__(self, cosine: float, kind: str) -> None:
        self.cosine, self.kind, self.held = cosine, kind, None

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame | None:
        step = int(pdf["step"].iloc[0])
        if pdf["bin"].iloc[0] < 0:
            pdf = pdf.sort_values("root", ignore_index=True)
        key, units = tuple(pdf[["dims", "bin", "held"]].iloc[0]), _units([bytes(v) for v in pdf["vec"]], self.kind)
        pdf = pdf.drop(columns="vec")
        if key[1] < 0:
            return self._small(pdf, units)
        if not step:
            self.held = (key, pdf, units)
            return self._large(pdf, units, None)
        held_key, held, left = self.held or (None, None, None)
        return self._large(pd.concat((held, pdf), ignore_index=True), left, units) if held_key == key else None

    def _exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", a, b) >= self.cosine

    def _small(self, pdf: pd.DataFrame, units: np.ndarray) -> pd.DataFrame | None:
        root, size, n = pdf["root"].to_numpy(), pdf["size"].to_numpy(), len(pdf)
        forest, links = _Forest(n), np.zeros(n, np.int64)
        for off in range(1, n):
            x = np.flatnonzero(root[off:] == root[:-off])
            if not len(x):
                break
            x = x[self._exact(units[x], units[x + off])]
            links[x] += size[x + off]
            links[x + off] += size[x]
            forest.add(x, x + off)
        return self._result(pdf, links, forest)

    def _large(self, pdf: pd.DataFrame, left: np.ndarray, right: np.ndarray | None) -> pd.DataFrame | None:
        size, shift, other = pdf["size"].to_numpy(), 0 if right is None else len(left), left if right is None else right
        forest, links = _Forest(len(pdf)), np.zeros(len(pdf), np.int64)
        axes = _axes(left)
        turned = [None if v is None else v.astype(np.float32) @ axes for v in (left, right)]
        for rows, others, hits in _close(*turned, budget(left.shape[1], 0, left.shape[1], self.cosine)):
            if hits is None:
                some = self._exact(left[rows], other[others])
                x, y = rows[some], others[some] + shift
                np.add.at(links, x, size[y])
                np.add.at(links, y, size[x])
            else:  # cosines of many by one product; what is close to the limit once more, one by one
                got = left[rows] @ other[others].T
                i, j = np.nonzero(hits & (np.abs(got - self.cosine) < 1e-9))
                hits &= got >= self.cosine
                hits[i, j] = self._exact(left[rows[i]], other[others[j]])
                # whole numbers in double precision
                links[rows] += (hits @ size[others + shift].astype(np.float64)).astype(np.int64)
                links[others + shift] += (size[rows].astype(np.float64) @ hits).astype(np.int64)
                x, y = _pairs(rows, others + shift, hits)
            some = forest.new(x, y)
            forest.add(x[some], y[some])
        return self._result(pdf, links, forest)

    def _result(self, pdf: pd.DataFrame, links: np.ndarray, forest: _Forest) -> pd.DataFrame | None:
        some, (x, y) = np.flatnonzero(links), forest.edges()
        if not len(some):
            return None
        cls, least = pdf["cls"].to_numpy(), pdf["least"].to_numpy()
        return pd.DataFrame({"a": np.concatenate((cls[some], cls[x])), "b": np.concatenate((least[some], cls[y])), "links": np.concatenate((links[some], np.zeros(len(x), np.int64)))})


def _rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, kind: str) -> DataFrame:
    """(id, label, digest, vec): a vector's bytes and their digest, null for vectors that link with nothing."""
    numbers = F.col(vec_col) if kind == "<f4" else F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(label_col).cast("string").alias("label"), numbers.alias("v"))

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, label = batch.column("v"), batch.column("label")
            ends = v.offsets.to_numpy()
            # -0.0 and 0.0 are one value; the bytes then stand for the vector
            x = v.values.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)
            bad, some = (np.append(0, np.cumsum(t)) for t in (~np.isfinite(x), x != 0))
            fine = (bad[ends[1:]] == bad[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]])
            fine &= v.is_valid().to_numpy(zero_copy_only=False) & label.is_valid().to_numpy(zero_copy_only=False)
            raw, at = memoryview(x.tobytes()), (ends.astype(np.int64) * x.itemsize).tolist()
            vec = [bytes(raw[a:b]) if ok else None for a, b, ok in zip(at[:-1], at[1:], fine.tolist(), strict=True)]
            digest = [None if b is None else hashlib.blake2b(b, digest_size=16).digest() for b in vec]
            yield pa.RecordBatch.from_arrays([batch.column("id"), label, pa.array(digest, pa.binary()), pa.array(vec, pa.binary())], ["id", "label", "digest", "vec"])

    return rows.mapInArrow(as_bytes, "id long, label string, digest binary, vec binary")


def _classes(rows: DataFrame, n_numbers: int, kind: str) -> DataFrame:
    """(cls, sub, label, dims, digest, vec, least, size), bucketed by sub: a row per different vector of a label."""
    spark, width = rows.sparkSession, np.dtype(kind).itemsize
    classes = rows.where("vec is not null").groupBy("label", "digest", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    classes = classes.withColumn("dims", (F.length("vec") / width).cast("int")).withColumn("cls", F.monotonically_increasing_id()).withColumn("sub", F.shiftright("cls", SUB))
    n = max(default_parallelism(spark), min(1 << 16, math.ceil(n_numbers * width / BUCKET_BYTES)))
    table_, path = f"classes_{uuid.uuid4().hex}", scratch_path(spark, f"embedding-classes-{uuid.uuid4().hex}")
    classes.write.bucketBy(n, "sub").option("path", path).format("parquet").saveAsTable(table_)
    classes = spark.table(table_)
    spark.sql(f"DROP TABLE {table_}")  # the files stay: the table is external and already resolved
    return classes


def _coded(classes: DataFrame, tiles: dict[tuple[str, int], int], kind: str) -> DataFrame:
    """(label, dims, held, step, cls, codes): packs of classes and codes of one tile, a row for each task that it meets in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0

        def out() -> Iterator[pd.DataFrame]:
            for (label, dims, tile), got in parts.items():
                cls, codes = (b"".join(x[i].tobytes() for x in got) for i in (0, 1))
                for held, step in _meetings(tile, tiles.get((label, dims), 1)):
                    yield pd.DataFrame({"label": [label], "dims": [dims], "held": [held], "step": [step], "cls": [cls], "codes": [codes]})

        for pdf in batches:
            for dims, part in pdf.groupby("dims"):
                dims, all_cls, all_codes = int(dims), part["cls"].to_numpy(), _codes(_units([bytes(v) for v in part["vec"]], kind))
                for label, at in part.groupby("label").indices.items():
                    cls, codes = all_cls[at], all_codes[at]
                    of = _tile_of(cls, tiles.get((label, dims), 1))
                    for tile in np.unique(of).tolist():
                        parts.setdefault((label, dims, tile), []).append((cls[of == tile], codes[of == tile]))
            n += len(pdf)
            if n >= PACK:
                yield from out()
                parts, n = {}, 0
        yield from out()

    return classes.mapInPandas(run, "label string, dims int, held int, step int, cls binary, codes binary")


def _fetched(classes: DataFrame, candidates: DataFrame, n_bins: int, tile: int) -> DataFrame:
    """(dims, bin, held, step, root, cls, size, least, vec) of the candidates (cls, root, n: vectors in the component).
    Small components share bins, of negative numbers."""
    schema = "dims int, bin long, held int, step int, root long, cls long, size long, least long, vec binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def fetch(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = left.merge(right[["cls", "root", "n"]], on="cls")
        if not len(got):
            return pd.DataFrame(columns=names)
        got["bin"] = np.where(got["n"] <= SMALL, -1 - _tile_of(got["root"].to_numpy(), n_bins), got["root"])
        out = []
        for (n, dims), part in got.groupby(["n", "dims"]):
            tiles = 1 if n <= SMALL else _n_tiles(int(n), int(dims), tile)
            of = _tile_of(part["cls"].to_numpy(), tiles)
            for k in np.unique(of).tolist():
                out += [part[of == k].assign(held=held, step=step) for held, step in _meetings(k, tiles)]
        return pd.concat(out)[names]

    few = classes.select("sub", "cls", "dims", "size", "least", "vec").groupBy("sub")
    return few.cogroup(candidates.withColumn("sub", F.shiftright("cls", SUB)).groupBy("sub")).applyInPandas(fetch, schema)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``."""
    kind = "<f4" if vectors.select(vec_col).dtypes[0][1] == "array<float>" else "<f8"
    small_batches(vectors.sparkSession, 4000)
    rows = _rows(vectors, id_col, vec_col, label_col, kind)
    classes = _classes(rows, vectors.agg(F.sum(F.size(vec_col))).first()[0] or 0, kind)
    per_label = classes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * F.greatest("dims", F.lit(64)) > 64 * TILE)
    tiles = {(r["label"], r["dims"]): _n_tiles(r["n"], r["dims"], TILE) for r in per_label.collect()}
    coded = _coded(classes.select("cls", "label", "dims", "vec"), tiles, kind)
    found = each_group(coded, ["label", "dims", "held"], _Candidates(cosine), "a long, b long", ("step",))
    near = materialize(components(found, "embedding-candidates").select(F.col("node").alias("cls"), "root"), "embedding-near")
    n_bins = max(1, -(-near.count() // BIN))
    count = near.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("root", "n_root")
    near = near.join(count, F.col("root") == F.col("n_root")).select("cls", "root", "n")
    fetched = _fetched(classes, near, n_bins, max(1, TILE // 8))
    found = materialize(each_group(fetched, ["dims", "bin", "held"], _Links(cosine, kind), "a long, b long, links long", ("step",)), "embedding-links")
    linked = found.where("links > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"), F.min("b").alias("least"))
    roots = components(found.where("links = 0").select("a", "b"), "embedding-components").select(F.col("node").alias("r_cls"), "root")
    linked = materialize(linked.join(roots, F.col("cls") == F.col("r_cls")).select("cls", "links", "least", "root"), "embedding-linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "c_root")
    linked = linked.join(least, F.col("root") == F.col("c_root")).select(F.col("cls").alias("l_cls"), "links", "component")
    info = classes.join(linked, F.col("cls") == F.col("l_cls"), "left") \
        .select(F.col("label").alias("i_label"), F.col("digest").alias("i_digest"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    out = rows.drop("vec").join(info, (F.col("label") == F.col("i_label")) & (F.col("digest") == F.col("i_digest")), "left")
    component = F.coalesce("component", "id")
    null = lambda c: F.when(c != F.lit(int(NO_ID)), c)
    return out.select(null(F.col("id")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      null(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
