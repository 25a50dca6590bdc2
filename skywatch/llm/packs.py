"""Texts packed a few megabytes to a row, and questions about all of them.

Operators that need a fact about every position of every text (is this string
also in an earlier document, how often does this n-gram occur) would drown in
rows if each position were one. Here a *pack* holds some megabytes of whole
texts, compressed, and a task asks its questions as arrays:

* :func:`pack` writes the packs once, as a table bucketed by pack in the
  checkpoint folder, so packs are read again without another shuffle and a
  lost executor costs only its tasks;
* :func:`ask` runs a function over each pack that returns keys and values;
  keys are made unique within the pack first (a hot key costs one entry a
  pack, however many documents hold it) and dealt out by ranges of a hash;
* :func:`answer` gathers each range of keys (one row per pack and range) and
  returns one small array per row, in the order the keys were asked in;
* :func:`settle` brings the answers back to the packs.

The number of ranges follows the number of bytes, so a range's arrays stay
some tens of megabytes at any input size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywatch.llm.common import release
from skywatch.session import default_parallelism, scratch_path

PACK = "pack long, n_docs long, n_bytes long, body binary"
RANGE_BYTES = 24 << 20  # bytes of text whose questions meet in one range
BUCKET_BYTES = 24 << 20  # bytes of text whose packs one task reads
NO_ID = np.iinfo(np.int64).max  # a null id: after all others


class Pack:
    """The texts of one pack, in ascending order of id; ``data`` has them one after the other."""

    def __init__(self, body: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(body)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.ids = np.frombuffer(raw, "<i8", n, 8)
        lens = np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        rest = np.frombuffer(raw, "<i8", n, 8 + 16 * n)
        at = 8 + 24 * n
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        total = int(self.ends[-1]) if n else 0
        self.data = np.frombuffer(raw, np.uint8, total, at)
        self._rest, self._at, self._raw = np.concatenate(([0], np.cumsum(rest))), at + total, raw

    def rest(self, i: int) -> str | None:
        """The other columns of a row, as JSON."""
        a, b = self._rest[i], self._rest[i + 1]
        return self._raw[self._at + a:self._at + b].decode()

    def chunks(self, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Ranges of documents (first, past the last) of about ``size`` bytes; a longer document is a range of its own."""
        first, n = 0, len(self.ids)
        while first < n:
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + size, "right")))
            yield first, last
            first = last


def _body(ids: list[int], texts: list[bytes], rests: list[bytes]) -> bytes:
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    head = [len(ids), *[ids[i] for i in order], *[len(texts[i]) for i in order], *[len(rests[i]) for i in order]]
    raw = np.array(head, "<i8").tobytes() + b"".join([texts[i] for i in order]) + b"".join([rests[i] for i in order])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def pack(docs: DataFrame, id_col: str, text_col: str, pack_bytes: int = 4 << 20, keep: list[str] | None = None, name: str = "packs", gather: bool = False) -> DataFrame:
    """(pack, n_docs, n_bytes, body), bucketed by pack; one pack holds ``pack_bytes`` of text, or one longer text.
    A null text is empty. ``keep``: columns that :meth:`Pack.rest` gives back. ``gather``: one file a bucket, for a
    shuffle of the packs; small packs are almost a file each otherwise."""
    spark = docs.sparkSession

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k = TaskContext.get().partitionId(), 0
        ids, texts, rests, size = [], [], [], 0

        def out() -> pd.DataFrame:
            nonlocal ids, texts, rests, size, k
            pdf = pd.DataFrame({"pack": [(part << 32) + k], "n_docs": [len(ids)], "n_bytes": [size], "body": [_body(ids, texts, rests)]})
            ids, texts, rests, size, k = [], [], [], 0, k + 1
            return pdf

        for pdf in batches:
            for i, text, rest in zip(pdf["id"], pdf["text"], pdf["rest"], strict=True):
                if ids and size + len(text) > pack_bytes:
                    yield out()
                ids.append(int(i))
                texts.append(bytes(text))
                rests.append(rest.encode())
                size += len(text)
        if ids:
            yield out()
        release()

    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in keep])) if keep else F.lit("")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), rest.alias("rest"))
    # A bucket is what one task reads; plans' size estimates can be off by any factor, so the bytes are counted.
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n = max(default_parallelism(spark), min(1 << 16, math.ceil(size / BUCKET_BYTES)))
    table, path = f"packs_{uuid.uuid4().hex}", scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    made = rows.mapInPandas(packed, PACK)
    made = made.repartition(n, "pack") if gather else made
    made.write.bucketBy(n, "pack").option("path", path).option("compression", "none").format("parquet").saveAsTable(table)
    packs = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay: the table is external and already resolved
    return packs


def ranges(packs: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """Number of ranges to deal keys out to, from the packs' bytes."""
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    return max(default_parallelism(packs.sparkSession), math.ceil(total / range_bytes))


def deal(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    """The range of each 64-bit key."""
    return ((keys >> np.uint64(32)) % np.uint64(n_ranges)).astype(np.int64)


def dealt(pack_id: int, parts: np.ndarray, n_ranges: int, encode: Callable[[np.ndarray], bytes]) -> pd.DataFrame:
    """One row per range that gets any entry; ``encode`` gets the entries' places, in order."""
    order = np.argsort(parts, kind="stable")
    cuts = np.searchsorted(parts[order], np.arange(n_ranges + 1))
    some = np.flatnonzero(np.diff(cuts))
    return pd.DataFrame({"part": some, "pack": np.full(len(some), pack_id), "v": [encode(order[cuts[i]:cuts[i + 1]]) for i in some]})


ASK = "part long, pack long, v binary"
ANSWER = "pack long, part long, v binary"


def ask(packs: DataFrame, fn: Callable[[int, Pack], Iterator[pd.DataFrame]]) -> DataFrame:
    """Rows of ASK: what ``fn`` yields for each pack."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, body in zip(pdf["pack"], pdf["body"], strict=True):
                yield from fn(int(k), Pack(bytes(body)))
                release()

    return packs.select("pack", "body").mapInPandas(asked, ASK)


def answer(asked: DataFrame, fn: Callable[[Iterator[bytes]], list[bytes]]) -> DataFrame:
    """Rows of ANSWER: for each range, ``fn`` gets all packs' entries, a batch in memory at a time, and returns as many answers."""

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packs, parts = [], []

        def entries() -> Iterator[bytes]:
            for pdf in batches:
                packs.append(pdf["pack"].to_numpy())
                parts.append(pdf["part"].to_numpy())
                yield from map(bytes, pdf["v"])

        got = fn(entries())
        release()
        yield pd.DataFrame({"pack": np.concatenate(packs), "part": np.concatenate(parts), "v": got})
        del got
        release()

    return asked.groupBy("part").applyInPandas(answered, ANSWER)


def settle(packs: DataFrame, answers: DataFrame, fn: Callable[[int, Pack, dict[int, bytes]], Iterator[pd.DataFrame] | pd.DataFrame], schema: str) -> DataFrame:
    """Rows that ``fn`` returns for each pack and its answers by range."""

    def settled(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = dict(zip(right["part"].tolist(), map(bytes, right["v"]), strict=True))
        out = fn(int(key[0]), Pack(bytes(left["body"].iloc[0])), got)
        release()
        return out

    return packs.select("pack", "body").groupBy("pack").cogroup(answers.groupBy("pack")).applyInPandas(settled, schema)
