"""Operator 9: removal of repeated byte strings, by winnowed fingerprints in place of distributed prefix doubling.

A byte goes if a string of ``LENGTH`` (50) bytes that covers it also starts in
a document with a smaller id. Texts are UTF-8 bytes; strings never cross
documents, overlap freely, and are judged on the input.

Prefix doubling names every position by its first k bytes, makes the name of
2k bytes from the pair (name at p, name at p + k), and lets Spark sort the
pairs to find which positions are still shared; a position whose name is
unique, or that has reached the threshold, drops out. That is not done here
(its cost has not been measured); the same result comes from fingerprints:

* names are made by doubling within a pack (1, 2, 4, 8, 16, 24, 48, 50 bytes;
  a name is a 64-bit polynomial fingerprint, alike in every pack);
* the first round compares only *anchors*: each window of 50 bytes picks one of
  its 27 24-byte names, the smallest by a hash (leftmost of equals), so equal
  windows pick equal names at equal places, and one position in 14 is enough.
  An anchor comes with the pair (name50 at the first window that picks it,
  name50 at the last), which names the whole stretch of its windows. Anchors
  that only one document has are done (unique); where all documents agree on
  the stretch, all its windows are settled at once (past the threshold);
* the second round compares the windows of the remaining stretches, by the pair
  that names 50 bytes, and settles each.

Both rounds are exact up to equal fingerprints of unequal strings (more than
80 bits are compared). A string that a third of all documents share costs one
entry a pack, not one a document; no group is ever listed pair by pair.

Cases: a null text is empty; texts under 50 bytes lose nothing; a null id is
larger than any other; rows of equal id do not repeat each other (no smaller
id) but both repeat earlier ones; repeated rows are reported once each;
an empty table gives an empty result; other columns are kept by
:func:`without_repeats`, those named like its results are replaced. The
remaining bytes may begin or end within a character: as text, such bytes are
left out. A long text is handled whole by one task, at up to a hundred times
its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.llm import packs as P
from skywatch.llm.common import materialize, release, table

LENGTH = 50
RANGE_BYTES = 16 << 20  # bytes of text whose anchors meet in one range: some 60 bytes are held for an anchor
NAME = 24
MANY = np.uint64(2)
PER_WINDOW = LENGTH - NAME + 1  # names in a window
SLICE = 1 << 18  # entries of a range that are sorted at once: some hundred bytes are held for each

_M = 0x9E3779B97F4A7C15 | 1
_T = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _pow(n: int) -> np.uint64:
    return np.uint64(pow(_M, n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Stretches:
    """The stretches of a pack: runs of windows (lo..hi, first bytes) that pick the same anchor."""

    def __init__(self, pack: P.Pack) -> None:
        lo, hi, doc, anchor, pair = [], [], [], [], []
        for first, last in pack.chunks(1 << 17):
            base, end = int(pack.starts[first]), int(pack.ends[last - 1])
            if end - base < LENGTH:
                continue
            data = pack.data[base:end]
            h1 = _T[data]
            h2 = h1[:-1] * _pow(1) + h1[1:]
            h4 = h2[:-2] * _pow(2) + h2[2:]
            h8 = h4[:-4] * _pow(4) + h4[4:]
            h16 = h8[:-8] * _pow(8) + h8[8:]
            name = h16[:-8] * _pow(8) + h8[16:]  # 24 bytes
            h48 = name[:-24] * _pow(24) + name[24:]
            h50 = h48[:-2] * _pow(2) + h2[48:]
            low = _mix(name) & np.uint64(0xFFFFFFFF00000000)
            low |= np.arange(len(low), dtype=np.uint64)
            for step in (1, 2, 4, 8):
                low = np.minimum(low[:-step], low[step:])
            low = np.minimum(low[:-(PER_WINDOW - 16)], low[PER_WINDOW - 16:])  # 16 names, then all 27
            picked = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
            n = len(picked)
            room = np.zeros(n + 1, np.int32)  # windows that lie within one document
            starts, ends = pack.starts[first:last] - base, pack.ends[first:last] - base
            long = ends - starts >= LENGTH
            room[starts[long]] += 1
            room[np.minimum(ends[long] - LENGTH + 1, n)] -= 1
            inside = np.cumsum(room[:n]) > 0
            new = np.empty(n, bool)
            new[0] = True
            new[1:] = (picked[1:] != picked[:-1]) | ~inside[:-1]
            new[starts[long]] = True
            a = np.flatnonzero(new & inside)
            last_of = np.empty(n, bool)  # a run ends where the next starts or windows end
            last_of[:-1] = new[1:] | ~inside[1:]
            last_of[-1] = True
            b = np.flatnonzero(last_of & inside)
            if not len(a):
                continue
            anchor.append(name[picked[a]])
            pair.append(_mix(h50[a]) * np.uint64(3) + _mix(h50[b] + np.uint64(0x1234567)) * np.uint64(5) + (b - a).astype(np.uint64))
            doc.append(np.searchsorted(pack.ends, a + base, "right"))
            lo.append(a + base)
            hi.append(b + base)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.lo, self.hi, self.doc = join(lo, np.int64), join(hi, np.int64), join(doc, np.int64)
        self.anchor, self.pair = _mix(join(anchor, np.uint64)), join(pair, np.uint64)
        self.id = pack.ids[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        # by anchor; documents come in order of id, so a group's first stretch is of its smallest
        self.order = np.argsort(self.anchor, kind="stable")
        key = self.anchor[self.order]
        self.heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.heads, len(key)))
        self.keys = key[self.heads]
        p = self.pair[self.order]
        self.agree = np.maximum.reduceat(p, self.heads) == np.minimum.reduceat(p, self.heads) if len(key) else np.zeros(0, bool)
        self.first_id = self.id[self.order][self.heads]
        self.last_id = np.maximum.reduceat(self.id[self.order], self.heads) if len(key) else np.zeros(0, np.int64)
        self.first_pair = p[self.heads]


def _entries(keys: np.ndarray, seconds: np.ndarray, ids: np.ndarray) -> bytes:
    """Count, number of distinct ids, ids, then per key 4 bytes of it, 6 of its second name, 2 or 4 of its id's place."""
    known, at = np.unique(ids, return_inverse=True)
    kind = "<u2" if len(known) <= 0xFFFF else "<u4"
    return b"".join([np.array([len(keys), len(known)], "<i8").tobytes(), known.astype("<i8").tobytes(), keys.astype("<u4").tobytes(),
                     np.ascontiguousarray(seconds.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), at.astype(kind).tobytes()])


def _read(v: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(v, "<i8", 2))
    at = 16
    known = np.frombuffer(v, "<i8", m, at)
    at += 8 * m
    keys = np.frombuffer(v, "<u4", n, at)
    at += 4 * n
    seconds = np.frombuffer(v, np.uint8, 6 * n, at).reshape(n, 6)
    at += 6 * n
    ids = known[np.frombuffer(v, "<u2" if m <= 0xFFFF else "<u4", n, at)]
    return keys.copy(), seconds.copy(), ids  # nothing that holds v


def _compare(parts: Iterator[bytes]) -> list[bytes]:
    """Two bits per entry: another document with a smaller id has the same key and second name; another document
    has the key but they are not all of one second name (even names mark entries that are several by themselves,
    MANY those of more than one id). All entries are held at their width, some SLICE at a time are sorted."""
    read = [_read(v) for v in parts]
    sizes = [len(k) for k, _, _ in read]
    keys, seconds, ids = zip(*read, strict=True)
    del read
    keys = np.concatenate(keys)
    seconds = np.concatenate(seconds)
    ids = np.concatenate(ids)
    release()
    bits = np.zeros((len(keys), 2), bool)
    slices = -(-len(keys) // SLICE)
    for i in range(slices):  # equal keys are in one slice
        at = np.flatnonzero(keys % np.uint32(slices) == i)
        if len(at):
            second = np.zeros((len(at), 8), np.uint8)
            second[:, :6] = seconds[at]
            bits[at] = _judge(keys[at], second.view("<u8")[:, 0], ids[at])
    cuts = np.cumsum([0, *sizes])
    return [np.packbits(bits[a:b].ravel()).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _judge(key: np.ndarray, second: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The two bits of each entry."""
    n = len(key)
    order = np.lexsort((second, key))
    k, s, d = key[order], second[order], ids[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new_name = new_key | np.concatenate(([True], s[1:] != s[:-1]))
    heads = np.flatnonzero(new_name)
    least = np.repeat(np.minimum.reduceat(d, heads), np.diff(np.append(heads, n)))
    one = (s & np.uint64(1)) == 1
    repeated = (d > least) & one
    heads = np.flatnonzero(new_key)
    width = np.diff(np.append(heads, n))
    mixed = (np.minimum.reduceat(s, heads) != np.maximum.reduceat(s, heads)) | ~np.logical_and.reduceat(one, heads)
    # an entry of one second name settles its larger ids by itself, one of MANY has them compared
    several = (np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)) | np.logical_or.reduceat(s == MANY, heads)
    bits = np.zeros((n, 2), bool)
    bits[order, 0] = repeated
    bits[order, 1] = np.repeat(mixed & several, width) & ~repeated
    return bits


def _replies(parts: np.ndarray, got: dict[int, bytes], n_ranges: int) -> np.ndarray:
    """The two bits of each entry, in the order the entries were asked in."""
    bits = np.zeros((len(parts), 2), bool)
    order = np.argsort(parts, kind="stable")
    cuts = np.searchsorted(parts[order], np.arange(n_ranges + 1))
    for part, v in got.items():
        at = order[cuts[part]:cuts[part + 1]]
        bits[at] = np.unpackbits(np.frombuffer(v, np.uint8), count=2 * len(at)).reshape(-1, 2)
    return bits


def _round_one(s: Stretches, got: dict[int, bytes], n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Per stretch: settled as repeated; its windows go to the second round."""
    bits = _replies(P.deal(s.keys, n_ranges), got, n_ranges)
    whole = np.repeat(s.agree, s.size)
    repeated = whole & (np.repeat(bits[:, 0], s.size) | (s.id[s.order] > np.repeat(s.first_id, s.size)))
    ask = np.where(s.agree, bits[:, 1], bits[:, 1] | (s.first_id != s.last_id))
    out, more = np.zeros(len(s.lo), bool), np.zeros(len(s.lo), bool)
    out[s.order] = repeated
    more[s.order] = np.repeat(ask, s.size) & ~repeated
    return out, more


class Windows:
    """The windows of some stretches, unique by the name of their 50 bytes."""

    def __init__(self, pack: P.Pack, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> None:
        n = hi - lo + 1
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        name, other = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for a in range(0, len(at), 1 << 19):
            p = at[a:a + (1 << 19)]
            left, right = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
            for j in range(LENGTH // 2):  # the pair (25 bytes at p, 25 bytes at p + 25)
                left = left * np.uint64(_M) + _T[pack.data[p + j]]
                right = right * np.uint64(_M) + _T[pack.data[p + LENGTH // 2 + j]]
            name[a:a + len(p)] = _mix(left) + _mix(right) * np.uint64(3)
            other[a:a + len(p)] = _mix(left * np.uint64(7) + right) | np.uint64(1)
        self.at = at
        ids = pack.ids[np.repeat(doc, n)]
        self.names, first, self.which = np.unique(name, return_index=True, return_inverse=True)
        self.second, self.first_id, self.ids = other[first], ids[first], ids


def _ask_stretches(n_ranges: int):
    def fn(k: int, pack: P.Pack) -> Iterator[pd.DataFrame]:
        s = Stretches(pack)
        second = np.where(s.agree, s.first_pair | np.uint64(1), np.where(s.first_id != s.last_id, MANY, np.uint64(0)))
        yield P.dealt(k, P.deal(s.keys, n_ranges), n_ranges, lambda i: _entries(s.keys[i], second[i], s.first_id[i]))
    return fn


def _ask_windows(n_ranges: int):
    def fn(k: int, pack: P.Pack, got: dict[int, bytes]) -> pd.DataFrame:
        s = Stretches(pack)
        _, more = _round_one(s, got, n_ranges)
        w = Windows(pack, s.lo[more], s.hi[more], s.doc[more])
        return P.dealt(k, P.deal(w.names, n_ranges), n_ranges, lambda i: _entries(w.names[i], w.second[i], w.first_id[i]))
    return fn


def _repeated_bytes(pack: P.Pack, first: dict[int, bytes], second: dict[int, bytes], n_ranges: int) -> np.ndarray:
    s = Stretches(pack)
    whole, more = _round_one(s, first, n_ranges)
    w = Windows(pack, s.lo[more], s.hi[more], s.doc[more])
    bits = _replies(P.deal(w.names, n_ranges), second, n_ranges)[:, 0]
    single = w.at[bits[w.which] | (w.ids > w.first_id[w.which])]
    cover = np.zeros(len(pack.data) + 1, np.int32)
    np.add.at(cover, s.lo[whole], 1)
    np.add.at(cover, s.hi[whole] + LENGTH, -1)
    np.add.at(cover, single, 1)
    np.add.at(cover, single + LENGTH, -1)
    return np.cumsum(cover[:-1]) > 0


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
                    with_text: bool = True, pack_bytes: int = 2 << 20, whole_characters: bool = False) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, with ``with_text`` also ``kept`` (the
    remaining bytes; where some were removed, with ``whole_characters`` without those that are no whole character),
    and ``rest`` (JSON of the columns ``keep``)."""
    packs = P.pack(docs, id_col, text_col, pack_bytes, keep, "suffix-packs", gather=True)
    n_ranges = P.ranges(packs, RANGE_BYTES)
    first = materialize(P.answer(P.ask(packs, _ask_stretches(n_ranges)), _compare), "suffix-anchors")
    second = materialize(P.answer(P.settle(packs, first, _ask_windows(n_ranges), P.ASK), _compare), "suffix-windows")
    # negative ranges mark the second round
    both = first.unionByName(second.select("pack", (-1 - F.col("part")).alias("part"), "v"))

    def finish(k: int, pack: P.Pack, got: dict[int, bytes]) -> pd.DataFrame:
        gone = _repeated_bytes(pack, {p: v for p, v in got.items() if p >= 0}, {-1 - p: v for p, v in got.items() if p < 0}, n_ranges)
        rows = []
        for i, (a, b) in enumerate(zip(pack.starts.tolist(), pack.ends.tolist(), strict=True)):
            out = gone[a:b]
            left = pack.data[a:b][~out].tobytes()
            n = b - a - len(left)
            spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()) if n else 0
            digest = hashlib.sha256(left).hexdigest()
            if with_text and whole_characters and n:
                left = left.decode("utf-8", "ignore").encode()
            rows.append((int(pack.ids[i]), b - a, n, spans, digest, left if with_text else None, pack.rest(i) if keep else None))
        return pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "rest"])

    done = P.settle(packs, both, finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, rest string")
    done = done.withColumn("id", F.when(F.col("id") != F.lit(int(P.NO_ID)), F.col("id")))
    return done if with_text else done.drop("kept")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, with_text=False).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
