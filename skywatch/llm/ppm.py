"""Operator 10: language-model scores by prediction by partial matching.

The model is a byte-context trie over the training texts (lower-cased A-Z,
every text preceded by a start mark and followed by an end mark). A byte is
predicted from its longest known context of up to ``ORDER`` bytes; where the
context has not seen the byte, an escape (estimated from the number of
different bytes seen there, method C) leads to the next shorter context, whose
counts then leave out all bytes the longer one has seen (symbol exclusion);
below the empty context all remaining bytes are equally likely. The model is
pretrained: its counts are those of all training texts. A document's score is
the log10 probability of all its bytes and its end. Beside it stands a base
score from word counts with additive smoothing.

How it runs: every pack of texts (see :mod:`skywatch.llm.packs`) asks for its
distinct (ORDER + 1)-byte strings and distinct words, with their training
counts. Strings meet by a hash of the whole string and are merged, the merged
strings meet by the last two bytes of their context, so that each group holds
whole branches of the trie from order two up, and come back with their code
length to the packs that asked. Orders one and zero are one table of at most
65,536 pair counts, summed by Spark; that is the only thing sent to all tasks.
Counts cover all training texts: nothing is pruned, sampled or capped.

Cases: a null text is empty and scores its end alone; a null id counts as
training text and not held out; without training texts every byte is equally
likely and the base score uses c = N = V = 0; repeated rows count as often as
they occur and are scored once each; the bytes FE and FF, which UTF-8 never
has and which are the marks here, count as FD in a text; a long text is held
whole by one task, at some 50 times its size; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.llm import packs as P
from skywatch.llm.common import materialize, table

ORDER = 5
PACK_BYTES = 8 << 20
START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
ALPHABET = 255  # the other 254 and the end mark

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[START:] = START - 1
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_T = np.random.default_rng(10).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = 0xD1342543DE82EF95


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and doc_id != P.NO_ID and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _grams(data: np.ndarray, lens: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of each predicted symbol with its context (text after text, the end mark last), and symbols per text."""
    n = len(lens)
    doc = np.repeat(np.arange(n), lens)
    out = np.full(len(data) + n * (order + 1), START, np.uint8)
    out[np.arange(len(data)) + (doc + 1) * order + doc] = _LOWER[data]
    out[np.cumsum(lens + order + 1) - 1] = END
    code = out[order:].astype(np.uint64)
    for j in range(1, order + 1):
        code |= out[order - j:len(out) - j].astype(np.uint64) << np.uint64(8 * j)
    return code[out[order:] != START], lens + 1


def _words(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each word, and words per text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(lens), np.int64)
    inside = ~_BLANK[data]
    begin = np.zeros(n + 1, bool)
    at = np.concatenate(([0], np.cumsum(lens)))
    begin[at] = True
    begin = begin[:n]
    begin[1:] |= ~inside[:-1]
    begin &= inside
    first = np.flatnonzero(begin)
    count = np.diff(np.concatenate(([0], np.cumsum(begin)))[at])
    if not len(first):
        return np.zeros(0, np.uint64), count
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n))) if first[0] == 0 else \
        np.arange(n) - np.concatenate((np.arange(first[0]), np.repeat(first, np.diff(np.append(first, n)))))
    place[~inside] = 0
    powers = np.full(int(place.max()) + 1, _M, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    value = _T[_LOWER[data]] * powers[place]
    value[~inside] = 0
    size = np.add.reduceat(inside.astype(np.uint64), first)
    return _mix(np.add.reduceat(value, first) + size * np.uint64(0x9E3779B97F4A7C15)), count


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    heads = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[heads], np.add.reduceat(n, heads) if len(k) else n


def _squeeze(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending keys as gaps, then values; compressed."""
    raw = np.array([len(keys)], "<u8").tobytes() + np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + values.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unsqueeze(v: bytes, kind: str = "<i8") -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(v)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view("<u8")[:, 0] if n else np.zeros(0, np.uint64)
    return np.cumsum(gaps, dtype=np.uint64), np.frombuffer(raw, kind, n, 8 + 8 * n)


def _chunk(pack: P.Pack, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = pack.ends[first:last] - pack.starts[first:last]
    trained = np.array([not is_held_out(int(i)) for i in pack.ids[first:last]])
    return pack.data[pack.starts[first]:pack.ends[last - 1]], lens, trained


def _distinct(keys: np.ndarray, trained: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of so many bits and how often each is in training texts."""
    if bits < 64 and len(keys):  # one sort, with the flag as the lowest bit
        both = np.sort(keys << np.uint64(1) | trained.astype(np.uint64))
        key = both >> np.uint64(1)
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[heads], np.add.reduceat((both & np.uint64(1)).astype(np.int64), heads)
    all_keys = np.unique(keys)
    own, n = np.unique(keys[trained], return_counts=True)
    out = np.zeros(len(all_keys), np.int64)
    out[np.searchsorted(all_keys, own)] = n
    return all_keys, out


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, bits: int) -> np.ndarray:
    """``values`` at the places of ``wanted`` (keys of so many bits, all of them known) in the ascending ``keys``.

    Some tens of thousands are sorted at a time, their places in the lowest bits, and searched in order: neighbours are
    found next to each other, where a search for each as it comes would go through all of the keys' memory."""
    out, block = np.empty(len(wanted), values.dtype), 1 << min(20, 64 - bits)
    for a in range(0, len(wanted), block):
        part = wanted[a:a + block]
        both = np.sort(part << np.uint64(64 - bits) | np.arange(len(part), dtype=np.uint64))
        key = both >> np.uint64(64 - bits)
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        found = values[np.searchsorted(keys, key[heads])]
        out[a + (both & np.uint64((1 << (64 - bits)) - 1)).astype(np.int64)] = np.repeat(found, np.diff(np.append(heads, len(key))))
    return out


def _names(pack: P.Pack, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings and words of a pack, as :func:`_asked` has them."""
    grams, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for first, last in pack.chunks():
        data, lens, _ = _chunk(pack, first, last)
        grams.append(np.unique(_grams(data, lens, order)[0]))
        words.append(np.unique(_words(data, lens)[0]))
    return np.unique(np.concatenate(grams)), np.unique(np.concatenate(words))


def _asked(pack: P.Pack, order: int) -> tuple[tuple, tuple, np.ndarray, int, int]:
    """(strings, counts), (words, counts), training counts of pairs, training words and texts."""
    grams, words, pairs, tokens, texts = ([], []), ([], []), np.zeros(65536, np.int64), 0, 0
    for first, last in pack.chunks():
        data, lens, trained = _chunk(pack, first, last)
        code, n = _grams(data, lens, order)
        own = np.repeat(trained, n)
        pairs += np.bincount((code[own] & np.uint64(0xFFFF)).astype(np.int64), minlength=65536)
        for out, got in zip(grams, _distinct(code, own, 8 * (order + 1)), strict=True):
            out.append(got)
        word, n = _words(data, lens)
        own = np.repeat(trained, n)
        tokens += int(own.sum())
        texts += int(trained.sum())
        for out, got in zip(words, _distinct(word, own), strict=True):
            out.append(got)
    return _merge(*grams), _merge(*words), pairs, tokens, texts


def _gram_parts(codes: np.ndarray, n_ranges: int) -> np.ndarray:
    return P.deal(_mix(codes), n_ranges)


def _parts_of(keys: np.ndarray, parts: np.ndarray, n_ranges: int) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(parts, kind="stable")  # keys stay ascending within a part
    cuts = np.searchsorted(parts[order], np.arange(n_ranges + 1))
    return [(p, order[cuts[p]:cuts[p + 1]]) for p in np.flatnonzero(np.diff(cuts)).tolist()]


class Trie:
    """Branches of the trie: all strings whose contexts end in certain two bytes, and the global pair counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int = ORDER) -> None:
        self.order = order
        self.levels: dict[int, tuple] = {}
        seen, n = codes[counts > 0], counts[counts > 0].astype(float)
        for k in range(order, 1, -1):
            if k < order:
                seen, n = _merge([seen & np.uint64((1 << 8 * (k + 1)) - 1)], [n])
            ctx = seen >> np.uint64(8)
            heads = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.zeros(0, np.int64)
            width = np.diff(np.append(heads, len(ctx)))
            self.levels[k] = (seen, n, ctx[heads], np.add.reduceat(n, heads) if len(n) else n, width.astype(float), heads)
        # orders one and zero, dense
        self.one = pairs.reshape(256, 256).astype(float)
        self.zero = self.one.sum(0)

    def _count(self, k: int, codes: np.ndarray) -> np.ndarray:
        """Training count of strings of k context bytes and a symbol."""
        if k == 1:
            return self.one[(codes >> np.uint64(8)).astype(np.int64) & 255, codes.astype(np.int64) & 255]
        if k == 0:
            return self.zero[codes.astype(np.int64) & 255]
        seen, n = self.levels[k][:2]
        if not len(seen):
            return np.zeros(len(codes))
        at = np.minimum(np.searchsorted(seen, codes), len(seen) - 1)
        return np.where(seen[at] == codes, n[at], 0.0)

    def _context(self, k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each string's context of k bytes: training symbols, distinct ones, and the training count, in the
        context one byte shorter, of the symbols that this one has seen."""
        if k == 0:
            return np.full(len(codes), self.zero.sum()), np.full(len(codes), float((self.zero > 0).sum())), np.zeros(len(codes))
        if k == 1:
            c = (codes >> np.uint64(8)).astype(np.int64) & 255
            return self.one.sum(1)[c], (self.one > 0).sum(1)[c].astype(float), ((self.one > 0) @ self.zero)[c]
        seen, _, ctx, total, distinct, heads = self.levels[k]
        if not len(seen):
            return np.zeros(len(codes)), np.zeros(len(codes)), np.zeros(len(codes))
        below = np.add.reduceat(self._count(k - 1, seen & np.uint64((1 << 8 * k) - 1)), heads)
        want = codes >> np.uint64(8)
        at = np.minimum(np.searchsorted(ctx, want), len(ctx) - 1)
        hit = ctx[at] == want
        return np.where(hit, total[at], 0.0), np.where(hit, distinct[at], 0.0), np.where(hit, below[at], 0.0)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each string's last symbol after its context."""
        out, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        less_n, less_d = np.zeros(len(codes)), np.zeros(len(codes))  # what the longer context excludes here
        for k in range(self.order, -1, -1):
            at = np.flatnonzero(open_)
            if not len(at):
                return out
            part = codes[at] & np.uint64((1 << 8 * (k + 1)) - 1)
            total, distinct, below = self._context(k, part)
            t, d = total - less_n[at], distinct - less_d[at]
            c = self._count(k, part)
            some = d > 0  # else nothing is left to predict here: on to the shorter context at no cost
            found = some & (c > 0)
            out[at[found]] += np.log10(c[found] / (t[found] + d[found]))
            gone = some & ~found
            out[at[gone]] += np.log10(d[gone] / (t[gone] + d[gone]))
            open_[at[found]] = False
            known = distinct > 0
            less_n[at[known]], less_d[at[known]] = below[known], distinct[known]
        at = np.flatnonzero(open_)
        out[at] -= np.log10(ALPHABET - less_d[at])
        return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document."""
    packs = P.pack(docs, id_col, text_col, pack_bytes, name="ppm-packs")
    n_ranges = P.ranges(packs)
    w0 = n_ranges  # words' ranges follow the strings'

    def questions(k: int, pack: P.Pack) -> Iterator[pd.DataFrame]:
        (codes, n), (words, m), pairs, tokens, texts = _asked(pack, order)
        rows = [(p, k, _squeeze(codes[i], n[i])) for p, i in _parts_of(codes, _gram_parts(codes, n_ranges), n_ranges)]
        rows += [(w0 + p, k, _squeeze(words[i], m[i])) for p, i in _parts_of(words, P.deal(words, n_ranges), n_ranges)]
        # counts of pairs, and at -70000 and -70001 of training words and texts, for Spark to sum
        rows += [(-1 - p, k, int(pairs[p]).to_bytes(8, "big")) for p in np.flatnonzero(pairs).tolist()]
        rows += [(-70000, k, tokens.to_bytes(8, "big")), (-70001, k, texts.to_bytes(8, "big"))]
        yield pd.DataFrame(rows, columns=["part", "pack", "v"])

    asked = materialize(P.ask(packs, questions), "ppm-asked")
    sums = dict(asked.where("part < 0").groupBy("part").agg(F.sum(F.conv(F.hex("v"), 16, 10).cast("long"))).collect())
    tokens, texts = sums.pop(-70000, 0), sums.pop(-70001, 0)
    pairs = np.zeros(65536, np.int64)
    for p, n in sums.items():
        pairs[-1 - p] = n

    def known_words(parts: list[bytes]) -> tuple[list[bytes], int]:
        read = [_unsqueeze(v) for v in parts]
        keys, n = _merge([k for k, _ in read], [m for _, m in read])
        return [zstandard.ZstdCompressor(level=1).compress(n[np.searchsorted(keys, k)].tobytes()) for k, _ in read], int((n > 0).sum())

    def word_counts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got, distinct = known_words([bytes(v) for v in pdf["v"]])
        own = pd.DataFrame({"pack": pdf["pack"], "part": pdf["part"], "v": got})
        return pd.concat([own, pd.DataFrame({"pack": [-1], "part": [int(key[0])], "v": [distinct.to_bytes(8, "big")]})])

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Strings of a range, summed, by the branch of the trie that they belong to."""
        read = [_unsqueeze(bytes(v)) for v in pdf["v"]]
        codes, n = _merge([k for k, _ in read], [m for _, m in read])
        branch = P.deal(_mix((codes >> np.uint64(8)) & np.uint64(0xFFFF)), n_ranges)
        return pd.DataFrame([(p, int(key[0]), _squeeze(codes[i], n[i])) for p, i in _parts_of(codes, branch, n_ranges)], columns=["branch", "part", "v"])

    def lengths(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Code length of each string of a branch, by the range it came from."""
        read = [_unsqueeze(bytes(v)) for v in pdf["v"]]
        codes, n = _merge([k for k, _ in read], [m for _, m in read])
        value = np.concatenate([np.zeros(0), Trie(codes, n, pairs, order).log10(codes)]).astype("<f4")
        return pd.DataFrame({"part": pdf["part"], "v": [_squeeze(k, value[np.searchsorted(codes, k)]) for k, _ in read]})

    def returned(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        read = [_unsqueeze(bytes(v), "<f4") for v in right["v"]]
        codes = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in read]])
        at = np.argsort(codes)
        codes, value = codes[at], np.concatenate([np.zeros(0, "<f4"), *[x for _, x in read]])[at].astype("<f4")
        return pd.DataFrame({"pack": left["pack"], "part": left["part"],
                             "v": [zstandard.ZstdCompressor(level=1).compress(value[np.searchsorted(codes, _unsqueeze(bytes(v))[0])].tobytes()) for v in left["v"]]})

    word_answers = materialize(asked.where(F.col("part") >= w0).groupBy("part").applyInPandas(word_counts, P.ANSWER), "ppm-words")
    distinct = word_answers.where("pack < 0").agg(F.sum(F.conv(F.hex("v"), 16, 10).cast("long"))).first()[0] or 0
    distinct += texts > 0  # the end
    strings = asked.where((F.col("part") >= 0) & (F.col("part") < w0))
    branches = strings.groupBy("part").applyInPandas(merged, "branch long, part long, v binary")
    costs = branches.groupBy("branch").applyInPandas(lengths, "part long, v binary")
    gram_answers = strings.groupBy("part").cogroup(costs.groupBy("part")).applyInPandas(returned, P.ANSWER)
    n_train = int(tokens + texts)
    below = np.log10(n_train + 0.5 * (int(distinct) + 1))

    def scored(k: int, pack: P.Pack, got: dict[int, bytes]) -> pd.DataFrame:
        codes, words = _names(pack, order)
        value, count = np.zeros(len(codes)), np.zeros(len(words), np.int64)
        for p, i in _parts_of(codes, _gram_parts(codes, n_ranges), n_ranges):
            value[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(got[p]), "<f4")
        for p, i in _parts_of(words, P.deal(words, n_ranges), n_ranges):
            count[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(got[w0 + p]), "<i8")
        out = []
        for first, last in pack.chunks():
            data, lens, trained = _chunk(pack, first, last)
            code, n = _grams(data, lens, order)
            total = np.add.reduceat(_looked_up(codes, value, code, 8 * (order + 1)), np.cumsum(n) - n)
            word, m = _words(data, lens)
            c = count[np.searchsorted(words, word)] if len(word) else np.zeros(0, np.int64)
            cuts = np.concatenate(([0], np.cumsum(m)))
            known = np.diff(np.concatenate(([0], np.cumsum(c > 0)))[cuts])
            base = np.zeros(len(m))
            if len(c):
                base[m > 0] = np.add.reduceat(np.log10(c + 0.5) - below, cuts[:-1][m > 0])
            base += np.log10(texts + 0.5) - below
            out.append(pd.DataFrame({"id": pack.ids[first:last], "held_out": ~trained, "n_tokens": m + 1, "n_known": known + (texts > 0),
                                     "train_tokens": n_train, "base_score": base, "score": total}))
        return pd.concat(out)

    answers = gram_answers.unionByName(word_answers.where("pack >= 0"))
    done = P.settle(packs, answers, scored, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.select(F.when(F.col("id") != F.lit(int(P.NO_ID)), F.col("id")).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
