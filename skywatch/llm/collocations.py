"""Operator 11: collocations, mined from phrase counts in burstable tries.

Words, phrases of two, and phrases of three and four words are counted in one
pass over the texts each. A task gives the
words it meets ids of its own and counts phrases in a HAT-trie over the ids: a
hash container holds the phrases of a range of first words, and one that grows
too large bursts into 64 by the next six bits of its phrases' ids, so that
frequent words get containers of their own, by second word in the end. When the
task's tries hold :data:`MAX_ENTRIES` phrases, whole subtrees, the largest
first, are spilled as runs of (language, phrase, count), sorted by their words.
Runs are dealt out by the phrase's prefix (its first
two words) and merged there, by Spark's aggregation, to the exact counts.

A phrase of at least ``least`` occurrences has only parts of as many, so each
pass counts only phrases of which all parts of the pass before's length were
frequent in it. They are known by a bit map of hashes, 16 bits a phrase and at
most :data:`FILTER_BITS` (32 MB) however many phrases there are; a chance hit
costs a counted phrase and no exactness, since the merged counts decide.

Scores, the drop rule and the first rows per language are DataFrame functions
over the frequent phrases: joins of a cut's two parts with their counts, a
maximum over the longer phrases around each one, and a ranking in two steps,
within 64 shares of a language and then of the shares' best rows.

Cases: null texts are empty; a null language counts as ``und``; ids are not
read; rows that repeat count each time; ties are ordered by phrase; long texts
are counted whole, a megabyte at a time (memory is some times the text, not the
number of its words); a lone byte FF, which UTF-8 has not, parts words as a
full stop does; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skywatch.llm.common import materialize, release, table, without_collector

LONGEST = 4
LEAST = 30
TOP = 2000
SHARES = 64
MAX_ENTRIES = 1 << 19  # phrases a task holds before it spills
MAX_WORDS = 1 << 19  # words a task has ids for before it starts anew
BURST = 1 << 14  # entries of a container before it bursts
FILTER_BITS = 28  # 2^28 bits at most
STEP_BYTES = 1 << 21
RUNS = "lang string, phrase binary, n long"

RUN_ENTRIES = 1 << 15  # phrases of a run, or of one larger subtree

_BITS = 21  # of a word's id within a key
_SPAN = 6  # bits of a key that part the containers of a node
_UPPER = bytes(range(65, 91))
_CLEAN = bytes.maketrans(_UPPER + b".,;:!?\x0a\x0b\x0c\x0d", _UPPER.lower() + b"\n" * 10)
_BREAK = b"\xff"
_SPACE = re.compile(rb"[ \t\n]")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, _seed(lang))


class Filter:
    """A bit map of phrase hashes."""

    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.bits, self.data = bits, data

    @staticmethod
    def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
        """Place of each phrase, from the hashes of its words (one column a word)."""
        total = np.zeros(hashes.shape[1], np.uint64)
        for k in range(len(hashes)):
            total += hashes[k] * _FACTORS[k]
        total ^= total >> np.uint64(29)
        return ((total * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = self.slots(hashes, self.bits)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Words(dict):
    """Ids of a language's words in a task: -1 for a break and for words that the filter rejects."""

    def __init__(self, lang: str, known: Filter) -> None:
        super().__init__({_BREAK: -1})
        self.lang, self.known, self.words, self.hashes = lang, known, [], []

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        """Ids of the tokens, those of new words given out."""
        ids = np.fromiter(map(self.get, tokens, repeat(-2)), np.int64, len(tokens))
        at = np.flatnonzero(ids == -2)
        if len(at):
            fresh = [tokens[i] for i in at.tolist()]
            new, seed = list(set(fresh)), _seed(self.lang)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in new), np.uint64, len(new))
            for w, h, known in zip(new, hashes.tolist(), self.known(hashes[None, :]).tolist(), strict=True):
                if known:
                    self[w] = len(self.words)
                    self.words.append(w)
                    self.hashes.append(h)
                else:
                    self[w] = -1
            ids[at] = [self[w] for w in fresh]
        return ids


class HatTrie:
    """Counts of phrases of ``length`` word ids.

    A phrase is a key: its leading id (its first word; of four words, the number of their first two), then the ids after
    it. A node is a container (a hash table of keys) or, once burst, containers by six more bits of the keys."""

    def __init__(self, length: int) -> None:
        self.length, self.size = length, 0
        self.rest = _BITS * min(length - 1, 2)
        self.root: dict[int, dict | list] = {}
        self.heads: dict[int, int] = _Numbers()

    def keys(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys of the phrases that start at the places."""
        key = ids[at]
        if self.length == 4:
            pairs = (key << _BITS | ids[at + 1]).tolist()
            key = np.fromiter(map(self.heads.__getitem__, pairs), np.int64, len(pairs))
        for k in range(1 if self.length < 4 else 2, self.length):
            key = key << _BITS | ids[at + k]
        return key

    def add(self, keys: np.ndarray) -> None:
        self._add(self.root, np.sort(keys), self.rest + _SPAN)

    def _add(self, children: dict, keys: np.ndarray, shift: int) -> None:
        """Sorted keys to the children, which part them by the bits from ``shift`` on."""
        top = keys >> shift
        starts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
        ends = [*starts[1:].tolist(), len(keys)]
        for slot, a, b in zip(top[starts].tolist(), starts.tolist(), ends, strict=True):
            node = children.get(slot)
            if node is None:
                node = children[slot] = Counter()
            if type(node) is Counter:
                before = len(node)
                node.update(keys[a:b].tolist())
                self.size += len(node) - before
                if len(node) > BURST and shift >= _SPAN:
                    children[slot] = self._burst(node, shift - _SPAN)
            else:
                self._add(node, keys[a:b], shift - _SPAN)

    @staticmethod
    def _burst(node: Counter, shift: int) -> dict:
        children: dict[int, Counter] = {}
        for key, n in node.items():
            child = children.get(key >> shift)
            if child is None:
                child = children[key >> shift] = Counter()
            child[key] = n
        return children

    def _containers(self, node: Counter | dict) -> Iterator[Counter]:
        if type(node) is Counter:
            yield node
        else:
            for child in node.values():
                yield from self._containers(child)

    def spill(self, words: list[bytes], keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of whole subtrees, the largest first, until at most ``keep`` entries are left."""
        if not self.root:
            return
        sizes = {slot: sum(map(len, self._containers(node))) for slot, node in self.root.items()}
        order = np.argsort(np.array([*words, b""], object)[:-1], kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        texts = np.array([*words, None], object)
        pairs = np.fromiter(self.heads, np.int64, len(self.heads))
        run: list[Counter] = []
        for slot in sorted(sizes, key=sizes.get, reverse=True):
            if self.size <= keep:
                break
            run += self._containers(self.root.pop(slot))
            self.size -= sizes[slot]
            if sum(map(len, run)) >= RUN_ENTRIES:
                yield self._run(run, rank, texts, pairs)
                run = []
        if run:
            yield self._run(run, rank, texts, pairs)

    def _run(self, containers: list[Counter], rank: np.ndarray, texts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = sum(map(len, containers))
        keys = np.fromiter(chain.from_iterable(containers), np.int64, n)
        counts = np.fromiter(chain.from_iterable(c.values() for c in containers), np.int64, n)
        low, parts = (1 << _BITS) - 1, []
        for _ in range(self.rest // _BITS):
            parts.insert(0, keys & low)
            keys = keys >> _BITS
        parts[:0] = [pairs[keys] >> _BITS, pairs[keys] & low] if self.length == 4 else [keys]
        order = np.lexsort([rank[p] for p in reversed(parts)])
        phrases = np.empty(n, object)
        phrases[:] = list(map(b" ".join, zip(*[texts[p[order]] for p in parts], strict=True)))
        return phrases, counts[order]


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: int) -> int:
        self[key] = n = len(self)
        return n


def _tokens(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Words and breaks of the texts, some of them at a time."""
    data, at = _BREAK.join(b"" if t is None else t for t in texts).translate(_CLEAN), 0
    data = data.replace(_BREAK, b"\n")
    while at < len(data):
        cut = _SPACE.search(data, at + STEP_BYTES)
        end = cut.start() if cut else len(data)
        yield data[at:end].replace(b"\n", b" \xff ").split()
        at = end


def _by_lang(pdf: pd.DataFrame) -> Iterator[tuple[str, list[bytes]]]:
    for lang, part in pdf.groupby("lang", sort=False):
        yield lang, part["text"].tolist()


def _word_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words, and, without a phrase, of all words of a language."""
    held: dict[str, Counter] = {}

    def out(lang: str) -> pd.DataFrame:
        count = held.pop(lang)
        count.pop(_BREAK, None)
        words = sorted(count)
        phrases = np.empty(len(words) + 1, object)
        phrases[:-1] = words  # the last, without a phrase, holds the sum
        counts = np.fromiter(chain(map(count.__getitem__, words), [sum(count.values())]), np.int64, len(phrases))
        return pd.DataFrame({"lang": lang, "phrase": phrases, "n": counts})

    for pdf in without_collector(batches):
        for lang, texts in _by_lang(pdf):
            for words in _tokens(texts):
                held.setdefault(lang, Counter()).update(words)
                while sum(map(len, held.values())) > MAX_WORDS:
                    yield out(max(held, key=lambda x: len(held[x])))
    for lang in list(held):
        yield out(lang)
    release()


def _phrase_runs(lengths: tuple[int, ...], known_words: Filter, known_parts: Filter | None):
    """Counts phrases of the lengths; ``known_parts``: of phrases one word shorter than the shortest of them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Words] = {}
        tries: dict[tuple[str, int], HatTrie] = {}

        def spilled(keep: int) -> Iterator[pd.DataFrame]:
            for (lang, _), trie in tries.items():
                for phrases, counts in trie.spill(words[lang].words, keep):
                    yield pd.DataFrame({"lang": lang, "phrase": phrases, "n": counts})

        for pdf in without_collector(batches):
            for lang, texts in _by_lang(pdf):
                last = np.zeros(0, np.int64)
                for tokens in _tokens(texts):
                    before = [words[lang].words[i] if i >= 0 else _BREAK for i in last]
                    if sum(map(len, words.values())) + sum(len(t.heads) for t in tries.values()) > MAX_WORDS:
                        yield from spilled(0)
                        words.clear(), tries.clear()
                    if lang not in words:
                        words[lang] = Words(lang, known_words)
                        tries |= {(lang, length): HatTrie(length) for length in lengths}
                    own = words[lang]
                    last = own.ids(before)
                    seen, ids = len(last), np.concatenate((last, own.ids(tokens)))
                    last = ids[max(0, len(ids) - max(lengths) + 1):]
                    for length in lengths:
                        start = max(0, seen - length + 1)  # phrases that end in the new tokens
                        n = len(ids) - length + 1 - start
                        if n <= 0:
                            continue
                        ok = np.ones(n, bool)
                        for k in range(length):
                            ok &= ids[start + k:start + k + n] >= 0
                        at = np.flatnonzero(ok) + start
                        if known_parts is not None and len(at):
                            h = np.array(own.hashes, np.uint64)[np.array([ids[at + k] for k in range(length)])]
                            part, fine = min(lengths) - 1, True
                            for k in range(length - part + 1):
                                fine = fine & known_parts(h[k:k + part])
                            at = at[fine]
                        if len(at):
                            trie = tries[lang, length]
                            trie.add(trie.keys(ids, at))
                    if sum(t.size for t in tries.values()) > MAX_ENTRIES:
                        yield from spilled(MAX_ENTRIES // (2 * len(tries)))
        yield from spilled(0)
        release()

    return run


def _merged(runs: DataFrame) -> DataFrame:
    """Counts of the phrases of all runs, dealt out by prefix."""
    rows = runs.select("lang", F.col("phrase").cast("string").alias("phrase"), "n")
    prefix = F.substring_index("phrase", " ", 2)
    return rows.repartition("lang", prefix).groupBy("lang", prefix.alias("prefix"), "phrase").agg(F.sum("n").alias("f")).drop("prefix")


def _filter_of(phrases: DataFrame) -> Filter:
    """The bit map of frequent phrases: at most 2^FILTER_BITS bits reach the driver, 8 KB a row."""
    count = phrases.count()
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(16 * count + 1))))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = [[_word_hash(lang, w) for w in bytes(p).split(b" ")] for lang, p in zip(pdf["lang"], pdf["phrase"], strict=True)]
            if h:
                at = np.unique(Filter.slots(np.array(h, np.uint64).T, bits))
                yield pd.DataFrame({"block": at >> 16, "bit": (at & 0xFFFF).astype(np.int32)})

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << 16, np.uint8)
        flags[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    found = phrases.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInPandas(slots, "block long, bit int").distinct()
    data = np.zeros(1 << (bits - 3), np.uint8)
    for r in found.groupBy("block").applyInPandas(block, "block long, flags binary").collect():
        data[r["block"] << 13:(r["block"] + 1) << 13] = np.frombuffer(r["flags"], np.uint8)
    return Filter(bits, data)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of up to ``longest`` words with f >= ``least``; with words 0 and no phrase
    the number of all words of a language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    found = materialize(_merged(rows.mapInPandas(_word_runs, RUNS)).where((F.col("f") >= least) | F.col("phrase").isNull()), "phrases-1")
    parts = [found.select("lang", F.when(F.col("phrase").isNull(), 0).otherwise(1).alias("words"), "phrase", "f")]
    known = _filter_of(found.where("phrase is not null"))
    known_words, known_parts = spark.sparkContext.broadcast(known), None
    passes = [(n,) for n in range(2, min(longest, 3))] + [tuple(range(min(longest, 3), longest + 1))] if longest > 1 else []
    for lengths in passes:
        counting = _counting(lengths, known_words, known_parts)
        found = materialize(_merged(rows.mapInPandas(counting, RUNS)).where(F.col("f") >= least), f"phrases-{lengths[0]}")
        parts.append(found.select("lang", F.size(F.split("phrase", " ")).alias("words"), "phrase", "f"))
        if lengths[-1] < longest:
            known_parts = spark.sparkContext.broadcast(_filter_of(found))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counting(lengths: tuple[int, ...], known_words, known_parts):
    """Function for mapInPandas that takes its filters from broadcasts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _phrase_runs(lengths, known_words.value, None if known_parts is None else known_parts.value)(batches)
    return run


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(counts: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score from :func:`phrase_counts`."""
    phrases = counts.where("words >= 1")
    candidates = phrases.where("words >= 2")
    # the lowest-scoring cut, the first of equal ones
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", k)
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"),
                       F.expr("substring_index(phrase, ' ', k - words)").alias("rest"))
    part = phrases.select(F.col("lang").alias("p_lang"), F.col("phrase").alias("p"), F.col("f").alias("p_f"))
    cuts = cuts.join(part, (F.col("lang") == F.col("p_lang")) & (F.col("first") == F.col("p"))).withColumnRenamed("p_f", "l").drop("p_lang", "p")
    cuts = cuts.join(part, (F.col("lang") == F.col("p_lang")) & (F.col("rest") == F.col("p"))).withColumnRenamed("p_f", "r").drop("p_lang", "p")
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # phrases that mostly occur within a longer one
    words = F.split("phrase", " ")
    size, start = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"), F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start")
    inner = candidates.where("words >= 3").select("lang", "phrase", "f", "words", size).select("*", start)
    inner = inner.select(F.col("lang").alias("i_lang"), F.array_join(F.slice(words, F.col("start"), F.col("size")), " ").alias("i"), "f")
    inner = inner.groupBy("i_lang", "i").agg(F.max("f").alias("around"))
    kept = best.join(inner, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i")), "left") \
        .where(F.coalesce(_exact(F.col("around")) * 100 < _exact(F.col("a")) * 80, F.lit(True)))
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select(F.col("lang").alias("n_lang"), F.col("f").alias("n"))
    return kept.join(totals, F.col("lang") == F.col("n_lang")) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(phrase_counts(table(spark, sf_dir, "documents").select("text", "lang")))


ORACLE_OP11 = """
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
    'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' '), chr(10))) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, range(1, 5) AS s(size) WHERE len(w) >= size)),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM candidates c JOIN range(1, 4) AS s(k) ON k < c.size
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT lang, w, f, m, unnest(range(1, size - m + 2)) AS i FROM candidates, range(2, 4) AS s(m) WHERE m < size) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
