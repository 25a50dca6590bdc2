"""Operator 2: n-gram Jaccard join by MinHash banding.

Two documents are linked if the Jaccard similarity of their sets of word
5-grams is at least 0.8. Words are runs without ASCII white space, A-Z in
lower case; a text of fewer than five words has one shorter n-gram, a text
without words has none and links with nothing.

* One narrow pass hashes the n-grams of every whole text, takes 100 MinHash
  values in ``BANDS`` bands of ``ROWS`` rows (a pair of similarity 0.8 shares a
  band with probability 1 - (1 - 0.8^5)^20 = 0.9996, one of 0.4 with 0.19) and
  a 128-bit digest of the set. Documents with equal sets are one class from
  here on: a partial aggregate, however many copies there are.
* Class representatives are shuffled on (band, band hash). Buckets of more
  than one class are cut into tiles; in a pair of tiles, a pair of classes
  counts in the first band that they share and nowhere else, so most later
  buckets fall away before any set is moved.
* What is left is verified on the full n-gram sets, as bit sets within the pair
  of tiles. A task returns numbers of links and the edges of a spanning forest,
  never all pairs; the links of a class count its partners' copies.
* Connected components of the forests give the groups.

Result per document: class_id (smallest id of its group), n_links (other
documents of similarity 0.8 or more), kept (the id is the group's smallest),
set_id (smallest id with the same set).

Cases: a null text has no n-grams; a null id sorts last, and is null as
class_id where the whole group has none (then kept is true); rows that repeat
an id count as documents, and stay or go together if their texts are alike;
an empty table gives an empty result; a long text is handled whole by one
task, at some 40 times its size; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.llm.common import SHINGLE_WORDS, SIMILARITY, materialize, release, table
from skywatch.llm.groups import components, each_group, forest, tiled
from skywatch.llm.packs import NO_ID
from skywatch.llm.ppm import _mix, _words

BANDS, ROWS = 20, 5
TILE = 1024
TILE_BYTES = 16 << 20
STEP_BYTES = 1 << 20

_rng = np.random.default_rng(2)
_A = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_SIG = "id long, hash long, n long, k1 long, k2 long, bands binary"


def _steps(ids: list, texts: list) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, n-gram hashes ascending and distinct per text, number per text) by about a megabyte of text."""
    at = 0
    while at < len(ids):
        end, size = at, 0
        while end < len(ids) and (end == at or size + len(texts[end]) <= STEP_BYTES):
            size += len(texts[end])
            end += 1
        part = [bytes(t) for t in texts[at:end]]
        yield ids[at:end], *_sets(part)
        at = end


def _sets(texts: list[bytes], k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(t) for t in texts], np.int64)
    word, count = _words(np.frombuffer(b"".join(texts), np.uint8), lens)
    doc = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(count, k)[doc]  # words in an n-gram of this text
    whole = place + size <= count[doc]
    h = np.zeros(len(word), np.uint64)
    for j in range(k):
        use = j < size
        nxt = np.zeros(len(word), np.uint64)
        nxt[:max(0, len(word) - j)] = word[j:]
        h = np.where(use, _mix(h * np.uint64(0x9E3779B97F4A7C15) + nxt + np.uint64(j + 1)), h)
    h, doc = h[whole], doc[whole]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        h, doc = h[first], doc[first]
    return h, np.bincount(doc, minlength=len(texts)).astype(np.int64)


def _digests(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two digests and the band hashes of each non-empty set."""
    starts = (np.cumsum(n) - n)[n > 0]
    size = n[n > 0].astype(np.uint64)
    k1 = _mix(np.add.reduceat(_mix(h + np.uint64(17)), starts) + size)
    k2 = _mix(np.add.reduceat(_mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts) ^ size)
    low = (h >> np.uint64(32)).astype(np.uint32)
    bands = np.zeros((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            v = low * _A[i] + _B[i]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            key = _mix(key * np.uint64(31) + np.minimum.reduceat(v, starts))
        bands[:, b] = key
    return k1, k2, bands


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, h, n in _steps(list(zip(pdf["id"], pdf["hash"], strict=True)), pdf["text"].tolist()):
                out = pd.DataFrame({"id": [i for i, _ in rows], "hash": [x for _, x in rows], "n": n, "k1": 0, "k2": 0, "bands": b""})
                some = n > 0
                if some.any():
                    k1, k2, bands = _digests(h, n)
                    out.loc[some, "k1"], out.loc[some, "k2"] = k1.view(np.int64), k2.view(np.int64)
                    out.loc[some, "bands"] = [x.tobytes() for x in bands]
                yield out
            release()

    return _texts(docs, id_col, text_col).mapInPandas(run, _SIG)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the text's hash, which tells rows of one id, or without one, apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))


def _of_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts that may stand for a wanted set; however many rows share an id or have none, each is at most one set's."""
    return texts.join(wanted, (F.col("id") == F.col("set_id")) & (F.col("hash") == F.col("set_hash"))).select("cls", "k1", "k2", "text")


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of either tile; whether they are one tile."""
    ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
    tile = pdf["tile"].to_numpy()
    return np.flatnonzero(tile == ti), np.flatnonzero(tile == tj), ti == tj


def _new_pairs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one of either tile, that share no band before this one."""
    left, right, same = _sides(pdf)
    band = int(pdf["band"].iloc[0])
    keys = np.frombuffer(b"".join(map(bytes, pdf["bands"])), np.uint64).reshape(len(pdf), BANDS)
    fresh = np.ones((len(left), len(right)), bool)
    if same:
        fresh = np.triu(fresh, 1)
    for b in range(band):
        fresh &= keys[left, b][:, None] != keys[right, b][None, :]
    x, y = np.nonzero(fresh)
    return left[x], right[y]


def _needed(pdf: pd.DataFrame) -> pd.DataFrame | None:
    if len(pdf) < 2:
        return None
    x, y = _new_pairs(pdf)
    if not len(x):
        return None
    rows = np.unique(np.concatenate((x, y)))
    return pdf.iloc[rows]


def _verified(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame | None:
    if len(pdf) < 2:
        return None
    x, y = _new_pairs(pdf)
    if not len(x):
        return None
    sets = [np.frombuffer(bytes(v), np.uint64) for v in pdf["grams"]]
    n = np.array([len(s) for s in sets])
    # sizes alone rule out many pairs
    ok = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9
    x, y = x[ok], y[ok]
    if not len(x):
        return None
    if len(sets) == 2:
        common = np.array([len(np.intersect1d(sets[0], sets[1], assume_unique=True))])
    else:
        grams, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[which]
        owner = np.repeat(np.arange(len(sets)), n)
        width = int((times > 1).sum())
        common = np.zeros(len(x), np.int64)
        for a in range(0, width, 1 << 16):  # bit sets of some thousand n-grams at a time
            use = (place >= a) & (place < a + (1 << 16))
            bits = np.zeros((len(sets), min(1 << 16, (width - a + 63) // 64 * 64)), bool)
            bits[owner[use], place[use] - a] = True
            words = np.packbits(bits, axis=1).view(np.uint64)
            step = max(1, (1 << 22) // words.shape[1])
            for c in range(0, len(x), step):
                common[c:c + step] += np.bitwise_count(words[x[c:c + step]] & words[y[c:c + step]]).sum(1, dtype=np.int64)
    linked = common >= similarity * (n[x] + n[y] - common) - 1e-9
    x, y = x[linked], y[linked]
    if not len(x):
        return None
    cls, size = pdf["cls"].to_numpy(), pdf["size"].to_numpy()
    links = np.bincount(x, weights=size[y], minlength=len(pdf)) + np.bincount(y, weights=size[x], minlength=len(pdf))
    some = np.flatnonzero(links)
    tree = forest(len(pdf), x, y)
    return pd.DataFrame({"a": np.concatenate((cls[some], cls[[i for i, _ in tree]])), "b": np.concatenate((cls[some], cls[[j for _, j in tree]])),
                         "links": np.concatenate((links[some].astype(np.int64), np.zeros(len(tree), np.int64)))})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, class_id, n_links, kept, set_id: one row per row of ``docs``."""
    sigs = materialize(signatures(docs, id_col, text_col), "jaccard-signatures")
    sets = sigs.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "hash")).alias("of"), F.count(F.lit(1)).alias("size"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    sets = sets.select("k1", "k2", F.col("of.id").alias("set_id"), F.col("of.hash").alias("set_hash"), "size", "n", "bands")
    sets = materialize(sets.withColumn("cls", F.monotonically_increasing_id()), "jaccard-sets")

    # Buckets of more than one class; a band's hash is eight bytes of `bands`.
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    keys = sets.select("cls", "size", "n", "bands", band).withColumn("hash", F.expr("substring(bands, 8 * band + 1, 8)"))
    slim = keys.select("cls", "band", "hash", "n")
    full = slim.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("g_n")).where("g > 1") \
        .select(F.col("band").alias("g_band"), F.col("hash").alias("g_hash"), "g", "g_n")
    hit = (F.col("band") == F.col("g_band")) & (F.col("hash") == F.col("g_hash"))
    members = materialize(slim.join(full, hit).select("cls", "band", "hash", F.greatest(F.ceil(F.col("g") / TILE), F.ceil(F.col("g_n") * 8 / TILE_BYTES)).alias("tiles")), "jaccard-buckets")
    who = sets.select(F.col("cls").alias("w_cls"), "size", "bands")
    members = members.join(who, F.col("cls") == F.col("w_cls")).drop("w_cls")
    group = ["band", "hash", "ti", "tj"]
    in_tiles = tiled(members, ["band", "hash"], "cls", F.col("tiles")).drop("tiles")
    schema = "cls long, band int, hash binary, size long, bands binary, tile int, ti int, tj int"
    needed = each_group(in_tiles.select("cls", "band", "hash", "size", "bands", "tile", "ti", "tj"), group, _needed, schema)
    needed = materialize(needed, "jaccard-needed")

    # The full sets of the classes still needed, from one document of each: a row's id and text find one class at most.
    wanted = needed.select("cls").distinct().join(sets.select(F.col("cls").alias("w_cls"), "set_id", "set_hash", "k1", "k2"), F.col("cls") == F.col("w_cls")) \
        .select(F.col("cls"), "set_id", "set_hash", "k1", "k2")
    grams = _of_sets(_texts(docs, id_col, text_col), wanted)

    def full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            want1, want2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
            at = 0
            for cls, h, n in _steps(pdf["cls"].tolist(), pdf["text"].tolist()):
                k1, k2, cut = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64), np.cumsum(n) - n
                if (n > 0).any():
                    a, b, _ = _digests(h, n)
                    k1[n > 0], k2[n > 0] = a.view(np.int64), b.view(np.int64)
                right = (k1 == want1[at:at + len(cls)]) & (k2 == want2[at:at + len(cls)]) & (n > 0)
                at += len(cls)
                rows = [(c, h[a:a + m].tobytes()) for c, a, m, r in zip(cls, cut.tolist(), n.tolist(), right.tolist(), strict=True) if r]
                yield pd.DataFrame(rows, columns=["g_cls", "grams"])
            release()

    grams = grams.mapInPandas(full_sets, "g_cls long, grams binary").dropDuplicates(["g_cls"])
    rows = needed.join(grams, F.col("cls") == F.col("g_cls")).drop("g_cls")
    found = each_group(rows, group, lambda pdf: _verified(pdf, similarity), "a long, b long, links long")
    found = materialize(found, "jaccard-links")
    links = found.where("links > 0").groupBy(F.col("a").alias("l_cls")).agg(F.sum("links").alias("links"))
    roots = components(found.where("links = 0").select("a", "b"), "jaccard-components")
    roots = roots.select(F.col("node").alias("r_cls"), "root")
    info = sets.join(links, F.col("cls") == F.col("l_cls"), "left").join(roots, F.col("cls") == F.col("r_cls"), "left") \
        .select("k1", "k2", "set_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    info = materialize(info, "jaccard-info")
    least = info.groupBy("root").agg(F.min("set_id").alias("class_id")).withColumnRenamed("root", "c_root")
    info = info.join(least, F.col("root") == F.col("c_root")).select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), "set_id", "n_links", "class_id")
    out = sigs.select("id", "n", "k1", "k2").join(info, (F.col("n") > 0) & (F.col("k1") == F.col("i1")) & (F.col("k2") == F.col("i2")), "left")
    null = lambda c: F.when(c != F.lit(int(NO_ID)), c)
    class_id = F.coalesce("class_id", "id")
    return out.select(null(F.col("id")).alias("id"), null(class_id).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      (F.col("id") == class_id).alias("kept"), null(F.coalesce("set_id", "id")).alias("set_id"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")
