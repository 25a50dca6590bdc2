"""Operator 1: benchmark decontamination by SimHash over item-sized windows.

A document leaks an item if one of its windows of as many words as the item
has (the whole text, if it is shorter) reaches a weighted similarity of 0.8
with the item: Jaccard over 5-word shingles weighed by how often they occur,
sum of minima by sum of maxima. Words are runs without ASCII white space,
in lower case; items under five words use their whole length as shingle.

Everything is DataFrame functions.

* Windows: a window of similarity s shares all but 1 - s of the item's
  shingles with it, so of any ``(1 - s) * S + 1`` of them at least one. Those
  with the smallest hashes are the item's anchors. Documents' shingles are
  hashed in place, exploded as (position, hash) and met with the anchors; a
  hit of an item's shingle places the item-sized window around it (and as
  many neighbours as insertions could shift it by).
* Equal windows become one row, whatever passage a third of all documents
  share, and get a 64-bit SimHash of their weighted shingles.
* Multi-index Hamming join: fingerprints are cut in ``RADIUS + 1`` blocks; two
  within ``RADIUS`` bits agree on a block at least, so an equi-join on (window
  size, block number, block) finds all of them.
* Pairs within the radius are verified by their exact weighted similarity.

A pair of similarity 0.8 is within the radius of 15 of 64 bits in about 97 of
100 cases, one of 0.9 practically always (figures in the README).

The benchmark is a table like any other: nothing of it is collected or
broadcast by hand; the planner broadcasts the anchors while they are small and
sort-merge joins beyond. The number of shingle lengths under five that items
need (at most four numbers) is the only thing read by the driver.

Cases: null or empty texts and items have no words, leak nothing and are not
leaked; a null doc_id or item_id is kept as null; rows that repeat id and text
give one result row, rows that repeat an id with other texts are told apart;
of equally similar windows the first is reported; empty tables give an empty
result (:func:`clean`: the documents unchanged); other columns are ignored
(kept by :func:`clean`); texts of any length are read whole, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.llm.common import SHINGLE_WORDS, SIMILARITY, SPACES, fresh, materialize, table

RADIUS = 15


def _word_hashes(text: str) -> Column:
    words = F.array_remove(F.split(F.lower(F.col(text)), SPACES), "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def _shingles(hashes: Column, k: int) -> Column:
    """Hash of the k words from each position; an empty array for fewer words."""
    n = F.size(hashes)
    at = F.sequence(F.lit(0), n - F.lit(k))
    made = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)], F.lit(k)))
    return F.when(n >= k, made).otherwise(F.array().cast("array<bigint>"))


def _simhash(shingles: str) -> Column:
    """Bit b is set if it is in more than half of the shingles' hashes, repeats counted."""
    return F.expr(f"""aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(
        2 * aggregate({shingles}, 0, (n, h) -> n + cast(getbit(h, b) as int)) > size({shingles}), shiftleft(1L, b), 0L))""")


def _blocks(radius: int) -> Column:
    """(block number, bits) of a fingerprint column ``f``, in radius + 1 blocks of nearly equal width."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("f", a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("bits"))
                               for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]))


def _doc_key(id_col: str, text_col: str) -> Column:
    """Tells rows of different id or text apart."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start (word, from 0), n_words, and the row's key: one row per leaked item of a document."""
    hashed = items.select(F.col(item_col).cast("long").alias("item"), _word_hashes(item_text_col).alias("wh")).withColumn("n", F.size("wh")).where("n > 0")
    hashed = hashed.withColumn("k", F.least(F.lit(SHINGLE_WORDS), F.col("n")))
    by_k = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE_WORDS + 1):
        by_k = F.when(F.col("k") == k, _shingles(F.col("wh"), k)).otherwise(by_k)
    hashed = materialize(hashed.select("item", "n", "k", by_k.alias("sh"), F.xxhash64("wh").alias("text_hash")).withColumn("f", _simhash("sh")), "leak-items")
    short = sorted(r["k"] for r in hashed.select("k").distinct().collect())  # at most SHINGLE_WORDS numbers
    # Anchors: the smallest hashes of each item, as many as cannot all be missing.
    some = F.slice(F.array_sort(F.array_distinct("sh")), F.lit(1), (F.floor(F.size("sh") * F.lit(1 - similarity) + 1e-9) + 1).cast("int"))
    shift = F.floor(F.size("sh") / 36).cast("int")
    spots = hashed.select("n", "sh", shift.alias("shift"), F.explode(some).alias("h"))
    spots = spots.select("n", "shift", "h", F.explode(F.filter(F.sequence(F.lit(0), F.size("sh") - 1), lambda i: F.get(F.col("sh"), i) == F.col("h"))).alias("q")).distinct()
    spots = materialize(spots.select("n", "shift", F.col("h").alias("a_h"), "q"), "leak-anchors")

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), _doc_key(id_col, text_col).alias("key"), _word_hashes(text_col).alias("wh"))
    per_k = F.concat(*[F.transform(_shingles(F.col("wh"), k), lambda h, i: F.struct(i.alias("p"), h.alias("h"))) for k in short]) if len(short) > 1 else \
        (F.transform(_shingles(F.col("wh"), short[0]), lambda h, i: F.struct(i.alias("p"), h.alias("h"))) if short else F.array().cast("array<struct<p:int,h:bigint>>"))
    rows = d.select("doc_id", "key", F.size("wh").alias("total"), F.explode(per_k).alias("s")).select("doc_id", "key", "total", "s.p", "s.h")
    hits = rows.join(spots, F.col("h") == F.col("a_h"))
    start = F.explode(F.sequence(F.col("p") - F.col("q") - F.col("shift"), F.col("p") - F.col("q") + F.col("shift")))
    windows = hits.select("doc_id", "key", "n", "total", start.alias("start")).distinct()
    size = F.least("n", "total")
    windows = windows.select("doc_id", "key", "n", size.alias("size"), F.greatest(F.lit(0), F.least(F.col("start"), F.col("total") - size)).alias("start")).distinct()
    windows = materialize(windows, "leak-windows")

    # The windows' shingles, from the few documents that have any.
    wanted = windows.select(F.col("doc_id").alias("w_id"), F.col("key").alias("w_key")).distinct()
    few = d.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")), "left_semi").dropDuplicates(["doc_id", "key"]) \
        .select(F.col("doc_id").alias("f_id"), F.col("key").alias("f_key"), "wh")
    cut = F.slice("wh", F.col("start") + 1, F.col("size"))
    sh = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE_WORDS + 1):
        sh = F.when(F.least(F.lit(SHINGLE_WORDS), F.col("n")) == k, _shingles(F.col("cut"), k)).otherwise(sh)
    windows = windows.join(few, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key"))) \
        .select("doc_id", "key", "n", "start", "size", cut.alias("cut")).withColumn("sh", sh).where(F.size("sh") > 0) \
        .select("doc_id", "key", "n", "start", "size", "sh", F.xxhash64("sh", F.lit(1)).alias("c1"), F.xxhash64(F.lit(2), "sh").alias("c2"))
    windows = materialize(windows, "leak-window-shingles")
    contents = materialize(windows.groupBy("n", "c1", "c2").agg(F.any_value("sh").alias("sh")).withColumn("f", _simhash("sh")), "leak-contents")

    # Multi-index join of the fingerprints, then the exact similarity.
    left = contents.select("n", "c1", "c2", "f", _blocks(radius).alias("b")).select("n", "c1", "c2", "f", "b.block", "b.bits")
    right = hashed.select(F.col("n").alias("i_n"), "item", "text_hash", F.col("f"), _blocks(radius).alias("b")).select("i_n", "item", "text_hash", F.col("f").alias("i_f"), F.col("b.block").alias("i_block"), F.col("b.bits").alias("i_bits"))
    near = left.join(right, (F.col("n") == F.col("i_n")) & (F.col("block") == F.col("i_block")) & (F.col("bits") == F.col("i_bits"))) \
        .where(F.bit_count(F.col("f").bitwiseXOR(F.col("i_f"))) <= radius).select("n", "c1", "c2", "item", "text_hash").distinct()
    near = materialize(near, "leak-candidates")
    pair = ["n", "c1", "c2", "item", "text_hash"]
    mine = near.join(contents.select(F.col("n").alias("x_n"), F.col("c1").alias("x1"), F.col("c2").alias("x2"), "sh"), (F.col("n") == F.col("x_n")) & (F.col("c1") == F.col("x1")) & (F.col("c2") == F.col("x2")))
    mine = mine.select(*pair, F.lit(1).alias("here"), F.lit(0).alias("there"), F.explode("sh").alias("h"))
    theirs = near.join(hashed.select(F.col("n").alias("y_n"), F.col("item").alias("y_item"), F.col("text_hash").alias("y_hash"), "sh").dropDuplicates(["y_n", "y_item", "y_hash"]),
                       (F.col("n") == F.col("y_n")) & F.col("item").eqNullSafe(F.col("y_item")) & (F.col("text_hash") == F.col("y_hash")))
    theirs = theirs.select(*pair, F.lit(0).alias("here"), F.lit(1).alias("there"), F.explode("sh").alias("h"))
    per_shingle = mine.unionByName(theirs).groupBy(*pair, "h").agg(F.sum("here").alias("a"), F.sum("there").alias("b"))
    exact = per_shingle.groupBy(*pair).agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity")).where(F.col("similarity") >= similarity - 1e-9)
    exact = exact.select(F.col("n").alias("e_n"), F.col("c1").alias("e1"), F.col("c2").alias("e2"), "item", "similarity")
    found = windows.join(exact, (F.col("n") == F.col("e_n")) & (F.col("c1") == F.col("e1")) & (F.col("c2") == F.col("e2")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "size"))
    return found.groupBy("doc_id", "key", "item").agg(best.alias("best")).select(
        "doc_id", F.col("item").alias("item_id"), F.col("best.similarity").alias("similarity"), (-F.col("best.s")).cast("long").alias("start"), F.col("best.size").cast("long").alias("n_words"), "key")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    key, own = fresh("key"), fresh("leak")
    bad = materialize(leaks(docs, items, id_col, text_col, **options).select(F.col("key").alias(key), F.col("doc_id").alias(own)).distinct(), "leak-documents")
    mark = fresh("mark")
    marked = docs.withColumn(mark, _doc_key(id_col, text_col))
    return marked.join(bad, (F.col(mark) == F.col(key)) & F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left_anti").drop(mark)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("key")


ORACLE_OP1 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
i AS (SELECT item_id, len(w) AS n, least(len(w), 5) AS k, w FROM iw WHERE len(w) > 0),
ish AS (SELECT item_id, n, k, q, array_to_string(w[q + 1:q + k], ' ') AS s FROM i, (SELECT unnest(range(0, 100000)) AS q) r WHERE q <= n - k),
ks AS (SELECT DISTINCT k FROM i),
dsh AS (SELECT doc_id, len(w) AS total, k, p, array_to_string(w[p + 1:p + k], ' ') AS s
        FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, total, item_id, n, ish.k, p - q AS st, ((n - ish.k + 1) // 36) AS d FROM dsh JOIN ish ON dsh.s = ish.s AND dsh.k = ish.k),
win AS (SELECT DISTINCT doc_id, item_id, n, k, least(n, total) AS size, greatest(0, least(st + dl, total - least(n, total))) AS st
        FROM (SELECT *, unnest(range(-d, d + 1)) AS dl FROM hits)),
a AS (SELECT win.doc_id, win.item_id, win.st, win.size, dsh.s, count(*) AS c FROM win JOIN dsh ON dsh.doc_id = win.doc_id AND dsh.k = win.k AND p BETWEEN st AND st + size - win.k
      GROUP BY ALL),
b AS (SELECT item_id, s, count(*) AS c FROM ish GROUP BY ALL),
tot AS (SELECT item_id, sum(c) AS t FROM b GROUP BY ALL),
sim AS (SELECT a.doc_id, a.item_id, a.st, a.size, sum(least(a.c, coalesce(b.c, 0))) AS inter, sum(a.c) AS mine FROM a LEFT JOIN b ON a.item_id = b.item_id AND a.s = b.s GROUP BY ALL),
res AS (SELECT doc_id, sim.item_id, inter / (mine + t - inter) AS similarity, st, size FROM sim JOIN tot ON sim.item_id = tot.item_id),
ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, st) AS r FROM res WHERE similarity >= 0.8 - 1e-9)
SELECT doc_id, item_id, similarity::DOUBLE AS similarity, st::BIGINT AS start, size::BIGINT AS n_words FROM ok WHERE r = 1
"""
