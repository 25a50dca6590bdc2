"""Operator 7: mixing sources to target weights by systematic sampling.

Every source gets a target in words; each of its documents is expected to be
taken ``target / source_size`` times. The expected copies are prefix-summed
along an order of the source's documents, one random offset per source is
added, and a document is emitted once for every integer boundary that its
stretch of the running sum crosses. So a document is taken floor or ceil of
its expectation, and the source's total misses its target by about one large
document at most, because neighbours in the order have about the same size.

Everything is DataFrame functions. A source may hold a third of all rows, so
no window runs over a whole source's documents: the order is (size class
descending, one of 256 slots by id, size, id), the running position of a
document is the number of documents in the cells before its own (a window
over the source's cells, a few thousand rows however large the source is)
plus its number within the cell.

Cases: a null source is a source of its own and comes last; a null or empty
text has size 0, counts for nothing and is taken 0 times (it emits no copy);
a source without words has target 0; repeated rows count as documents of
their own (equal rows may get different numbers of copies, as a set the
result is always the same); null ids are allowed; of a text only
its words are counted, whatever its length; other columns are kept by
:func:`mix` whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skywatch.llm.common import fresh, materialize, n_words, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix-1"
SLOTS = 256


def _slot(doc_id: Column) -> Column:
    """0..255 from an integer id, by multiplication (Fibonacci hashing)."""
    low = F.pmod(F.coalesce(doc_id.cast("long"), F.lit(0)), F.lit(2**31).cast("long"))
    return F.shiftright(F.pmod(low * F.lit(2654435761).cast("long"), F.lit(2**32).cast("long")), 24)


def _size_class(size: str) -> Column:
    """Binary order of magnitude and the next three bits: sizes of a class differ by an eighth at most."""
    return F.expr(f"length(bin(`{size}`)) * 16 + shiftright(`{size}`, greatest(length(bin(`{size}`)) - 4, 0))").cast("int")


def targets(sized: DataFrame, source: str, size: str, weights: Sequence[float] = WEIGHTS,
            share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt out by
    weight (weights repeat along the sources in code point order, null last).

    Targets stop at ``max_repeats`` times the source's size and the excess is
    dealt out again by weight, until none is above: that is
    ``min(cap, level * weight)`` with the level that spends the whole budget,
    found in one pass over the sources in order of cap / weight.
    """
    src = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    ws = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("w", F.element_at(ws, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    src = src.withColumn("cap", F.col("source_size") * float(max_repeats)).withColumn("ratio", F.col("cap") / F.col("w"))
    src = src.select(
        "*",
        (F.sum("source_size").over(everything) * float(share)).alias("budget"),
        (F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("spent"),
        F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("left"))
    src = src.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left"))
    # the first source whose cap is above its level fixes the level of all that follow
    src = src.withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    return src.select("source", "source_size",
                      F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """One number in [0, 1) per source."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS,
        seed: str = SEED) -> DataFrame:
    """``docs`` without its text, plus size, source_size, target, copies and
    taken (words taken, repeats counted); one row per input row."""
    size, cell, slot = fresh("size"), fresh("class"), fresh("slot")
    # Sizes, totals, cells and ranks all use the counts: texts are read and counted once.
    sized = materialize(docs.withColumn(size, n_words(text_col)).drop(text_col), "mix-sized")
    goal = targets(sized, source_col, size, weights, share, max_repeats).withColumn("offset", offset(F.col("source"), seed)) \
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    celled = sized.withColumn(cell, _size_class(size)) \
        .withColumn(slot, _slot(F.col(id_col)).cast("int"))
    # The rows before each cell, and what holds for its source.
    cells = celled.groupBy(F.col(source_col).alias("c_source"), F.col(cell).alias("c_class"), F.col(slot).alias("c_slot")) \
        .agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("c_source").orderBy(F.col("c_class").desc(), "c_slot")
    cells = cells.withColumn("before", F.sum("n").over(along) - F.col("n")).drop("n")
    cells = cells.join(goal, F.col("c_source").eqNullSafe(F.col("source")), "inner")
    extra = F.struct("before", "source_size", "target", "rate", "offset")
    cells = cells.select("c_source", "c_class", "c_slot", extra.alias(fresh("cell")))
    info = cells.columns[-1]
    within = Window.partitionBy(source_col, cell, slot).orderBy(F.col(size).desc(), F.col(id_col).asc_nulls_last())
    rank = fresh("rank")
    ranked = celled.withColumn(rank, F.row_number().over(within))
    on = F.col(source_col).eqNullSafe(F.col("c_source")) & (F.col(cell) == F.col("c_class")) & (F.col(slot) == F.col("c_slot"))
    joined = ranked.join(cells, on, "inner").drop("c_source", "c_class", "c_slot")
    at = F.col(f"{info}.before") + F.col(rank)
    rate, u = F.col(f"{info}.rate"), F.col(f"{info}.offset")
    copies = F.floor(u + rate * at) - F.floor(u + rate * (at - 1))
    clashing = [c for c in ("size", "source_size", "target", "copies", "taken") if c in docs.columns]
    kept = [c for c in docs.columns if c != text_col and c not in clashing]
    copies = F.when(F.col(size) > 0, F.least(copies, F.ceil(rate))).otherwise(F.lit(0)).cast("long")
    return joined.select(*kept, F.col(size).alias("size"), F.col(f"{info}.source_size").alias("source_size"),
                         F.col(f"{info}.target").alias("target"), copies.alias("copies")) \
        .withColumn("taken", F.col("copies") * F.col("size"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_OP7 = """
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1] AS w FROM src),
ratios AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM named),
run AS (SELECT *, sum(cap) OVER r - cap AS spent, sum(w) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
        FROM ratios WINDOW r AS (ORDER BY ratio, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
lvl AS (SELECT arg_min((budget - spent) / rest, ratio) AS level FROM run WHERE ratio > (budget - spent) / rest),
goal AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target,
           ('0x' || substr(md5('mix-1:' || coalesce('s' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
         FROM run LEFT JOIN lvl ON true),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM goal),
celled AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS cell,
             (((coalesce(doc_id, 0) % 2147483648 + 2147483648) % 2147483648 * 2654435761) % 4294967296) >> 24 AS slot FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cell DESC, slot, size DESC, doc_id NULLS LAST) AS nth FROM celled)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN size * least(floor(u + rate * nth) - floor(u + rate * (nth - 1)), ceil(rate))::BIGINT ELSE 0 END AS taken
FROM ranked JOIN rated ON ranked.source IS NOT DISTINCT FROM rated.source
"""
