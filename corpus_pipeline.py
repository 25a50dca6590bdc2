"""Corpus pipeline: language identification, near-duplicate removal, repeated
passages, benchmark decontamination, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which :func:`run` writes as Parquet to the folder of
``spark.checkpoint.dir`` and reads again as the next stage's documents. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.llm import decontaminate, jaccard, language, mixing, suffixes
from skywatch.llm.common import fresh, materialize, small_batches, table

# A declared language is taken for wrong only if the prediction is this sure: of the held-out rows, at most one
# in a thousand has a prediction this sure that is not its label (figures in the README).
SURE = 0.965

# Languages are learned and repeats compared by steps that SQL cannot express.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any letter and those whose declared language the text surely contradicts;
    a null declared language contradicts nothing."""
    small_batches(spark)
    model = language.fit(language.learnable(docs))
    if not model.languages:  # nothing learned: nothing to reject but texts without a letter
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    work = fresh("lang")
    pred, score = F.col(f"{work}.lang_pred"), F.col(f"{work}.score")
    wrong = F.col("lang").isNotNull() & (pred != F.col("lang")) & (score >= SURE)
    return docs.withColumn(work, language.prediction(model, F.col("text"))).where((pred != language.UNDETERMINED) & ~wrong).drop(work)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity 0.8 or more one row stays: that of the smallest id, null ids last.
    Decided row by row, whatever ids repeat or are null; a row without words is linked with nothing and stays."""
    small_batches(spark)
    row, gone, own, least = fresh("row"), fresh("gone"), fresh("own"), fresh("least")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    linked = jaccard.near_duplicates(rows.select(row, "text"), row).where("n_links > 0").select(F.col("id").alias(gone), "class_id")
    linked = materialize(linked, "pipeline-linked")
    # Rows of equal id are told apart by content, equal rows by their number.
    content = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"), content.alias("content"), F.col(row).alias("row"))
    first = linked.join(rows.select(F.col(row).alias(own), order.alias("o")), F.col(gone) == F.col(own)) \
        .groupBy("class_id").agg(F.min("o").alias("o")).select(F.col("o.row").alias(least))
    others = materialize(linked.join(first, F.col(gone) == F.col(least), "left_anti").select(gone), "pipeline-duplicates")
    return rows.join(others, F.col(row) == F.col(gone), "left_anti").drop(row)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the bytes that repeat an earlier document; a document of which nothing but white space is left goes.
    n_chars is counted again where text was removed."""
    small_batches(spark)
    others, null = [c for c in docs.columns if c != "text"], fresh("null")
    rows = docs.withColumn(null, F.col("text").isNull())
    out = suffixes.without_repeats(rows, keep=[*others, null], whole_characters=True)
    changed = F.col("n_removed") > 0
    out = out.select(F.from_json("rest", rows.select(*others, null).schema).alias("row"), changed.alias("changed"), F.col("kept").cast("string").alias("text"))
    out = out.withColumn("text", F.when(~F.col(f"row.{null}"), F.col("text")))
    out = out.where(~F.col("changed") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    made = {"text": F.col("text"), "n_chars": F.when(F.col("changed"), F.length("text")).otherwise(F.col("row.n_chars")).cast("long")}
    return out.select(*[(made[c] if c in made else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and copy that the mix takes: doc_id, source, lang, copy (from 1), size, target of its source."""
    mixed = mixing.mix(docs.select("doc_id", "text", "source", "lang")).where("copies > 0")
    return mixed.select("doc_id", "source", "lang", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "size", "target")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeats_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
