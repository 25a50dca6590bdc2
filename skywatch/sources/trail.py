"""Audit-trail reader (A4).

Each file is one JSON document ``{"Records": [...]}``, usually gzipped; the
object key carries ``AWSLogs/<org>/<account>/CloudTrail/<region>/<yyyy>/<mm>/<dd>/<file>``.
A multi-line document is read whole by one task, which is fine: trail files
are small and numerous, so the parallelism comes from the file count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch import schemas


def with_file(docs: DataFrame) -> DataFrame:
    """Documents (``Records``) and the file each came in (``_file``)."""
    return docs.select("Records", F.col("_metadata.file_path").alias("_file"))


def explode_records(docs: DataFrame) -> DataFrame:
    """One row per record of :func:`with_file` plus the path-derived fields (NULL when the file
    does not sit in the ``.../<org>/<account>/CloudTrail/<region>/<y>/<m>/<d>/``
    layout)."""
    parts = F.split(F.col("_file"), "/")

    def part(i: int):
        return F.try_element_at(parts, F.lit(i))

    in_layout = F.coalesce(part(-6) == "CloudTrail", F.lit(False))

    def field(i: int):
        return F.when(in_layout, part(i))

    return (docs
            .select("_file", F.explode("Records").alias("r"))
            .select("r.*", F.col("_file").alias("trailFile"),
                    field(-8).alias("trailOrgId"), field(-7).alias("trailAccountId"),
                    field(-5).alias("trailRegion"),
                    F.when(in_layout, F.concat_ws("-", part(-4), part(-3), part(-2))).alias("trailDate")))


def read_audit_trail(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """A4: read trail documents with the explicit schema and explode ``Records``.

    ``multi_line=True`` reads each file as one (possibly pretty-printed)
    document, as delivered; ``False`` reads one compact document per line.
    """
    docs = (spark.read.schema(schemas.TRAIL_FILE).option("multiLine", multi_line)
            .option("recursiveFileLookup", True).json(path))
    return explode_records(with_file(docs))
