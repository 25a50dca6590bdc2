"""Readers for exported reports and inventories.

The reference calls cloud APIs for these; here they are files the caller
exported (CSV / JSON), read with explicit schemas. Calling the services is
out of scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch import config, schemas
from skywatch.functions.scalars import safe_table_name


# A cell is quoted (a quote inside is doubled; line breaks and commas may stand there) or runs to the next comma or line end.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^,\r\n"][^,\r\n]*+|)'
_RECORD = rf"({_CELL}(?:,{_CELL})*+)(?:\r\n|\n|\r|$)"


def csv_records(text: Column) -> Column:
    """The non-blank records of a CSV text, quoted line breaks within them."""
    found = F.regexp_extract_all(text, F.lit(_RECORD), F.lit(1))
    return F.filter(found, lambda x: F.trim(x) != "")


def csv_cells(record: Column) -> Column:
    """The cells of a record, however many, without their quotes."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_CELL})"), F.lit(1))
    return F.transform(cells, lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def read_credential_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A5: credential report CSV -> all-text rows + ``accountId`` from
    ``.../<account>/<file>`` (a ``key=`` folder prefix is dropped).

    Columns are matched by the *names* in each file's own header (as the
    reference's CSV parser does), not by position: reports differ in their
    columns, their number and their order; of equal names the last one counts.
    No type inference: every cell stays text; columns a report lacks come back
    NULL, and so do empty unquoted cells. A report is one account's users
    (kilobytes), so a file is read whole by one task; its records go on one by one.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    folder = F.try_element_at(F.split(F.col("_metadata.file_path"), "/"), F.lit(-2))
    text = F.regexp_replace("value", "^\uFEFF", "")
    files = raw.select(F.regexp_replace(folder, "^[^=/]*=", "").alias("accountId"), csv_records(text).alias("l"))
    # the header is turned into the columns' places before the records are dealt out, so that a record carries those alone
    # and not its file's records
    head = files.select("accountId", F.slice("l", 2, 1 << 30).alias("l"), F.transform(csv_cells(F.get("l", F.lit(0))), lambda x: F.trim(x)).alias("h"))
    last = lambda c: (F.size("h") - F.nullif(F.array_position(F.reverse("h"), c), F.lit(0))).cast("int")  # noqa: E731 - NULL without such a column
    placed = head.select("accountId", F.struct(*[last(c).alias(c) for c in schemas.CREDENTIAL_COLUMNS]).alias("at"), "l")
    lines = placed.select("accountId", "at", F.explode_outer("l").alias("line")).where("line IS NOT NULL")  # outer: no filter that splits the text once more
    rows = lines.select("accountId", "at", csv_cells(F.col("line")).alias("v"))
    cols = [F.nullif(F.get("v", F.col(f"at.{c}")), F.lit("")).alias(c) for c in schemas.CREDENTIAL_COLUMNS]
    return rows.select(*cols, "accountId")


def read_stacks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Stack descriptions (JSON lines of ``schemas.STACKS``)."""
    return spark.read.schema(schemas.STACKS).json(path)


def tracked_resources(stacks: DataFrame) -> DataFrame:
    """Explode stack outputs, keep ``USAGETRACKING*`` keys, parse the JSON value.

    Stacks without outputs or without tracked outputs disappear (the inner
    explode), as the reference drops stacks with no resources.
    """
    out = F.explode(F.coalesce(F.col("Outputs"), F.array().cast("array<struct<OutputKey:string,OutputValue:string>>")))
    return (stacks
            .select("accountId", F.col("StackName").alias("stackName"), out.alias("o"))
            .where(F.startswith(F.col("o.OutputKey"), F.lit(config.TRACKING_OUTPUT_PREFIX)))
            .select("accountId", "stackName",
                    F.from_json("o.OutputValue", schemas.TRACKED_RESOURCE).alias("r"))
            .select("accountId", "stackName", "r.*"))


_KNOWN_TYPES = [config.TYPE_CLOUDFRONT, config.TYPE_S3_ACCESS_LOGS, config.TYPE_LOG_GROUP]


def route_resources(resources: DataFrame) -> DataFrame:
    """B9 + G8: route each resource to its log family; any other type is an error.

    Adds ``route`` (the type, or ``error``) and ``table_name`` (the per-resource
    log table name for the two file-log families, NULL otherwise).
    """
    t = F.col("type")
    route = F.when(t.isin(*_KNOWN_TYPES), t).otherwise(F.lit("error"))
    family = (F.when(t == config.TYPE_CLOUDFRONT, F.lit("cloudfrontlogs"))
               .when(t == config.TYPE_S3_ACCESS_LOGS, F.lit("s3accesslogs")))
    table = safe_table_name(F.concat_ws("_", family, F.col("stackName"), F.col("name")))
    return resources.withColumn("route", route).withColumn("table_name", F.when(family.isNotNull(), table))


def read_drift_results(spark: SparkSession, stack_path, resource_path) -> tuple[DataFrame, DataFrame]:
    """Stack drift summaries and resource drifts of every status (JSON lines); which count is B28's choice."""
    stacks = spark.read.schema(schemas.STACK_DRIFT).option("recursiveFileLookup", True).json(stack_path)
    drifts = (spark.read.schema(schemas.RESOURCE_DRIFT).option("recursiveFileLookup", True).json(resource_path))
    return stacks, drifts


def read_devices(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Device search results ``{"things": [...]}`` -> one row per device."""
    docs = (spark.read.schema(schemas.DEVICE_SEARCH).option("multiLine", True)
            .option("recursiveFileLookup", True).json(path))
    return docs.select(F.explode("things").alias("t")).select("t.*")


def read_ip_info(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """IP dimension ``(ip, country, countryCode, region, city, org)`` from Parquet."""
    return spark.read.schema(schemas.IP_INFO).parquet(path)
