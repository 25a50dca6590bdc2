"""Access-log readers.

One DataFrame per log *family*, with the folder each row was delivered to
(``<bucket>/<stack>/<resource>`` for file logs, ``<account>/<log group>`` for
exported API logs), so all resources of a family are read in one scan and
joined once to the tracked-resource table (C9) instead of one query per resource.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch import schemas
from skywatch.operators.attribution import longest_prefix, resource_location
from skywatch.session import folders_listed
from skywatch.sources import files
from skywatch.sources.files import qualified

# ---- fixed value that must equal the reference's for the same parse ----
# Object-store access-log line pattern (26 groups; the last eight optional as
# one group), as given to the regex SerDe of the log table.
OBJECT_LOG_REGEX = (
    r'([^ ]*) ([^ ]*) \[(.*?)\] ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ("[^"]*"|-) (-|[0-9]*) '
    r'([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ("[^"]*"|-) ([^ ]*)'
    r'(?: ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*))?.*$'
)
# API access-log line: "<ip>,<method> <path>,<request id>" (glob "*,* *,*").
API_LOG_REGEX = r"^(.*?),(.*?) (.*?),(.*)$"
# ---------------------------------------------------------------------------

# The SerDe matches the whole line; regexp_extract searches, so anchor it.
_OBJECT_LOG_ANCHORED = "^" + OBJECT_LOG_REGEX
_OPTIONAL_FROM = 19  # groups 19..26 may not take part in the match
# Separator for one-pass group extraction; a line that holds it is parsed group by group.
_SEP = "\u0001"


def with_folder(df: DataFrame, root: str | list[str] | None = None) -> DataFrame:
    """Add ``logFolder``: the folder of each row's file, which says whose logs they are.

    The scheme is left out, so on an object store the bucket comes first. With one ``root`` (a folder that
    holds a copy of the buckets) the part below it is taken. A ``key=`` before a folder's name, as in Hive-style
    directories, is dropped."""
    folder = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:/*", ""), "/[^/]*$", "")
    folder = F.ltrim(folder, F.lit("/"))
    if isinstance(root, str):
        root = re.sub(r"/[^/]*[*?\[{].*$", "", root)  # the folder above a pattern
        base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", qualified(df.sparkSession, root)).strip("/") + "/"
        folder = F.when(F.startswith(folder, F.lit(base)), F.substring(folder, len(base) + 1, 1 << 30)).otherwise(folder)
    return df.withColumn("logFolder", F.regexp_replace(folder, "(^|/)[^/=]*=", "$1"))


def read_cdn_logs(spark: SparkSession, path: str | list[str], with_path: bool = True) -> DataFrame:
    """A1: tab-separated CDN logs; both ``#`` header lines are dropped as comments.

    ``-`` in a numeric column becomes NULL (permissive parse), ``-`` in a
    text column stays ``-``. Gzip files are read transparently (one task per
    file: not splittable, so many files are better than few large ones).
    """
    with folders_listed(spark):
        df = (spark.read.schema(schemas.CDN_LOG)
              .option("sep", "\t").option("comment", "#").option("header", False)
              .option("quote", "").option("escape", "")  # a quote is an ordinary character of a cell
              .option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
              .csv(path))
    return with_folder(df, path) if with_path else df


def _parse_lines(df: DataFrame, text: Column, anchored: str, fields: list[tuple[str, int, str]],
                 keep: list[str]) -> DataFrame:
    """Evaluate an anchored whole-line regex ONCE per row and expand its groups.

    ``regexp_replace`` rewrites a matching line to ``SEP g1 SEP g2 ...``; a
    non-matching line comes back unchanged (no separator, so one field after
    the split). ``fields`` are ``(name, group, kind)`` with kind ``str``,
    ``opt`` (empty -> NULL) or ``bigint``. The groups are computed in one
    projection and expanded with ``inline``: predicates on the parsed
    columns stay above the generator instead of being pushed down with the
    regex substituted into them (which would evaluate it again per column).
    """
    n_groups = max(g for _, g, _ in fields)
    rep = _SEP + _SEP.join(f"${i}" for i in range(1, n_groups + 1))
    groups = F.split(F.substring(F.regexp_replace(text, anchored, rep), 2, 1 << 30), _SEP, -1)
    each = F.when(text.rlike(anchored), F.array(*[F.regexp_extract(text, anchored, i) for i in range(1, n_groups + 1)]))
    groups = F.when(F.contains(text, F.lit(_SEP)), each).otherwise(groups)
    staged = df.select(*keep, groups.alias("_g"))
    parts = []
    for name, i, kind in fields:
        c = f"_g[{i - 1}]"
        if kind == "opt":
            c = f"nullif({c}, '')"
        elif kind == "bigint":
            c = f"try_cast({c} AS BIGINT)"
        parts.append(f"'{name}', CASE WHEN size(_g) = {n_groups} THEN {c} END")
    # one SQL expression for the whole record: parsed once, not built call by call
    return staged.selectExpr(*[f"`{k}`" for k in keep], f"inline(array(named_struct({', '.join(parts)})))")


def parse_object_log(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """A2: regex-parse access-log lines into the 26 typed columns.

    A line that does not match gives NULL in every column (as the SerDe);
    optional groups that do not take part give NULL; ``-`` byte counts give
    NULL. The regex runs once per line (see :func:`_parse_lines`).
    """
    fields = []
    for i, name in enumerate(schemas.OBJECT_LOG_COLUMNS, start=1):
        kind = "bigint" if name in schemas.OBJECT_LOG_BIGINT else ("opt" if i >= _OPTIONAL_FROM else "str")
        fields.append((name, i, kind))
    keep = [c for c in lines.columns if c != text_col]
    return _parse_lines(lines, F.col(text_col), _OBJECT_LOG_ANCHORED, fields, keep)


def read_object_access_logs(spark: SparkSession, path: str | list[str], with_path: bool = True) -> DataFrame:
    """A2 over files: ``spark.read.text`` then :func:`parse_object_log`."""
    with folders_listed(spark):
        df = spark.read.option("recursiveFileLookup", True).text(path)
    if with_path:
        df = with_folder(df, path)
    return parse_object_log(df)


def parse_api_log(df: DataFrame, message_col: str = "message") -> DataFrame:
    """A3: ``sourceIp, method, path`` from the access-log message (one regex
    evaluation per line); NULLs when it does not match."""
    fields = [("sourceIp", 1, "str"), ("method", 2, "str"), ("path", 3, "str"), ("_requestId", 4, "str")]
    return _parse_lines(df, F.col(message_col), API_LOG_REGEX, fields, df.columns).drop("_requestId")


def read_api_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A3 over exported records ``(timestamp, message)`` in JSON lines."""
    with folders_listed(spark):
        df = spark.read.schema(schemas.API_LOG).option("recursiveFileLookup", True).json(path)
    return parse_api_log(with_folder(df, path))


def log_table_name(family: str, stack: str, resource: str) -> str:
    """Python twin of :func:`skywatch.functions.scalars.safe_table_name` (G8) for DDL."""
    import re
    return re.sub(r"[^a-z_0-9]", "__", f"{family}_{stack}_{resource}".lower())


def register_log_table(spark: SparkSession, family: str, stack: str, resource: str, location: str) -> str:
    """Create-if-absent table over one resource's log location.

    Prefer one table per family (see module doc); this exists for users who
    query a single resource by name.
    """
    name = log_table_name(family, stack, resource)
    if family == "cloudfrontlogs":
        ddl_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.CDN_LOG.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{name}` ({ddl_schema}) USING csv "
            f"OPTIONS (sep '\\t', comment '#', header 'false') LOCATION '{location}'")
    else:
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` (value string) USING text LOCATION '{location}'")
    return name


def land_log_family(df: DataFrame, path: str, date_col: str | None = "date") -> None:
    """Write a parsed log family as Parquet partitioned by log folder and
    date (SURVEY §4: land raw logs when they are read more than once).

    Partitioned writes append per (folder, date) directory without a
    shuffle: every task writes its own files, so a resource holding a third of
    the logs is still written by all tasks. Dynamic overwrite replaces only
    the partitions present in ``df`` (re-landing a day is idempotent; without
    ``date_col``, re-landing a folder). Where nothing has landed yet, nothing is replaced, and the folders are not
    moved one by one from a staging folder.
    """
    there = files.exists(df.sparkSession, path)
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if there else df.write.mode("append")
    w.partitionBy("logFolder", *([date_col] if date_col else [])).parquet(path)


def read_landed(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a landed family; a predicate on ``date`` or ``logFolder`` prunes
    directories before any file is opened."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    with folders_listed(spark):
        return r.parquet(path)


def read_tracked(spark: SparkSession, path: str, resources: DataFrame, rtype: str, schema=None) -> DataFrame:
    """The rows of a landed family that lie at or under a location registered by a resource of ``rtype``.

    The folders come from a listing of the landed partitions; their longest registered prefixes are found as a table,
    and the join with it prunes the other folders' partitions when it runs (dynamic partition pruning)."""
    landed = [unquote(n.partition("=")[2]) for n in files.names(spark, path) if n.startswith("logFolder=")]
    folders = spark.createDataFrame([(f,) for f in landed], "logFolder string")
    locations = resources.where(F.col("type") == rtype).select(resource_location().alias("location"))
    wanted = longest_prefix(folders, ["logFolder"], "logFolder", locations).select("logFolder")
    return read_landed(spark, path, schema).join(wanted, on="logFolder", how="left_semi")
