"""Whose logs are these: log folders matched to the registered resources.

A tracked resource registers where its logs lie: ``<bucket>/<stack>/<name>``
for the two file-log families, the account and the log group for API logs.
The reference reads each resource's own location; here a family is read and
aggregated as one table that carries each row's folder, and the aggregated
rows find their resource by the *longest registered prefix* of the folder:
the folder's prefixes are exploded and equi-joined with the registered
locations, and the longest match stays. So equal stack and resource names in
two accounts or two buckets stay apart, deeper folders (by year, by region)
belong to the location above them, and no row is counted twice.

A file-log location registered by several resources cannot be told apart:
:func:`location_errors` lists such locations, and :func:`registered` fails on
them from within the plan. Several resources may watch one log group; each
then gets its counts, as each asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywatch import config
from skywatch.operators.constraints import guarded

FOLDER = "logFolder"
_FILE_TYPES = (config.TYPE_CLOUDFRONT, config.TYPE_S3_ACCESS_LOGS)


def clean_path(path: Column) -> Column:
    """A path without slashes at its ends and without empty steps."""
    return F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "^/|/$", "")


def resource_location() -> Column:
    """Where a tracked resource's logs lie, from its columns."""
    own = F.when(F.col("type") == config.TYPE_LOG_GROUP, F.concat_ws("/", "accountId", "source")).otherwise(F.concat_ws("/", "source", "stackName", "name"))
    return clean_path(own)


def prefixes(path: Column) -> Column:
    """All folders on the way to ``path``, itself last."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))


def longest_prefix(rows: DataFrame, keys: list[str], path_col: str, locations: DataFrame) -> DataFrame:
    """``rows`` (unique by ``keys``) whose path lies at or under one of ``locations`` (column ``location``), with the
    longest such ``location``.

    The explode multiplies rows by the depth of their folder before the join (broadcast where the locations' measured
    size allows), and the final aggregate uses the partitioning that the aggregated rows come with."""
    rest = [c for c in rows.columns if c not in keys]
    known = locations.select(F.col("location").alias("_location")).where("_location IS NOT NULL").distinct()
    hits = rows.select("*", F.posexplode(prefixes(clean_path(F.col(path_col)))).alias("_depth", "_prefix")) \
        .join(known, F.col("_prefix") == F.col("_location"))
    return hits.groupBy(*keys).agg(F.max_by("_location", "_depth").alias("location"), *[F.any_value(c).alias(c) for c in rest])


def registered(resources: DataFrame) -> DataFrame:
    """(type, location, accountId, stackName, stackResourceName, _split) of the tracked resources.

    Running it fails where two resources of a file-log type register one location."""
    owners = resources.select(
        "type", resource_location().alias("location"), "accountId", "stackName", F.col("name").alias("stackResourceName"),
        F.coalesce(F.col("splitReportingByUrlRoot"), F.lit(False)).alias("_split"))
    groups = F.col("type") == config.TYPE_LOG_GROUP
    one = owners.where(F.col("type").isin(*_FILE_TYPES)).groupBy("type", "location") \
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("accountId", "stackName", "stackResourceName", "_split")).alias("r"))
    said = F.format_string("%d resources keep their logs at '%s'", F.col("n"), F.col("location"))
    one = one.select("type", guarded(F.col("location"), F.col("n") == 1, said).alias("location"), "r.*")
    return one.unionByName(owners.where(groups))


def location_errors(resources: DataFrame) -> DataFrame:
    """File-log locations that more than one resource of a type registers: (type, location, n_resources, error)."""
    files = resources.where(F.col("type").isin(*_FILE_TYPES))
    counts = files.select("type", resource_location().alias("location")).groupBy("type", "location").agg(F.count(F.lit(1)).alias("n_resources"))
    return counts.where("n_resources > 1").withColumn("error", F.format_string("%d resources keep their logs at '%s'", "n_resources", "location"))


def attribute(agg: DataFrame, owners: DataFrame, rtype: str) -> DataFrame:
    """Rows of an aggregated family (one per :data:`FOLDER` and further columns, with ``count``) by the resource they
    belong to. ``owners``: :func:`registered`, written once by the caller, since each family reads it.

    Rows of folders under no registered location are dropped (nobody asked for them); rows of one resource in several
    folders are summed. Only aggregated rows meet the resource table."""
    keys = [c for c in agg.columns if c != "count"]
    dims = [c for c in keys if c != FOLDER]
    own = owners.where(F.col("type") == rtype).drop("type")
    found = longest_prefix(agg.where(F.col(FOLDER).isNotNull()), keys, FOLDER, own).drop(FOLDER)
    return found.join(own, on="location").groupBy("accountId", "stackName", "stackResourceName", "_split", *dims).agg(F.sum("count").alias("count"))
