"""Inventory, template, stack-list, budget and request operators
(B32-B34, B39-B41, C6, C7, D7-D10, G12, G14, G15, H7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywatch import config
from skywatch.functions.scalars import strict_uri_encode
from skywatch.operators.constraints import guarded, matches
from skywatch.operators.ordering import numbered

# ------------------------------------------------------------------ B33, B34, C6, D10

def suffix_filter(df: DataFrame, col: str, include: list[str] | None, exclude: list[str] | None) -> DataFrame:
    """Keep a key if ``include`` is None or a suffix matches, and ``exclude``
    is None or no suffix matches (OR of ``endswith``)."""
    c = F.col(col)

    def any_suffix(sufs: list[str]) -> Column:
        out = F.lit(False)
        for s in sufs:
            out = out | F.endswith(c, F.lit(s))
        return out

    cond = F.lit(True)
    if include is not None:
        cond = cond & any_suffix(include)
    if exclude is not None:
        cond = cond & ~any_suffix(exclude)
    return df.where(cond)


def strip_prefix(keys: DataFrame, col: str, prefix: str, fail_outside: bool = True) -> DataFrame:
    """Fail if any key lies outside ``prefix``; drop ``prefix`` and one more char.

    The check is part of the projection: no extra pass, and it fails when the frame is run.
    """
    rest = F.substring(F.col(col), len(prefix) + 2, 1 << 30)
    if fail_outside:
        said = F.concat(F.lit(f"key outside '{prefix}': "), F.col(col))
        rest = guarded(rest, F.startswith(F.col(col), F.lit(prefix)) | F.col(col).isNull(), said)
    return keys.withColumn(col, rest)


def inventory_diff(remote: DataFrame, local: DataFrame, col: str = "path",
                   keep_remote: tuple[str, ...] = ("index.html",)) -> DataFrame:
    """C6 (+F3, F4): which names to delete, upload or leave.

    ``delete`` = remote only (never the kept index page), ``upload`` = local
    only, ``ignore`` = both. Names only; contents are not compared. One
    union and one aggregate per name (partial aggregation, a single
    shuffle, no join): a name repeated many times is collapsed map-side.
    """
    r = remote.select(F.col(col).alias("path"), F.lit(True).alias("_r"), F.lit(False).alias("_l"))
    l = local.select(F.col(col).alias("path"), F.lit(False).alias("_r"), F.lit(True).alias("_l"))
    sides = r.unionByName(l).groupBy("path").agg(F.bool_or("_r").alias("_r"), F.bool_or("_l").alias("_l"))
    action = (F.when(F.col("_r") & F.col("_l"), F.lit("ignore"))
               .when(F.col("_l"), F.lit("upload"))
               .when(~F.col("path").isin(*keep_remote), F.lit("delete")))
    return sides.select("path", action.alias("action")).where(F.col("action").isNotNull())


def action_counts(diff: DataFrame) -> DataFrame:
    """D10."""
    return diff.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ H7

def key_tree(keys: DataFrame, col: str = "path", drop_suffix: str = "index.html") -> DataFrame:
    """H7: folders and files of a key listing with their depth.

    Every key expands to its folder prefixes (``sequence`` + ``explode``);
    shared folders are de-duplicated (map-side first). ``listing_order`` is
    a sort key reproducing the reference's depth-first listing: per level,
    integer-like names first in numeric order (JavaScript object key order),
    then the rest in the order of the sorted keys they came from, i.e. by
    name with a trailing ``/`` for folders. A folder sorts before its
    contents because its key is a prefix of theirs.
    """
    k = keys.select(F.col(col).alias("key")).where(~F.endswith(F.col("key"), F.lit(drop_suffix))).distinct()
    parts = F.split(F.col("key"), "/", -1)
    n = F.size(parts)
    folders = (k.select(parts.alias("p"), n.alias("n"))
               .where(F.col("n") > 1)
               .select("p", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("i"))
               .select(F.slice("p", 1, F.col("i")).alias("path_parts"))
               .distinct()
               .select("path_parts", F.lit("folder").alias("kind")))
    files = k.select(parts.alias("path_parts"), F.lit("file").alias("kind"))
    order = F.expr(
        "transform(path_parts, (x, i) -> named_struct("
        "'text_key', CASE WHEN x RLIKE '^(0|[1-9][0-9]{0,9})$' AND CAST(x AS BIGINT) < 4294967295 THEN 0 ELSE 1 END, "
        "'number', CASE WHEN x RLIKE '^(0|[1-9][0-9]{0,9})$' AND CAST(x AS BIGINT) < 4294967295 "
        "THEN CAST(x AS BIGINT) ELSE 0 END, "
        "'name', concat(x, CASE WHEN i < size(path_parts) - 1 OR kind = 'folder' THEN '/' ELSE '' END)))")
    return (folders.unionByName(files)
            .select(F.array_join("path_parts", "/").alias("path"),
                    F.element_at("path_parts", -1).alias("name"),
                    (F.size("path_parts") - 1).alias("depth"),
                    "kind", "path_parts", order.alias("listing_order")))


def key_listing(keys: DataFrame, col: str = "path", drop_suffix: str = "index.html") -> DataFrame:
    """H7 + E3: :func:`key_tree` as the listing prints it: ``position`` (from 1, depth first) and, per folder, ``n_files``,
    the files below it at any depth (1 for a file).

    The order key of an entry begins with those of its folders, so a global order of the keys is the preorder; sizes
    are sums over each file's folders (partial sums first, so a folder that holds a third of all files is no hot key)."""
    tree = key_tree(keys, col, drop_suffix)
    parts = F.split("path", "/", -1)
    above = tree.where("kind = 'file'").select(F.explode(F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))).alias("_folder"))
    sizes = above.groupBy("_folder").agg(F.count(F.lit(1)).alias("_size"))
    sized = tree.drop("path_parts").join(sizes, (F.col("path") == F.col("_folder")) & (F.col("kind") == "folder"), "left")
    sized = sized.withColumn("n_files", F.coalesce(F.col("_size"), F.lit(1))).drop("_folder", "_size")
    return numbered(sized, ["listing_order", "kind"], "position").drop("listing_order")


def file_links(tree: DataFrame, base_path: str, custom=None) -> DataFrame:
    """A link per file of :func:`key_tree`; ``custom(file_path, name)`` may
    return a Column that is NULL where it has no opinion, and the default
    ``<a href="/<file_path>"><name></a>`` fills in (the reference's
    ``undefined`` fallback). Folders get no link. The HTML page itself is
    not built."""
    file_path = F.concat(F.lit(base_path + "/"), F.col("path"))
    default = F.concat(F.lit('<a href="/'), file_path, F.lit('">'), F.col("name"), F.lit("</a>"))
    link = F.coalesce(custom(file_path, F.col("name")), default) if custom else default
    return tree.withColumn("link", F.when(F.col("kind") == "file", link))


# ------------------------------------------------------------------ C7

def unique_lookup(resources: DataFrame, lookups: DataFrame) -> DataFrame:
    """For each wanted metadata path, the one logical id carrying it.

    ``resources (template, logicalId, path, physicalId)``, ``lookups
    (template, path)``. Zero or several matches give an ``error`` instead, and so does one without a physical id.
    """
    named = resources.where("logicalId IS NOT NULL").select("template", "path", "logicalId", "physicalId")
    found = matches(lookups.select("template", "path").distinct(), named, ["template", "path"],
                    F.min("logicalId").alias("_lid"), F.min("physicalId").alias("_pid"))
    one, path = F.col("n_matches") == 1, F.col("path")
    no_id = F.coalesce(F.col("_pid"), F.lit("")) == ""
    return found.select(
        "template", "path", "n_matches", F.when(one, F.col("_lid")).alias("logicalId"),
        F.when(one & ~no_id, F.col("_pid")).alias("physicalId"),
        F.when(F.col("n_matches") == 0, F.format_string("Nothing in the template has the path '%s'", path))
         .when(~one, F.format_string("%d logical ids have the path '%s'", F.col("n_matches"), path))
         .when(no_id, F.format_string("Logical id '%s' has no physical id", F.col("_lid"))).alias("error"))


# ------------------------------------------------------------------ B39, B32, D7

def deployed_stacks(stacks: DataFrame) -> DataFrame:
    """Complete stacks of developer profiles, one diff command line per stack."""
    ok = (F.col("StackStatus").isin("CREATE_COMPLETE", "UPDATE_COMPLETE")
          & (F.col("StackName") != config.BOOTSTRAP_STACK)
          & F.endswith(F.col("profile"), F.lit("-developer")))
    return stacks.where(ok).select(
        "profile", F.col("StackName").alias("stackName"),
        F.format_string("AWS_PROFILE=%s npx cdk diff --strict --fail %s", F.col("profile"), F.col("StackName"))
         .alias("command"))


def teardown_split(stacks: DataFrame) -> DataFrame:
    """protected = termination protection on, or the bootstrap stack."""
    protected = (F.coalesce(F.col("EnableTerminationProtection"), F.lit(False))
                 | (F.col("StackName") == config.BOOTSTRAP_STACK))
    return stacks.withColumn("protected", protected)


def teardown_outcome(split: DataFrame, result_col: str = "deleteResult") -> DataFrame:
    """D7 per stack: ``skipped`` (protected), ``failed`` (rejected request or any
    end state but DELETE_COMPLETE) or ``destroyed``."""
    r = F.col(result_col)
    outcome = (F.when(F.col("protected"), F.lit("skipped"))
                .when(r.isNull(), F.lit("failed"))
                .when(r != "DELETE_COMPLETE", F.lit("failed"))
                .otherwise(F.lit("destroyed")))
    detail = (F.when(F.col("protected"), F.lit(None))
               .when(r.isNull(), F.lit("request rejected"))
               .when(r != "DELETE_COMPLETE", r))
    return split.select("StackName", outcome.alias("outcome"), detail.alias("detail"))


def teardown_tally(outcomes: DataFrame) -> DataFrame:
    """Count per outcome (names stay as rows of :func:`teardown_outcome`)."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ D8, D9, B40

def budget_alerts(costs: DataFrame, thresholds: list[tuple[str, int, int]]) -> DataFrame:
    """Monthly cost above ``limit * pct / 100`` (strictly), per threshold.

    ``costs (month, cost_cents)``; ``thresholds`` are the configured
    ``(budget, limit_cents, pct)`` notifications, attached to every month as a
    literal array (no join); integer cents keep the comparison exact.
    """
    monthly = costs.groupBy("month").agg(F.sum("cost_cents").alias("cost_cents"))
    arr = F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(lim).cast("bigint").alias("limit_cents"),
                             F.lit(pct).alias("pct")) for b, lim, pct in thresholds])
    return (monthly.select("month", "cost_cents", F.explode(arr).alias("t"))
            .select("month", "cost_cents", "t.budget", "t.pct", "t.limit_cents")
            .where(F.col("cost_cents") * 100 > F.col("limit_cents") * F.col("pct")))


def function_assets(resources: DataFrame) -> DataFrame:
    """Asset ids of function resources, skipping the framework handler."""
    asset = F.regexp_replace(F.col("s3Key"), r"\.zip$", "")
    return (resources
            .where((F.col("Type") == "AWS::Lambda::Function")
                   & ~F.col("handler").eqNullSafe(F.lit("framework.onEvent")))
            .select("template", "logicalId", asset.alias("asset"))
            .where(F.coalesce(F.length("asset") > 0, F.lit(False))))


def asset_count_check(assets: DataFrame, expected: DataFrame) -> DataFrame:
    """Assets found per template against the expected number."""
    found = assets.groupBy("template").agg(F.count(F.lit(1)).alias("n_assets"))
    return (expected.join(found, on="template", how="left")
            .select("template", F.coalesce(F.col("n_assets"), F.lit(0)).alias("n_assets"), "expected")
            .withColumn("ok", F.col("n_assets") == F.col("expected")))


# ------------------------------------------------------------------ B41, G14, G15

def upload_manifest(requests: DataFrame, bucket_prefix: str) -> DataFrame:
    """B41 + G14 + G15: validate upload requests and build object keys and expiries.

    The random part of a key is the request's ``request_id`` (pass a uuid
    column in production). Deviation: a missing file name is rejected.
    """
    name = strict_uri_encode(F.col("fileName"))
    p = F.col("prefixes")
    e1 = F.when(name.isNull() | (F.length(name) == 0),
                F.lit("parameter 'fileName' must be specified and non-empty string"))
    e2 = F.when(p.isNotNull() & (F.size(p) == 0),
                F.lit("if specified, parameter 'prefixes' must be a non-zero length array"))
    errors = F.concat_ws("; ", e1, e2)
    prefix = F.when(p.isNotNull() & (F.size(p) > 0), F.concat(F.array_join(p, "/"), F.lit("/"))).otherwise(F.lit(""))
    valid = errors == ""
    key = F.concat(F.lit(bucket_prefix + "/"), prefix, name, F.lit("-"), F.col("request_id"))
    return requests.select(
        "request_id", valid.alias("valid"),
        F.when(~valid, errors).alias("errors"),
        F.when(valid, key).alias("key"),
        F.when(valid, F.col("ts") + F.make_interval(secs=F.lit(config.PUT_URL_EXPIRES_SECONDS))).alias("put_expires"),
        F.when(valid, F.col("ts") + F.make_interval(secs=F.lit(config.GET_URL_EXPIRES_SECONDS))).alias("get_expires"))


# ------------------------------------------------------------------ G12

def fields_to_row(df: DataFrame, fields_col: str, names: list[str], keep: list[str]) -> DataFrame:
    """An array of ``{field, value}`` becomes columns; a repeated field
    keeps its last value, as assigning object keys in order does."""
    arr = F.col(fields_col)

    def last(n: str) -> Column:
        return F.try_element_at(F.filter(arr, lambda x: x["field"] == F.lit(n)), F.lit(-1))["value"]

    return df.select(*keep, *[last(n).alias(n) for n in names])
