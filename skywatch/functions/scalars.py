"""Column-returning scalar helpers (dates, texts, keys, addresses).

Everything here builds JVM-side expressions: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's for the same texts ----
# First path segment with a slash after it.
_URL_ROOT = r"^/?([^/]+)/"
# "Country (AS123 Org)".
_NETWORK_NUMBER = r"^([^\(]+\()AS\d+ (.+\))$"
# How a JavaScript Date prints in a template literal in a UTC runtime.
JS_DATE_FORMAT = "EEE MMM dd yyyy HH:mm:ss 'GMT+0000 (Coordinated Universal Time)'"
# ---------------------------------------------------------------------------


def col_or_lit(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


# ---------------------------------------------------------------- dates

def epoch_to_date_text(x, millis: bool = True) -> Column:
    """Seconds or millis since the epoch -> ``yyyy-MM-dd`` in UTC (G1)."""
    c = col_or_lit(x)
    ts = F.timestamp_millis(c) if millis else F.timestamp_seconds(c)
    return F.date_format(ts, "yyyy-MM-dd")


def log_time_to_date(text) -> Column:
    """``dd/MMM/yyyy:HH:mm:ss Z`` -> DATE in the offset the line was logged with.

    The calendar date is the first 11 characters, so it does not depend on
    the session zone; bad text gives NULL.
    """
    return F.try_to_date(F.substring(col_or_lit(text), 1, 11), "dd/MMM/yyyy")


def js_date_text(millis) -> Column:
    """Epoch millis -> the text of ``new Date(millis)`` in a template literal (UTC)."""
    return F.date_format(F.timestamp_millis(col_or_lit(millis)), JS_DATE_FORMAT)


def is_monday(d) -> Column:
    """Weekday test in UTC (G16); ``weekday`` is 0 for Monday."""
    return F.weekday(col_or_lit(d)) == 0


# ---------------------------------------------------------------- text

def first_path_segment(uri) -> Column:
    """First path segment when a slash follows it, else NULL."""
    return F.nullif(F.regexp_extract(col_or_lit(uri), _URL_ROOT, 1), F.lit(""))


def strip_network_number(short_description) -> Column:
    """``Country (AS123 Org)`` -> ``Country (Org)``; other texts unchanged."""
    return F.regexp_replace(col_or_lit(short_description), _NETWORK_NUMBER, "$1$2")


def safe_table_name(name) -> Column:
    """Lower-case, every char outside ``[a-z_0-9]`` becomes ``__``."""
    return F.regexp_replace(F.lower(col_or_lit(name)), r"[^a-z_0-9]", "__")


def strict_uri_encode(text) -> Column:
    """URI-component encoding with ``%!'()*`` removed afterwards.

    The JVM encoder writes space as ``+`` and escapes ``~``; the component
    encoder writes ``%20`` and keeps ``~``. After the percent signs are
    dropped, a space reads ``20``.
    """
    c = F.regexp_replace(col_or_lit(text), r"[!'()*]", "")
    c = F.url_encode(c)
    c = F.replace(c, F.lit("+"), F.lit("%20"))
    c = F.replace(c, F.lit("%7E"), F.lit("~"))
    return F.replace(c, F.lit("%"), F.lit(""))


def js_text(c) -> Column:
    """How a JavaScript template literal prints a possibly missing string."""
    return F.coalesce(col_or_lit(c).cast("string"), F.lit("undefined"))


# ---------------------------------------------------------------- addresses

_IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def ipv4_to_long(ip) -> Column:
    """Dotted IPv4 text -> BIGINT; anything else (host names, IPv6) -> NULL."""
    c = col_or_lit(ip)
    parts = F.split(c, r"\.")
    num = F.aggregate(parts, F.lit(0).cast("bigint"),
                      lambda acc, x: acc * F.lit(256) + x.cast("bigint"))
    return F.when(c.rlike(_IPV4), num)
