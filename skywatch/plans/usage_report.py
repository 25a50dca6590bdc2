"""Weekly usage report (flagship; SURVEY §3.1): usage rows -> risk -> roll-up -> report.

Stages 3-11 of the reference are one lazy lineage here. Physical plan at
scale: one scan per log family with the date filter pushed down, a
partial+final aggregate per family (the big shuffle, already reduced
map-side), one join with the tracked resources by log folder, one join of the
aggregated rows to the IP dimension (broadcast when its measured size
allows), and a second small aggregate for the roll-up. The report has several
consumers of the enriched rows, so it reads a materialized copy; the report
itself is a frame of ordered lines (H1, H2); only a sink turns it into text.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywatch.operators import iprisk, usage
from skywatch.operators.ordering import numbered
from skywatch.session import materialize


def usage_enriched(usage_df: DataFrame, ip_info: DataFrame, high: list[str], home: list[str]) -> DataFrame:
    """C1 + G6 on usage rows: risk, dimension texts and the report descriptor.

    The aggregated rows are written once, because the dimension is first reduced to the addresses in them; what is
    left of it joins on ``ip`` (a shuffle join, or a broadcast when its measured size allows).
    """
    usage_df = materialize(usage_df, "usage_rows")
    return iprisk.ip_descriptor(iprisk.enrich(usage_df, iprisk.ip_dimension(ip_info, high, home)))


def report_lines(enriched: DataFrame, errors: DataFrame, days: int) -> DataFrame:
    """H1 (+E1, E2): the short report as rows ``(section, title, kind, line)``.

    Order by ``(section, title, kind, line)`` to read it: section 0 is the
    heading, 1 the IP lines, 2 one block per title (kind 0 = title, kind 1 =
    its ``descriptor: count`` lines in text order, so counts sort as text),
    3 errors (one compact JSON resource per line), 4 ``No usage found.`` when
    there is no usage. Blank separator lines are the renderer's job.
    """
    spark = enriched.sparkSession
    head = spark.createDataFrame([(0, "", 0, f"Usage info for the past {days} days:")],
                                 "section int, title string, kind int, line string")
    dim = iprisk.seen_from_enriched(enriched)
    ips = dim.select(F.lit(1).alias("section"), F.lit("").alias("title"), F.lit(0).alias("kind"),
                     F.concat(F.col("ip"), F.lit(": "), F.col("description"), F.lit(" ("), F.col("risk"),
                              F.lit(" risk)")).alias("line"))
    rolled = usage.usage_rollup(enriched)
    titles = rolled.select("title").distinct().select(
        F.lit(2).alias("section"), "title", F.lit(0).alias("kind"), F.col("title").alias("line"))
    items = rolled.select(F.lit(2).alias("section"), "title", F.lit(1).alias("kind"),
                          F.concat(F.col("descriptor"), F.lit(": "), F.col("total").cast("string")).alias("line"))
    err = errors.select(F.lit(3).alias("section"), F.lit("").alias("title"), F.lit(0).alias("kind"),
                        F.concat(F.lit("errors: "),
                                 F.to_json(F.struct("name", "source", "type", "splitReportingByUrlRoot"))).alias("line"))
    empty = (enriched.groupBy().agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
             .select(F.lit(4).alias("section"), F.lit("").alias("title"), F.lit(0).alias("kind"),
                     F.lit("No usage found.").alias("line")))
    return head.unionByName(ips).unionByName(titles).unionByName(items).unionByName(err).unionByName(empty)


def ordered_lines(lines: DataFrame) -> DataFrame:
    """The report's lines with their ``line_number``."""
    return numbered(lines, ["section", "title", "kind", "line"])


def detail_lines(enriched: DataFrame) -> DataFrame:
    """H2: one line per usage row, with risk and the geo-block text; no URL root."""
    block = F.when(F.coalesce(F.col("geoBlocked"), F.lit("")) != "",
                   F.concat(F.lit(", "), F.col("geoBlocked"))).otherwise(F.lit(""))
    line = F.concat(F.col("accountId"), F.lit("/"), F.col("stackName"), F.lit("/"), F.col("stackResourceName"),
                    F.lit(" "), F.col("date"), F.lit(" ("), F.col("count").cast("string"), F.lit("): "),
                    F.col("event"), F.lit(", "), F.col("sourceIp"), F.lit(" ("), F.col("risk"),
                    F.lit(" ip risk"), block, F.lit(")"))
    return enriched.select(line.alias("line"))


def render(lines: DataFrame) -> str:
    """Assemble a *small* report's text on the driver (tests, previews), with
    the reference's blank lines: after the heading, after the IP list (when
    there is one), between title blocks, an empty body line when there is
    no usage, and one before the errors.

    Production writes the ordered lines with
    :func:`skywatch.sources.sinks.write_report_lines` instead.
    """
    by_section: dict[int, list] = {}
    for r in lines.orderBy("section", "title", "kind", "line").toLocalIterator():
        by_section.setdefault(r.section, []).append(r)
    out = [r.line for r in by_section.get(0, [])] + [""]
    ips = [r.line for r in by_section.get(1, [])]
    if ips:
        out += ips + [""]
    blocks = by_section.get(2, [])
    if not blocks:
        out.append("")  # the empty body still takes a line
    prev_title = None
    for r in blocks:
        if prev_title is not None and r.title != prev_title:
            out.append("")
        out.append(r.line)
        prev_title = r.title
    errors = [json.loads(r.line[len("errors: "):]) for r in by_section.get(3, [])]
    if errors:  # one pretty-printed array, as JSON.stringify(errors, null, 2)
        out += ["", "errors: " + json.dumps(errors, indent=2, ensure_ascii=False)]
    out += [r.line for r in by_section.get(4, [])]
    return "\n".join(out)
