"""IP risk enrichment.

The address dimension may be far larger than the addresses a report sees. Its
rows are tested at the scan against a bit map of the hashes of the seen
addresses (at most :data:`MAP_BITS` bits, 4 KB a bucket, so its broadcast is
bounded at 8 MB however many addresses there are), and only what passes is
shuffled to the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywatch.functions.scalars import js_text, strip_network_number

MAP_BITS = 1 << 26
_BUCKET_BITS = 1 << 15


def risk_class(country_code: Column, high: list[str], home: list[str]) -> Column:
    """``high`` if in the high-risk list, ``low`` if home, else ``medium`` (NULL too)."""
    return (F.when(country_code.isin(*high) if high else F.lit(False), F.lit("high"))
             .when(country_code.isin(*home) if home else F.lit(False), F.lit("low"))
             .otherwise(F.lit("medium")))


def ip_dimension(ip_info: DataFrame, high: list[str], home: list[str]) -> DataFrame:
    """G3 + G4: ``(ip, risk, description, shortDescription)`` per dimension row.

    Missing parts print as ``undefined``, as the reference's template text does.
    """
    return ip_info.select(
        "ip",
        risk_class(F.col("countryCode"), high, home).alias("risk"),
        F.concat(js_text("country"), F.lit(" > "), js_text("region"), F.lit(" > "),
                 js_text("city"), F.lit(" ("), js_text("org"), F.lit(")")).alias("description"),
        F.concat(js_text("country"), F.lit(" ("), js_text("org"), F.lit(")")).alias("shortDescription"))


def _slot(ip: Column) -> Column:
    return F.pmod(F.xxhash64(ip), F.lit(MAP_BITS)) + 1  # bit numbers begin at 1


def seen_only(dim: DataFrame, addresses: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Rows of ``dim`` whose address may be among ``addresses`` (column ``ip``): all that are, and few others (one in
    67 for a million addresses)."""
    slot = _slot(F.col("ip"))
    seen = addresses.where("ip IS NOT NULL").select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    maps = seen.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    # A map has at most MAP_BITS / 2^15 rows of 4 KB, whatever is seen.
    own, position = F.bitmap_bucket_number(_slot(F.col(ip_col))), F.bitmap_bit_position(_slot(F.col(ip_col)))
    byte = F.conv(F.hex(F.substring("bits", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1
    return dim.join(F.broadcast(maps), own == F.col("bucket")).where(hit).select(*dim.columns)


def seen_from_enriched(enriched: DataFrame) -> DataFrame:
    """D5 from an enriched frame: ``(ip, risk, description, shortDescription)`` of known addresses."""
    return (enriched.where(F.col("known"))
            .select(F.col("sourceIp").alias("ip"), "risk", "description", "shortDescription").distinct())


def enrich(usage: DataFrame, dim: DataFrame) -> DataFrame:
    """Every usage row gets ``risk`` (``unknown`` without a match) and the
    dimension texts; ``known`` tells whether the address was found. ``usage`` is
    read twice: for the addresses it holds, and for the join."""
    dim = seen_only(dim, usage.select(F.col("sourceIp").alias("ip")).distinct())
    d = dim.select(F.col("ip").alias("sourceIp"), F.col("risk").alias("_risk"),
                   "description", "shortDescription", F.lit(True).alias("known"))
    # One row per address, whatever the dimension repeats: else usage would be counted again.
    d = d.groupBy("sourceIp").agg(F.max(F.struct("_risk", "description", "shortDescription", "known")).alias("_d")).select("sourceIp", "_d.*")
    # AQE broadcasts it when its measured size
    # is under the threshold and keeps the sort-merge join otherwise.
    out = usage.join(d, on="sourceIp", how="left")
    return (out.withColumn("risk", F.coalesce(F.col("_risk"), F.lit("unknown")))
               .withColumn("known", F.coalesce(F.col("known"), F.lit(False)))
               .drop("_risk"))


def ip_descriptor(enriched: DataFrame) -> DataFrame:
    """G5 + G6: raw IP if unknown, else ``<risk> risk[ (<geo>)]: <short, no AS number>``."""
    geo = F.when(F.coalesce(F.col("geoBlocked"), F.lit("")) != "",
                 F.concat(F.lit(" ("), F.col("geoBlocked"), F.lit(")"))).otherwise(F.lit(""))
    desc = F.concat(F.col("risk"), F.lit(" risk"), geo, F.lit(": "),
                    strip_network_number("shortDescription"))
    return enriched.withColumn("descriptor", F.when(F.col("known"), desc).otherwise(F.col("sourceIp")))
