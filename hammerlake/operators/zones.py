"""Addresses in regulated zones, told in three ways: yes, no, and 'to be checked'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECK = "check"
#: Zones that every row may be held against; more are an error, as they are sent to every task.
MOST_ZONES = 10_000


def classify(rows: DataFrame, zones: DataFrame, address: str, apartment: str, as_of: Column) -> DataFrame:
    """``rows`` with adjusted ('true', 'false' or 'check'), zone_name, land_permit and permit_expired.

    ``zones`` is a small table (zone_name, prefix, tokens, check_tokens, expiry): an address is in a zone if it begins with the
    prefix or has a token, and has to be looked at if it has a check token only. Permits are for apartments, up to their last day.
    Of several zones a sure one comes first, then the first by name. Without any zone known, all is to be checked.
    """
    if zones.limit(MOST_ZONES + 1).count() > MOST_ZONES:
        raise ValueError(f"more than {MOST_ZONES} zones")
    z = zones.select("zone_name", F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.coalesce("check_tokens", F.array().cast("array<string>")).alias("check_tokens"), "expiry")
    every = z.agg(F.collect_list(F.struct("*")).alias("_zones"))  # a dimension of some dozens of rows
    a = F.coalesce(F.col(address), F.lit(""))

    def verdict(x: Column) -> Column:
        sure = ((x["prefix"] != "") & a.startswith(x["prefix"])) | F.exists(x["tokens"], lambda t: F.contains(a, t))
        maybe = F.exists(x["check_tokens"], lambda t: F.contains(a, t))
        return F.when(sure, F.struct(F.lit(0).alias("o"), x["zone_name"].alias("zone_name"), x["expiry"].alias("expiry"))).when(maybe, F.struct(F.lit(1).alias("o"), x["zone_name"].alias("zone_name"), F.lit(None).cast(zones.schema["expiry"].dataType).alias("expiry")))

    met = rows.crossJoin(F.broadcast(every)).withColumn("_z", F.array_min(F.filter(F.transform("_zones", verdict), lambda v: v.isNotNull())))
    adjusted = F.when(F.size("_zones") == 0, CHECK).when(F.col("_z").isNull(), "false").when(F.col("_z.o") == 0, "true").otherwise(CHECK)
    permit = (adjusted == "true") & F.col(apartment) & F.col("_z.expiry").isNotNull()
    return met.select(*rows.columns, adjusted.alias("adjusted"), F.col("_z.zone_name").alias("zone_name"), F.coalesce(permit & (as_of <= F.col("_z.expiry")), F.lit(False)).alias("land_permit"), F.coalesce(permit & (as_of > F.col("_z.expiry")), F.lit(False)).alias("permit_expired"))
