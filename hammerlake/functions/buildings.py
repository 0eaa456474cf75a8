"""Building registers: parcels, ages, and one summary of several buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a violation, and years that can be one of completion.
VIOLATIONS, YEARS = ["1", "y", "yes", "true", "위반", "위반건축물"], (1800, 3000)
PARCEL = r"(산\s*)?(\d{1,4})(?:-(\d{1,4}))?(?=\s|,|$|번지)"


def parcel(address: Column) -> Column:
    """``(bun, ji)`` of the last lot number in an address, padded to four digits; null for mountain lots and where none is."""
    at = lambda k: F.element_at(F.regexp_extract_all(address, F.lit(PARCEL), F.lit(k)), -1)
    plain = address.rlike(PARCEL) & (at(1) == "")
    return F.when(plain, F.struct(F.lpad(at(2), 4, "0").alias("bun"), F.lpad(F.when(at(3) == "", "0").otherwise(at(3)), 4, "0").alias("ji")))


def age(approved: Column, year: Column) -> Column:
    """Years since the approval (``YYYY`` or longer); 0 if it lies ahead, null if it can't be read or can't be true."""
    y = F.substring(F.trim(approved), 1, 4).try_cast("int")
    return F.when(F.trim(approved).rlike(r"^\d{4}") & y.between(*YEARS), F.greatest(F.lit(0), year - y))


def is_violation(flag: Column) -> Column:
    return F.lower(F.trim(F.coalesce(flag, F.lit("")))).isin(VIOLATIONS)


def summary(buildings: DataFrame, keys: list[str], year: Column) -> DataFrame:
    """``(keys, approved, age, purpose, violation, buildings)``: the largest building's facts, any building's violation, and how many there are."""
    main = F.max_by(F.struct("approved", "purpose"), F.struct("area_m2", "name"))
    found = buildings.groupBy(*keys).agg(main.alias("m"), F.bool_or(is_violation(F.col("violation"))).alias("violation"), F.count(F.lit(1)).alias("buildings"))
    shown = F.when(F.length("m.approved") >= 6, F.concat_ws(".", F.substring("m.approved", 1, 4), F.substring("m.approved", 5, 2))).when(F.length("m.approved") >= 4, F.substring("m.approved", 1, 4)).otherwise("")
    return found.select(*keys, shown.alias("approved"), age(F.col("m.approved"), year).alias("age"), F.col("m.purpose").alias("purpose"), "violation", "buildings")
