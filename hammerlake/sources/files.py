"""Readers of landed files: listings in JSON, trades and building records in XML, nested price histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hammerlake.functions import numbers

LISTING = "court string, case_no string, item_no string, doc_id string, address string, dong string, apt_name string, property_type string, lawd_cd string, area_m2 double, appraisal_price bigint, min_bid_price bigint, fail_count int, sale_date string, assumed_amount bigint, burden_amount_unknown boolean, tenant_opposable boolean, rights_verified boolean, special_rights array<string>, occupant_type string"
# Names of the same field in the two forms of the trade files.
TRADE_FIELDS = {"apt_name": ["aptNm", "아파트", "단지"], "area_m2": ["excluUseAr", "전용면적"], "price": ["dealAmount", "거래금액"], "year": ["dealYear", "년"], "month": ["dealMonth", "월"], "dong": ["umdNm", "법정동"], "floor": ["floor", "층"], "cdeal_type": ["cdealType", "해제여부"], "cdeal_day": ["cdealDay", "해제사유발생일"], "lawd_cd": ["sggCd", "지역코드"]}


def listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings from JSON (an array or a record a line); missing fields are null, and a missing key part is empty."""
    rows = spark.read.schema(LISTING).option("multiLine", True).json(path)
    return rows.withColumns({k: F.coalesce(k, F.lit("")) for k in ("court", "case_no", "item_no")})


def trades(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Trades from XML ``item`` elements; amounts are in ten thousands, a bad floor is 0, and rows without price or
    area are left out. A trade is cancelled by its mark or by its date."""
    schema = ", ".join(f"`{n}` string" for names in TRADE_FIELDS.values() for n in names)
    raw = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    field = {k: F.trim(F.coalesce(*[F.col(f"`{n}`") for n in names])) for k, names in TRADE_FIELDS.items()}
    whole = lambda k: numbers.lenient_number(field[k])
    out = raw.select(
        field["apt_name"].alias("apt_name"), field["area_m2"].try_cast("double").alias("area_m2"), (whole("price") * 10_000).alias("price"),
        F.concat(field["year"], F.lpad(field["month"], 2, "0")).alias("deal_ym"), field["dong"].alias("dong"), F.coalesce(whole("floor"), F.lit(0)).cast("int").alias("floor"),
        F.lit(kind).alias("kind"), field["lawd_cd"].alias("lawd_cd"), ((F.coalesce(field["cdeal_type"], F.lit("")) == "O") | (F.coalesce(field["cdeal_day"], F.lit("")) != "")).alias("cancelled"),
    )
    return out.where("price > 0 and area_m2 > 0")


# Fields of the three other kinds of trades ('sh' houses, 'nrg' commercial, 'land') and of building registers.
OTHER_FIELDS = {
    "price": ["거래금액", "dealAmount"], "year": ["년", "dealYear"], "month": ["월", "dealMonth"], "dong": ["법정동", "umdNm"], "floor": ["층", "floor"],
    "house_type": ["주택유형", "houseType"], "plot_area": ["대지면적", "plottageAr"], "floor_area": ["연면적", "totalFloorAr"],
    "building_use": ["건물주용도", "buildingUse"], "building_type": ["유형", "buildingType"], "building_area": ["건물면적", "buildingAr"],
    "jimok": ["지목", "jimok"], "land_use": ["용도지역", "landUse"], "deal_area": ["거래면적", "dealArea"], "share_type": ["지분구분", "shareDealingType", "shareType"],
}
REGISTER_FIELDS = {"name": ["bldNm", "건물명"], "address": ["platPlc", "대지위치", "newPlatPlc"], "approved": ["useAprDay", "사용승인일"], "purpose": ["mainPurpsCdNm", "주용도"], "area_m2": ["totArea", "연면적"], "floors_above": ["grndFlrCnt", "지상층수"], "floors_below": ["ugrndFlrCnt", "지하층수"], "violation": ["violYn", "위반건축물", "violationYn"], "violation_text": ["violCn", "위반내용"]}


def _schema(fields: dict[str, list[str]]) -> str:
    return ", ".join(f"`{n}` string" for names in fields.values() for n in names)


def _load(spark: SparkSession, path: str, fields: dict[str, list[str]]) -> DataFrame:
    """The ``item`` elements of XML files."""
    return spark.read.format("xml").option("rowTag", "item").schema(_schema(fields)).load(path)


def _archived(rows: DataFrame, fields: dict[str, list[str]], body: str) -> DataFrame:
    """The ``item`` elements that an archive keeps as texts, one a row, with its other columns; what can't be read is empty."""
    # by way of an array: a condition on the fields would otherwise be pushed below, and parse the text again for each of them
    return rows.withColumn("_i", F.explode(F.array(F.from_xml(body, _schema(fields))))).select(*[c for c in rows.columns if c != body], "_i.*")


def _first_names(fields: dict[str, list[str]]) -> dict[str, Column]:
    """The first name of each field that has a value; empty if none does."""
    return {k: F.coalesce(*[F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names], F.lit("")) for k, names in fields.items()}


def other_trades(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Trades of houses, commercial buildings or land: the area is the building's, or else the plot's; name and subtype say what was sold.
    Rows without price or area are left out; an unknown kind is an error."""
    return _other(_load(spark, path, OTHER_FIELDS), kind)


def other_trades_of(rows: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """``other_trades`` of archived items (``body``), with the archive's other columns."""
    return _other(_archived(rows, OTHER_FIELDS, body), kind, [c for c in rows.columns if c != body])


def _other(raw: DataFrame, kind: str, keys: Sequence[str] = ()) -> DataFrame:
    f = _first_names(OTHER_FIELDS)
    size = lambda k: F.nullif(F.coalesce(f[k].try_cast("double"), F.lit(0.0)), F.lit(0.0))
    none = F.lit("")
    area, name, subtype, zoning = {
        "sh": (F.coalesce(size("floor_area"), size("plot_area")), F.coalesce(F.nullif(f["house_type"], none), F.lit("단독/다가구")), f["house_type"], none),
        "nrg": (F.coalesce(size("building_area"), size("plot_area")), F.coalesce(F.nullif(f["building_use"], none), F.lit("상업업무용")), f["building_type"], none),
        "land": (size("deal_area"), F.coalesce(F.nullif(f["jimok"], none), F.lit("토지")), f["share_type"], f["land_use"]),
    }[kind]
    plot = F.lit(0.0) if kind == "land" else F.coalesce(size("plot_area"), F.lit(0.0))
    out = raw.select(*keys, F.lit(kind).alias("kind"), (numbers.lenient_number(f["price"]) * 10_000).alias("price"), area.alias("area_m2"), F.when(f["year"] != "", F.concat(f["year"], F.lpad(f["month"], 2, "0"))).otherwise("").alias("deal_ym"), f["dong"].alias("dong"), name.alias("name"), plot.alias("plot_area_m2"), subtype.alias("subtype"), zoning.alias("zoning"), F.coalesce(numbers.lenient_number(f["floor"]), F.lit(0)).cast("int").alias("floor"))
    return out.where("price > 0 and area_m2 > 0")


def as_trades(others: DataFrame, lawd_cd: str = "") -> DataFrame:
    """Other kinds in the form of ``trades``: they have no building's name, and meet by neighbourhood and area only."""
    return others.select(F.lit("").alias("apt_name"), "area_m2", "price", "deal_ym", "dong", "floor", "kind", F.lit(lawd_cd).alias("lawd_cd"), F.lit(False).alias("cancelled"))


def registers(spark: SparkSession, path: str) -> DataFrame:
    """Building records; sizes and floors that can't be read are 0."""
    return _register(_load(spark, path, REGISTER_FIELDS))


def registers_of(rows: DataFrame, body: str = "body") -> DataFrame:
    """``registers`` of archived items (``body``), with the archive's other columns."""
    return _register(_archived(rows, REGISTER_FIELDS, body), [c for c in rows.columns if c != body])


def _register(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    f = _first_names(REGISTER_FIELDS)
    whole = {"floors_above": "int", "floors_below": "int", "area_m2": "double"}
    return raw.select(*keys, *[(F.coalesce(v.try_cast(whole[k]), F.lit(0).cast(whole[k])) if k in whole else v).alias(k) for k, v in f.items()])


def price_months(raw: DataFrame, json: str = "body") -> DataFrame:
    """Rows of a two-level history: each month's list of prices becomes rows; other columns stay."""
    schema = "realPriceOnMonthList array<struct<realPriceList: array<struct<tradeYear: string, tradeMonth: string, tradeDate: string, dealPrice: bigint, floor: int, deleteYn: string>>>>"
    one = raw.withColumn("_m", F.explode(F.from_json(json, schema)["realPriceOnMonthList"])).withColumn("_p", F.explode("_m.realPriceList"))
    ymd = F.concat(F.col("_p.tradeYear"), F.lpad("_p.tradeMonth", 2, "0"), F.lpad(F.coalesce("_p.tradeDate", F.lit("0")), 2, "0"))
    return one.select(*[c for c in raw.columns if c != json], ymd.alias("trade_ymd"), (F.col("_p.dealPrice") * 10_000).alias("price"), F.coalesce("_p.floor", F.lit(0)).alias("floor"), (F.col("_p.deleteYn") == "Y").cast("int").alias("deleted"))


def missing_keys(rows: DataFrame, json: str, wanted: list[str]) -> Column:
    """The wanted keys that a JSON object lacks (a null value is no lack)."""
    return F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """``(case_no, actual, resale)`` of a JSON object by case; values that are no objects are skipped."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("case_no", "v"))
    parsed = F.from_json("v", "actual_nakchal bigint, realized_sale bigint")
    return pairs.where(F.col("v").startswith("{")).select("case_no", parsed["actual_nakchal"].alias("actual"), parsed["realized_sale"].alias("resale"))
