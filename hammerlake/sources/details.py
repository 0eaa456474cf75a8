"""From the JSON of a sale's detail and of the survey of its occupants to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammerlake.functions import detail, money, numbers, rights, text

# Keys of the survey and of the detail, as far as they are read: none that tells of persons is.
SURVEY = "struct<errors: string, ipcheck: boolean, result: struct<ipcheck: boolean, dlt_ordTsLserLtn: array<struct<mvinDtlCtt: string, rgstryCrtcpCfmtnCtt: string, lesDposDts: string, lesUsgDts: string, lesPartCtt: string, gdsPossCtt: string>>, dma_curstExmnMngInf: struct<printRltnDts: string, exmnDtDts: string>, dlt_ordTsRlet: array<struct<gdsPossCtt: string, printSt: string, lesCnt: int>>>>"
DETAIL = "struct<csBaseInfo: struct<clmAmt: string, cortAuctnJdbnNm: string, userCsNo: string>, dspslGdsDxdyInfo: struct<gdsSpcfcRmk: string, dspslGdsRmk: string, ndstrcRghCtt: string, tprtyRnkHypthcStngDts: string, sprfcExstcDts: string, gdsSpcfcWrtYmd: string>, dstrtDemnInfo: array<struct<dstrtDemnLstprdYmd: string>>, gdsDspslDxdyLst: array<struct<dxdyYmd: string, auctnDxdyKndCd: string, auctnDxdyRsltCd: string, tsLwsDspslPrc: string>>, aeeWevlMnpntLst: array<struct<aeeWevlMnpntItmCd: string, aeeWevlMnpntCtt: string>>, csPicLst: array<struct<picFile: string>>>"
KEPT_PHOTOS, NO_TEXT = 3, ["", "-", "–"]


def surveys(rows: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """``(keys, known, tenants, possession, survey_dates, address, tenant_count)`` of surveys' JSON.

    known tells whether the answer is one at all: an answer without context, with errors, or that isn't JSON says nothing about
    tenants, whose array is then null; an empty array says that there are none. Who has a deposit, a confirmed date, a usage or a
    part counts as a tenant. possession has the lines of what was found, masked; it is null without any.
    """
    s = rows.select(*keys, F.from_json(body, SURVEY).alias("s"))
    known = F.coalesce(F.col("s.errors").isNull() & (F.coalesce("s.ipcheck", F.lit(False)) | F.coalesce("s.result.ipcheck", F.lit(False))), F.lit(False))
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))

    def tenant(r: Column) -> Column:
        deposit = rights.won(F.regexp_replace(F.coalesce(r["lesDposDts"], F.lit("")), r"[금원\s]", ""))
        moved, confirmed = (F.coalesce(detail.first_date(r[k]), F.lit("")) for k in ("mvinDtlCtt", "rgstryCrtcpCfmtnCtt"))
        facts = {"movein_ymd": moved, "confirm_ymd": confirmed, "deposit": deposit, "possession": blank(r["gdsPossCtt"]), "usage": blank(r["lesUsgDts"]), "part": blank(r["lesPartCtt"])}
        like = lambda x: (x["deposit"] > 0) | (x["confirm_ymd"] != "") | (x["usage"] != "") | (x["part"] != "")
        return money.let(facts, lambda x: F.struct(*[x[k].alias(k) for k in facts], like(x).alias("is_tenant_like")))

    found = F.filter(F.coalesce("s.result.dlt_ordTsLserLtn", F.array()), lambda r: r.isNotNull())
    place = F.get("s.result.dlt_ordTsRlet", 0)
    lines = F.regexp_replace(detail.clean(F.coalesce(place["gdsPossCtt"], F.lit(""))), r"(?i)<br\s*/?>|\r", "\n")
    said = F.array_join(F.filter(F.transform(F.split(lines, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    out = s.select(*keys, known.alias("known"), F.when(known, F.transform(found, tenant)).alias("tenants"), F.nullif(said, F.lit("")).alias("said"), F.trim(F.regexp_replace(F.coalesce("s.result.dma_curstExmnMngInf.exmnDtDts", F.lit("")), r"\s+", " ")).alias("survey_dates"), F.trim(F.regexp_replace(F.coalesce(place["printSt"], F.lit("")), r"\s+", " ")).alias("address"), place["lesCnt"].alias("tenant_count"))
    return out.withColumn("possession", text.masked_names("said")).select(*keys, "known", "tenants", "possession", "survey_dates", "address", "tenant_count")


def details(rows: DataFrame, keys: list[str], kinds: dict[str, str], results: dict[str, str], labels: dict[str, str], body: str = "body") -> DataFrame:
    """The rights row of each detail's JSON: texts cleaned and masked, dates, the schedule (newest first), appraisal notes, photos.

    ``kinds``, ``results`` and ``labels`` name codes; one that isn't known stays as it is, or is a general note. Missing sections are empty.
    """
    d = rows.select(*keys, F.from_json(body, DETAIL).alias("d"))
    named = lambda code, table: F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in table.items()], F.coalesce(code, F.lit("")))
    round_ = lambda r: F.struct(F.coalesce(numbers.iso_date(F.trim(r["dxdyYmd"])), F.lit("")).alias("ymd"), named(r["auctnDxdyKndCd"], kinds).alias("kind"), named(r["auctnDxdyRsltCd"], results).alias("result"), numbers.lenient_number(r["tsLwsDspslPrc"]).alias("price"))
    schedule = F.reverse(F.array_sort(F.transform(F.coalesce("d.gdsDspslDxdyLst", F.array()), round_)))
    notes = F.filter(F.transform(F.coalesce("d.aeeWevlMnpntLst", F.array()), lambda a: F.struct(F.coalesce(*[F.when(a["aeeWevlMnpntItmCd"] == k, F.lit(v)) for k, v in labels.items()], F.lit("감정 요항")).alias("label"), F.coalesce(detail.clean(a["aeeWevlMnpntCtt"]), F.lit("")).alias("text"))), lambda n: ~n["text"].isin(NO_TEXT))
    photos = F.slice(F.filter(F.transform(F.coalesce("d.csPicLst", F.array()), lambda p: p["picFile"]), lambda p: p.isNotNull()), 1, KEPT_PHOTOS)
    gds = "d.dspslGdsDxdyInfo."
    plain = lambda c: F.coalesce(detail.clean(F.col(c)), F.lit(""))
    remark = F.array_join(F.filter(F.array(plain(gds + "gdsSpcfcRmk"), plain(gds + "dspslGdsRmk")), lambda x: x != ""), "\n")
    date = lambda c: F.coalesce(numbers.iso_date(F.trim(c)), F.lit(""))
    out = d.select(*keys, plain(gds + "ndstrcRghCtt").alias("surviving_rights"), plain(gds + "tprtyRnkHypthcStngDts").alias("senior_lien"), plain(gds + "sprfcExstcDts").alias("lien_note"), remark.alias("remark"), numbers.lenient_number(F.col("d.csBaseInfo.clmAmt")).alias("claim_amt"), date(F.get("d.dstrtDemnInfo", 0)["dstrtDemnLstprdYmd"]).alias("demand_end"), date(F.col(gds + "gdsSpcfcWrtYmd")).alias("spec_write_ymd"), F.trim(F.coalesce("d.csBaseInfo.cortAuctnJdbnNm", F.lit(""))).alias("court_dept"), schedule.alias("schedule"), notes.alias("appraisal_notes"), photos.alias("photos"))
    # the masks work on whole columns: notes are joined with a mark for it and taken apart again
    for c in ("surviving_rights", "senior_lien", "lien_note", "remark"):
        out = out.withColumn(c, text.masked_names(c))
    masked = F.split(text.masked_names(F.array_join(F.transform("appraisal_notes", lambda n: n["text"]), "\x1e")), "\x1e")
    return out.withColumn("_m", masked).withColumn("appraisal_notes", F.transform("appraisal_notes", lambda n, i: F.struct(n["label"].alias("label"), F.get("_m", i).alias("text")))).drop("_m")


def case_view(schedule: Column) -> Column:
    """``(appraisal_price, min_bid_price, fail_count)`` of a schedule: the first and the last price above 0, and the rounds without a buyer."""
    priced = F.array_sort(F.transform(F.filter(schedule, lambda r: r["price"] > 0), lambda r: F.struct(F.coalesce(r["ymd"], F.lit("")).alias("ymd"), r["price"].alias("price"))))
    return F.struct(F.get(priced, 0)["price"].alias("appraisal_price"), F.get(priced, F.size(priced) - 1)["price"].alias("min_bid_price"), F.size(F.filter(schedule, lambda r: r["result"] == "유찰")).alias("fail_count"))


def office_code(names: DataFrame, name: str, codes: DataFrame) -> DataFrame:
    """``names`` with the code of each court: by its whole name, or by the only one that it is part of (or the other way round).

    ``codes`` (court, code) is a dimension of some dozens of rows; white space is no difference.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    pairs = codes.select(F.col("court").alias("_court"), "code")
    target, known = bare(F.col(name)), bare(F.col("_court"))
    distinct = names.select(name).distinct()
    meets = (target != "") & (F.contains(known, target) | F.contains(target, known))
    met = distinct.join(pairs, meets).groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.max("code").alias("only"), F.max(F.when(F.col(name) == F.col("_court"), F.col("code"))).alias("exact"))
    return names.join(met.select(name, F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("code")), name, "left")


def codes_of_courts(raw: DataFrame, court: str = "court", code: str = "code") -> DataFrame:
    """``(court, code)`` of all courts; a court with two codes is an error that names it: somebody has to look."""
    known = raw.select(F.trim(court).alias("court"), F.trim(code).alias("code")).where("court <> '' and code <> ''")
    found = known.groupBy("court").agg(F.min("code").alias("code"), F.max("code").alias("_other"))
    return found.select("court", F.when(F.col("code") == F.col("_other"), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("two codes for "), F.col("court"))).cast("string")).alias("code"))


def full_court_name(name: Column, whole: dict[str, str], parents: dict[str, str]) -> Column:
    """A branch's full name, by ``whole`` or with its court before it; other names stay, and null is empty."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return F.coalesce(*[F.when(n == k, F.lit(v)) for k, v in whole.items()], *[F.when(n == k, F.lit(f"{v} {k}")) for k, v in parents.items()], n)
