"""Facts of a sale's detail: who moved in when, what came back for sale, and what a buyer would owe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hammerlake.functions import rights
from hammerlake.functions.money import let

# How dates are written, liens that rank first, and the reasons for a sale to come back.
DATE = r"(\d{4})\s*[.\-년]\s*(\d{1,2})\s*[.\-월]\s*(\d{1,2})"
MOVED_IN = r"전입\s*(?:신고)?\s*(?:세대|일)?\s*자?\s*[:\-]?\s*(\d{4}\s*[.\-년]\s*\d{1,2}\s*[.\-월]\s*\d{1,2})"
SENIOR = ["근저당권", "근저당", "저당권", "전세권", "담보가등기", "가압류", "압류", "경매개시결정", "경매개시", "임차권등기"]
NOTHING = ["해당사항없음", "해당없음", "없음"]
SOLD = "매각"
REASONS = {"미납": "대금 미납", "최고가매각불허가결정": "매각 불허가", "차순위매각불허가결정": "매각 불허가", "최고가매각허가취소결정": "매각허가 취소", "차순위매각허가취소결정": "매각허가 취소"}
NO_REASON = "사유 미상"
OWNER_LIVES = r"(?:소유자|채무자)(?:\s*겸\s*(?:소유자|채무자))?[가이은는을]?[^가-힣\n]{0,4}(?:점유|거주|자가)"
RELATION_UNKNOWN = r"관계를 알 수 없|관계 ?미상"
SHARE_SALE = r"지분\s*(?:매각|경매)"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def clean(text: Column) -> Column:
    """Text without entities (up to three layers), control characters and surplus white space; null stays null."""
    for _ in range(3):
        for entity, c in ENTITIES.items():
            text = F.replace(text, F.lit(entity), F.lit(c))
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f​-‏‪-‮⁠﻿]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[ 　]", " "), r"[ \t]{2,}", " ")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def substantive(text: Column) -> Column:
    """Whether a field says anything: white space and a bare 'none' don't."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ ]", "")
    return (F.trim(bare) != "") & ~F.rtrim(F.trim(bare), F.lit(".·,")).isin(NOTHING)


def first_date(text: Column) -> Column:
    """The first date in a text as ``YYYY-MM-DD``, which sorts like the date; null if there is none."""
    part = lambda k, n: F.lpad(F.regexp_extract(text, DATE, k), n, "0")
    return F.when(text.rlike(DATE), F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)))


def _dates(texts: Column) -> Column:
    return F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), first_date), lambda d: d.isNotNull())


def tenant_moveins(tenants: Column) -> Column:
    """Move-in dates of those who are tenants for sure."""
    return F.transform(F.filter(tenants, lambda t: t["is_tenant_like"] & (F.coalesce(t["movein_ymd"], F.lit("")) != "")), lambda t: t["movein_ymd"])


def owner_lives(possession: Column) -> Column:
    """Whether a court states that the owner or debtor lives there; an unknown relation is no such statement."""
    p = F.coalesce(possession, F.lit(""))
    return p.rlike(OWNER_LIVES) & ~p.rlike(RELATION_UNKNOWN)


def unclear_moveins(tenants: Column) -> Column:
    """Move-in dates of households that may be tenants: nothing says so, and nothing says that they own."""
    return F.transform(F.filter(tenants, lambda t: ~t["is_tenant_like"] & (F.coalesce(t["movein_ymd"], F.lit("")) != "") & ~owner_lives(t["possession"])), lambda t: t["movein_ymd"])


def opposable_deposits(tenants: Column, senior: Column) -> Column:
    """Deposits of the tenants who moved in on the day of the senior lien or before; 0 without a date of the lien."""
    day = first_date(senior)
    early = F.filter(tenants, lambda t: t["is_tenant_like"] & (first_date(t["movein_ymd"]) <= day))
    return F.coalesce(F.aggregate(early, F.lit(0).cast("bigint"), lambda s, t: s + F.coalesce(t["deposit"], F.lit(0))), F.lit(0).cast("bigint"))


def priority(senior: Column, surviving: Column, remark: Column, moveins: Column, unclear: Column) -> Column:
    """``(senior_type, senior_date, movein_date, source, verdict)``: whether a tenant ranks before the senior lien, and why.

    The earliest move-in of a tenant decides, from the survey or else from the text. A household of unknown relation that
    moved in by then makes it possible, where nothing stronger is said.
    """
    day = first_date(senior)
    kind = F.when(day.isNotNull(), F.coalesce(*[F.when(F.contains(senior, F.lit(k)), F.lit(k)) for k in SENIOR], F.lit("")))
    surveyed = F.array_min(_dates(moveins))
    said = F.array_min(_dates(F.regexp_extract_all(F.concat_ws("\n", surviving, remark), F.lit(MOVED_IN), F.lit(1))))
    movein, text = F.coalesce(surveyed, said), substantive(surviving)
    both = movein.isNotNull() & day.isNotNull()
    sure = F.when(both & (movein <= day), "confirmed_opposable").when(both & text, "contradiction").when(both, "not_opposable").when(day.isNotNull() & text, "dates_incomplete").otherwise("no_basis")
    early = F.array_min(F.filter(_dates(unclear), lambda d: d <= day))
    possible = sure.isin("no_basis", "not_opposable") & early.isNotNull()
    source = F.when(possible | surveyed.isNotNull(), "현황조사서").when(said.isNotNull(), "명세서").otherwise("")
    return F.struct(F.coalesce(kind, F.lit("")).alias("senior_type"), F.coalesce(day, F.lit("")).alias("senior_date"), F.coalesce(F.when(possible, early).otherwise(movein), F.lit("")).alias("movein_date"), source.alias("source"), F.when(possible, "possible_opposable").otherwise(sure).alias("verdict"))


def resale(schedule: Column) -> Column:
    """``(sold_count, last_sold_ymd, floor, sold_price, reason)`` of a sale that came back: sold, with a later date; else null.

    ``schedule`` has structs of ymd, result, price and sold, in any order. The last known reason after the last sale counts.
    """
    rows = F.array_sort(F.transform(F.filter(schedule, lambda r: r.isNotNull()), lambda r, i: F.struct(F.coalesce(r["ymd"], F.lit("")).alias("ymd"), i.alias("i"), r["result"].alias("result"), r["price"].alias("price"), r["sold"].alias("sold"))))

    def read(x: Column) -> Column:
        before = F.slice(x["rows"], 1, F.greatest(F.lit(0), F.size(x["rows"]) - 1))
        sold = F.filter(F.transform(before, lambda r, k: F.when(r["result"] == SOLD, k)), lambda k: k.isNotNull())
        return let({"rows": x["rows"], "sold": sold}, lambda y: F.when(F.size(y["sold"]) > 0, let({"rows": y["rows"], "n": F.size(y["sold"]), "k": F.element_at(y["sold"], -1)}, told)))

    def told(x: Column) -> Column:
        later = F.slice(x["rows"], x["k"] + 2, F.size(x["rows"]))
        known = F.filter(F.transform(later, lambda r: F.coalesce(*[F.when(r["result"] == k, F.lit(v)) for k, v in REASONS.items()])), lambda v: v.isNotNull())
        return let({"last": F.get(x["rows"], x["k"]), "reason": F.get(F.reverse(known), F.lit(0))}, lambda y: of_last(x, y))

    def of_last(x: Column, y: Column) -> Column:
        above = lambda c: F.when(y["last"][c] > 0, y["last"][c])
        return F.struct(x["n"].alias("sold_count"), y["last"]["ymd"].alias("last_sold_ymd"), above("price").alias("floor"), above("sold").alias("sold_price"), F.coalesce(y["reason"], F.lit(NO_REASON)).alias("reason"))

    return let({"rows": rows}, read)


def badge(surviving: Column, liens: Column, remark: Column, senior: Column) -> Column:
    """``(status, opposable, assumed, special, amount_unknown)``: 'burden' if any of five signs is there, else 'clean'.

    A burden without an amount takes the deposits that the texts name; what is released is no sign.
    """
    lease = F.contains(F.coalesce(senior, F.lit("")), F.lit("전세권"))
    said, taken = rights.opposable(surviving, remark), rights.assumed_amount(surviving, remark)
    add = lambda cond, label: F.when(cond, F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
    special = F.array_union(F.array_union(rights.special_rights(surviving, liens, remark), add(lease, "선순위전세권")), add(F.concat_ws("\n", remark, surviving, liens).rlike(SHARE_SALE), "지분매각"))
    left = lambda t: substantive(rights._unreleased(F.coalesce(t, F.lit(""))))
    burden = said | (taken > 0) | (F.size(special) > 0) | left(surviving) | left(liens) | lease
    assumed = F.when(burden & (taken <= 0), rights.deposits(surviving, remark)).otherwise(taken)
    return F.struct(F.when(burden, "burden").otherwise("clean").alias("status"), said.alias("opposable"), assumed.alias("assumed"), special.alias("special"), (burden & (assumed <= 0)).alias("amount_unknown"))


def assessable(surviving: Column, liens: Column, remark: Column) -> Column:
    """Whether there is any text to judge tenants by; without, 'no tenant' isn't known."""
    return F.trim(F.concat_ws("", surviving, liens, remark)) != ""
