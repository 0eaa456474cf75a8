"""Column builders that read facts out of text."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that deny a clause, and provinces with the beginnings of their addresses.
NEGATIONS = ["없음", "없다", "해당없음", "아님", "소멸", "no ", "not ", "none"]
PROVINCES = ["서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주"]
# Spellings of brands in the order in which they are replaced, roles beside which names stand, what isn't a name, endings
# of companies, and particles, the longest first.
BRANDS = [("lh", "엘에이치"), ("gs", "지에스"), ("sk", "에스케이"), ("kcc", "케이씨씨"), ("e편한세상", "이편한세상"), ("xi", "자이")]
ROLES = ["주택임차권자", "유치권신고인", "유치권자", "임차권자", "근저당권설정자", "근저당권자", "가압류권자", "전세권자", "지상권자", "전세권설정자", "채권자", "채무자", "소유자", "공유자", "임차인", "임대인", "점유자", "신청인", "배우자", "상속인", "연고자"]
ROLE_ENDINGS, PERSONS = ["권자", "신고인", "설정자", "의무자"], ["세입자", "거주자", "동거인", "대표자", "관리인"]
NO_NAMES = {"공유자", "채무자", "소유자", "소유권", "임차인", "점유자", "신청인", "배우자", "상속인", "전원", "갑구", "을구", "지분", "대지권", "전부", "일부", "비율", "토지", "건물", "청구", "매각", "소유", "부분", "구분", "등기", "명의", "증여", "매매", "공유", "성명", "상속", "임대인", "임차권자", "연고자", "유치권자", "제출", "제출한", "확약서", "보정서", "동의서", "포기서", "신고서", "서면", "대리인", "주식", "있으며", "있음", "없으며", "없음", "미상", "불명", "다수", "수인", "본인", "모두", "각각", "해당", "동일", "상기", "전술", "아래", "기타", "및", "또는", "외의", "위의", "법인"}
COMPANIES = ("은행", "카드", "캐피탈", "보험", "증권", "생명", "화재", "신탁", "저축", "대부", "공사", "공단", "금고", "신협", "농협", "수협", "축협", "조합", "재단", "협회", "공제", "센터", "관리단", "자산관리", "파이낸셜", "회사", "법인", "중앙회", "전력")
PARTICLES = ["으로부터", "로부터", "으로", "에게", "에서", "부터", "로", "은", "는", "이", "가", "의", "에", "와", "과", "도", "만", "께", "님", "을", "를"]
MASK = "[성명]"
#: Roles as one pattern, longer ones first, as some begin others.
_ROLE = "|".join(sorted(ROLES, key=len, reverse=True))
WEEKDAYS = ["월", "화", "수", "목", "금", "토", "일"]


def squeezed(text: Column) -> Column:
    """Lower case without white space, for searches that ignore both."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def contains_squeezed(text: Column, wanted: str) -> Column:
    return F.contains(squeezed(text), F.lit("".join(wanted.split()).lower()))


def clauses(text: Column) -> Column:
    """A text's clauses; without text none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[.;\n]+"), lambda c: F.trim(c) != "")


def says(text: Column, pattern: str, denied: list[str] = NEGATIONS) -> Column:
    """True if a clause matches ``pattern`` and doesn't deny it."""
    return F.exists(clauses(text), lambda c: F.lower(c).rlike(pattern) & ~F.lower(c).rlike("|".join(denied)))


def labels(text: Column, patterns: dict[str, str]) -> Column:
    """The labels whose pattern a text asserts, in the order of ``patterns``."""
    return F.array_compact(F.array(*[F.when(says(text, p), F.lit(k)) for k, p in patterns.items()]))


def amounts(text: Column) -> Column:
    """The distinct amounts of money in a text (``1,234`` or more digits), in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d{1,3}(?:,\d{3})+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, ",", "").cast("bigint")))


def province(address: Column) -> Column:
    """The province that an address begins with; null tells an unknown one."""
    out = F.lit(None).cast("string")
    for p in reversed(PROVINCES):
        out = F.when(address.startswith(p), F.lit(p)).otherwise(out)
    return out


def korean_number(text: Column) -> Column:
    """``2억 8,000`` and ``3억5천만`` as won: hundred millions, then thousands or ten-thousands; null if neither is there."""
    digits = lambda p: F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("bigint")
    eok, man, cheon = digits(r"([\d,]+)\s*억"), digits(r"억\s*([\d,]+)\s*(?:만|$|\D)"), digits(r"([\d,]+)\s*천만")
    bare = F.when(~text.contains("억"), digits(r"([\d,]+)\s*만"))
    total = F.coalesce(eok * 100_000_000, F.lit(0)) + F.coalesce(cheon * 10_000_000, man * 10_000, bare * 10_000, F.lit(0))
    return F.when(F.coalesce(eok, man, cheon, bare).isNotNull(), total)


def _is_name(word: str) -> tuple[str, str] | None:
    """A word as a person's name and the particle behind it, or None if it is none."""
    stem = next((word[: -len(j)] for j in PARTICLES if word.endswith(j) and len(word) - len(j) >= 2), word)
    lawful = stem in NO_NAMES or word in NO_NAMES or stem in ROLES or word in ROLES
    if not 2 <= len(stem) <= 4 or lawful or stem.endswith(COMPANIES) or word.endswith(COMPANIES):
        return None
    return stem, word[len(stem) :]


# a role, perhaps with a particle or a second role behind it, then a list of words; a name before what it owns
_BEHIND = re.compile(rf"((?:{_ROLE})[은는이가]?[\s:：]+(?:(?:{_ROLE})[\s:：]+)?)([가-힣]+(?:\s*[,，·]\s*[가-힣]+)*)(?!\s*\(주)")
_BEFORE = re.compile(rf"(?<![가-힣])([가-힣]{{2,6}})(?=\s*(?:\((?:{_ROLE})|지분|소유(?![자권])))")


def _masked(text: str) -> str:
    def one(word: str) -> str:
        found = _is_name(word)
        return MASK + found[1] if found else word

    behind = _BEHIND.sub(lambda m: m[1] + re.sub(r"[가-힣]+", lambda x: one(x[0]), m[2]), text)
    return _BEFORE.sub(lambda m: one(m[1]), behind)


@F.pandas_udf(StringType())
def masked_names(texts: pd.Series) -> pd.Series:
    """Texts with persons' names beside a role, or before a share, masked whole: in lists each of them, with the particle behind
    kept. Companies and words of the law stay. Null stays null. (A pandas function, as each match needs a decision.)"""
    return texts.map(_masked, na_action="ignore")


def names_left(masked: Column) -> Column:
    """Whether a masked text still has what looks like a name behind a word for a person that is no role of ``ROLES``: a canary.

    Courts coin such words; they have one of few endings, so that a new one is told by it and not by a list.
    """
    coined = rf"(?<![가-힣])(?!(?:{_ROLE})[\s:：])[가-힣]{{1,6}}(?:{'|'.join(ROLE_ENDINGS)})[\s:：]+"
    person = rf"(?:{'|'.join(PERSONS)})\s*"
    nobody = rf"(?![가-힣]*(?:{'|'.join(COMPANIES)}))(?!(?:{'|'.join(sorted(NO_NAMES))})(?![가-힣]))"
    return masked.rlike(rf"(?:{coined}|{person}){nobody}[가-힣]{{2,4}}(?=[^가-힣]|(?:{'|'.join(PARTICLES)})|$)")


def remasked(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(keys, columns)`` with names masked, of the rows in which that changes something: all that a store has to write again."""
    new = rows.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], *[masked_names(F.col(c)).alias(c) for c in columns])
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return new.where(changed).select(*keys, *columns)


def floor_of(address: Column) -> Column:
    """The floor in an address: 0 for a basement, else the lowest one named, null if none is."""
    found = F.transform(F.regexp_extract_all(address, F.lit(r"(\d+)\s*층"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.when(address.rlike(r"지하|지층|B\d"), F.lit(0)).otherwise(F.array_min(found))


def name_key(name: Column) -> Column:
    """A building's name for comparison: no spaces, brackets or case, brands spelled in one way, without the ending for apartments."""
    key = squeezed(name)
    for latin, spelled in BRANDS:
        key = F.replace(key, F.lit(latin), F.lit(spelled))
    return F.regexp_replace(F.regexp_replace(key, r"\(.*?\)|[·\-]", ""), "아파트$", "")


def block_numbers(name: Column) -> Column:
    """The numbers of blocks and phases in a name, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"(\d+)\s*(?:단지|차)"), F.lit(1))))


def in_region(address: Column, region: str) -> Column:
    """Whether an address begins with a region or names it."""
    return F.contains(F.coalesce(address, F.lit("")), F.lit(region))


def weekday(date: Column) -> Column:
    """The day of the week of ``YYYY-MM-DD``; empty for anything else."""
    valid = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), date.try_cast("date"))
    return F.coalesce(F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(valid)), F.lit(""))
