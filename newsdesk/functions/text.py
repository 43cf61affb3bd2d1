"""Text functions. Patterns use (?U) and (?iu) so that classes and case follow Unicode."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that sentences and clauses end with, and punctuation that comparison forms leave out.
SENTENCE_END = "。！？!?；;"
CLAUSE_END = "，,、"
DROPPED = r"""(?U)[\s_·•・\-—–|｜:：,，.。;；!！?？'"“”‘’「」《》【】（）()\[\]{}]+"""
SUMMARY_LIMIT, SUMMARY_MIN = 180, 80
#: Words before and after a company's name.
COMPANY_PREFIX = "首发|融资|公司|企业|项目|团队|具身智能|基础设施|供应商|开发商|初创公司|创业公司|平台|专注于|报道称"
COMPANY_SUFFIX = "公司|企业|项目|团队|平台|科技|智能|医疗|机器人"


def _unescape(c: Column) -> Column:
    """HTML entities decoded, by a pandas UDF: there are too many names for an expression."""

    # made on use: this module is also imported on executors, where no session is
    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)

    return decode(c)


def collapse(c: Column) -> Column:
    """White-space runs become one space; both ends are stripped; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean_text(c: Column, entities: bool = True) -> Column:
    """collapse() after decoding HTML entities; entities=False skips the decoding for text that has none."""
    return collapse(_unescape(c) if entities else c)


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def first_chars(c: Column, n: int = 100, entities: bool = False) -> Column:
    text = clean_text(c, entities)
    return F.when(F.length(text) > n, F.concat(rstrip(F.substring(text, 1, n)), F.lit("..."))).otherwise(text)


def fingerprint(c: Column, entities: bool = False) -> Column:
    """SHA-256 of the cleaned lower-case text."""
    return F.sha2(F.lower(clean_text(c, entities)), 256)


def summary_chars(c: Column, limit: int = SUMMARY_LIMIT, least: int = SUMMARY_MIN, entities: bool = False) -> Column:
    """At most `limit` characters, cut after the last sentence or before the last clause at `least` or later."""
    text = clean_text(c, entities)
    window = F.substring(text, 1, limit)
    sentence = F.regexp_extract(window, f"(?s)^(.{{{least},}}[{SENTENCE_END}])", 1)
    clause = F.regexp_extract(window, f"(?s)^(.{{{least},}})[{CLAUSE_END}]", 1)
    return (
        F.when(F.length(text) <= limit, text)
        .when(sentence != "", F.trim(sentence))
        .when(clause != "", F.concat(F.trim(clause), F.lit("...")))
        .otherwise(F.concat(rstrip(window), F.lit("...")))
    )


def normalize_dedupe_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), DROPPED, "")


def normalize_company_name(c: Column) -> Column:
    """One leading and one trailing generic word go, then the comparison form."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), f"^(?:{COMPANY_PREFIX})", "")
    return normalize_dedupe_text(F.trim(F.regexp_replace(bare, f"(?:{COMPANY_SUFFIX})$", "")))


def title_tokens(c: Column) -> Column:
    """Sorted distinct runs of three or more letters or digits, and all pairs of neighbouring characters."""
    text = normalize_dedupe_text(c)
    runs = F.regexp_extract_all(text, F.lit("[a-z0-9]{3,}"), F.lit(0))
    # a look-ahead takes overlapping pairs in one pass, so the text is not made anew for each of them
    pairs = F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(runs, pairs)))


def estimate_tokens(*parts: Column) -> Column:
    total = sum((F.coalesce(F.length(p), F.lit(0)) for p in parts), F.lit(0))
    return F.greatest(F.lit(1), F.floor((total + 3) / 4)).cast("int")


#: Names of sites that titles end with, after any of the marks.
SITES = {
    r"[-|—_]": ("36氪", "钛媒体官方网站", "The Verge", "VentureBeat", "Google DeepMind"),
    r"\|": ("Anthropic", "OpenAI", "TechCrunch", "Andreessen Horowitz"),
}
SITES_ANY_CASE = ("THE DECODER", "Crunchbase News")


def clean_title(c: Column) -> Column:
    """The cleaned title without the names of sites at its end."""
    out = clean_text(c, False)
    for mark, names in SITES.items():
        out = F.regexp_replace(out, rf"(?U)\s*{mark}\s*(?:{'|'.join(names)})\s*$", "")
    out = F.regexp_replace(out, r"(?U)\s*医药新闻\s*[-|—_]\s*ByDrug.*$", "")
    return F.regexp_replace(out, rf"(?iU)\s*[-|—_]\s*(?:{'|'.join(SITES_ANY_CASE)})\s*$", "")


def detect_language(title: Column, body: Column) -> Column:
    return F.when(F.concat_ws("", title, body).rlike("[\u4e00-\u9fff]"), "zh").otherwise("en")


def contains_any(c: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """True if the lower-case text holds any of the terms."""
    text = F.lower(F.coalesce(c, F.lit("")))
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t.lower()))
    return found


def json_list(c: Column) -> Column:
    """JSON text as an array of strings; anything but a list is an empty array."""
    return F.coalesce(F.from_json(F.when(F.ltrim(c).startswith("["), c), "array<string>"), F.array().cast("array<string>"))


#: Names whose values are secret, and forms of bare secrets.
SECRET_PAIR = r"(?is)(api[_ -]?key|authorization|password|secret|access[_ -]?token)\s*[:=]\s*[^\s,;]+"
BEARER = r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+"
BARE_SECRET = r"(?i)\b(?:sk|key|token)-[A-Za-z0-9_-]{8,}\b"


def redact(c: Column, limit: int = 1000) -> Column:
    """Values of secrets, bearer tokens and bare keys are replaced, NUL becomes a space, at most `limit` characters."""
    out = F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit(" ")))
    out = F.regexp_replace(out, SECRET_PAIR, "$1=<redacted>")
    out = F.regexp_replace(out, BEARER, "Bearer <redacted>")
    return F.substring(F.regexp_replace(out, BARE_SECRET, "<redacted>"), 1, limit)


def mask(c: Column, shown: int = 4) -> Column:
    """The last characters of a secret behind eight stars; a short one is all stars."""
    return F.when(F.length(c) <= shown, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.lit("*" * 8), F.substring(c, -shown, shown)))


#: Categories and months on news cards, and the words that an introduction starts with.
CARD_CATEGORIES = "Company|Research|Product|Safety|Engineering|Security|Global Affairs|AI Adoption|Announcements|Alignment|Interpretability|Policy|Science|Economic Research|Societal Impacts"
CARD_MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
CARD_INTRO = "Today|We|Our|New|A new|Introducing our|Learn|Read"


def clean_card_title(c: Column) -> Column:
    """The title on a card without its category and date, which stand behind it, before it, or date first."""
    text = clean_title(c)
    date = rf"(?:{CARD_MONTHS})\s+\d{{1,2}},\s+20\d{{2}}"
    behind = F.regexp_extract(text, rf"(?i)^(.+?)\s+(?:{CARD_CATEGORIES})\s+{date}\b", 1)
    before = F.regexp_extract(text, rf"(?i)^(?:{CARD_CATEGORIES})\s+{date}\s+(.+)$", 1)
    date_first = F.regexp_extract(text, rf"(?i)^{date}\s+(?:{CARD_CATEGORIES})\s+(.+)$", 1)
    return (
        F.when(behind != "", F.trim(behind))
        .when(before != "", F.trim(F.element_at(F.split(F.trim(before), rf"\s+(?:{CARD_INTRO})\b", 2), 1)))
        .when(date_first != "", F.trim(date_first))
        .otherwise(F.when(F.length(text) <= 140, text).otherwise(first_chars(text, 120)))
    )
