"""Companies, amounts, rounds and investors in news text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsdesk.functions.text import COMPANY_PREFIX, clean_text, contains_any, normalize_company_name, normalize_dedupe_text, title_tokens

#: Rounds, in order.
ROUNDS = ("Pre-A轮", "Pre-A", "种子轮", "天使轮", "A轮", "B轮", "C轮", "D轮", "E轮", "F轮", "战略融资", "股权融资", "pre-seed", "seed", "series a", "series b", "series c", "series d", "series e")
#: Capitalised words that name no company.
NOT_COMPANIES = ("AI", "VC", "PE", "LLM", "GPU", "AIGC", "OpenAI", "Anthropic", "Meta", "Google", "NVIDIA", "AMD", "Microsoft", "Amazon", "Inc", "CEO", "Labs", "AI Labs")
#: Forms of amounts.
NUMERIC_AMOUNT = r"(?iu)(?:近|超|约|逾|数)?\d+(?:\.\d+)?\s*(?:万|亿)?\s*(?:美元|美金|人民币|元|欧元|英镑|港元|dollars?|usd|rmb)(?:\+)?"
WORD_AMOUNT = r"(?iu)(?:近|超|约|逾)?(?:亿元|千万元|百万元|千万美元|百万美元|千万人民币|百万人民币)"
VAGUE_AMOUNT = r"(?iu)(?:数千万|数亿|千万级|亿元级|百万级|billion|million)"
#: Forms of company mentions.
QUOTED = r"[「“\"]([^」”\"]{2,60})[」”\"]"
NAME = r"([A-Za-z][A-Za-z0-9._ -]{1,60}|[\u4e00-\u9fffA-Za-z0-9._ -]{2,40})"
VERB = r"(?:获|获得|完成|宣布完成| raises | raised | lands | scores | secures | closes )"
CAPITALISED = r"\b[A-Z][A-Za-z0-9._]*(?:[ -][A-Z][A-Za-z0-9._]*){0,3}\b"
STARTED = r"([\u4e00-\u9fff]{2,4})(?:AI)?创业"
FOUNDED = r"([\u4e00-\u9fff]{2,4})等.{0,25}(?:创办|创立|创办了|创立了|联合创办|联合创立)"
#: Forms of investor mentions.
INVESTORS = (r"(?:本轮由|由)([^。；;，,]{2,80}?)(?:领投|联合领投|投资|参投)", r"(?:投资方包括|投资方为|投资机构包括)([^。；;]{2,100})", r"(?:领投方为|领投方是)([^。；;，,]{2,80})")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _between(names: Column, least: int, most: int) -> Column:
    return F.filter(names, lambda x: F.length(x).between(least, most))


def company_candidates(text: Column) -> Column:
    """Sorted distinct comparison forms of the companies that a text may name."""
    normal = lambda items: F.transform(items, normalize_company_name)
    capital = F.filter(F.transform(_all(text, CAPITALISED, 0), lambda x: F.trim(x)), lambda x: ~x.isin(*NOT_COMPANIES))
    found = F.concat(
        _between(normal(_all(text, QUOTED)), 2, 60),
        _between(normal(_all(text, f"(?i){NAME}{VERB}.{{0,30}}?(?:融资|funding|round|investment)")), 2, 60),
        _between(normal(capital), 3, 50),
        F.filter(_between(normal(_all(text, STARTED)), 2, 12), lambda x: ~x.isin("官宣", "融资", "完成", "获得")),
        _between(normal(_all(text, FOUNDED)), 2, 12),
    )
    return F.array_sort(F.array_distinct(found))


def company_display_lists(text: Column) -> Column:
    """Names as written, in order of mention: the quoted ones and those before a financing verb."""
    quoted = F.transform(_all(text, QUOTED), lambda x: clean_text(x, False))
    acting = F.transform(_all(text, f"(?i){NAME}{VERB}"), lambda x: F.trim(F.regexp_replace(clean_text(x, False), f"^(?:{COMPANY_PREFIX})", "")))
    return F.array(*(F.filter(names, lambda x: x != "") for names in (quoted, _between(acting, 2, 60))))


def company_display_candidates(text: Column) -> Column:
    """Names as written, in order of mention: quoted ones, then those before a financing verb."""
    return F.array_distinct(F.flatten(company_display_lists(text)))


def amount_lists(text: Column) -> Column:
    """Amounts as written: the numeric ones, words and vague ones."""
    return F.array(*(F.filter(F.transform(_all(text, p, 0), lambda x: clean_text(x, False)), lambda x: x != "") for p in (NUMERIC_AMOUNT, WORD_AMOUNT, VAGUE_AMOUNT)))


def amount_texts(text: Column) -> Column:
    """Amounts as written: numeric ones, then words, then vague ones."""
    return F.array_distinct(F.flatten(amount_lists(text)))


def amounts(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(amount_texts(text), normalize_dedupe_text)))


def round_texts(text: Column) -> Column:
    """The listed rounds that the text holds, in list order; a longer name does not hide a shorter one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*(F.when(F.contains(low, F.lit(r.lower())), F.lit(r)) for r in ROUNDS)), lambda r: r.isNotNull())


def rounds(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(round_texts(text), normalize_dedupe_text)))


def investor_lists(text: Column) -> Column:
    """Investors by the form of their mention."""

    def named(found: Column) -> Column:
        parts = F.flatten(F.transform(found, lambda x: F.split(clean_text(x, False), "[、,，和及与]")))
        return _between(F.transform(parts, lambda x: F.trim(F.regexp_replace(clean_text(x, False), "^(?:本轮|由|同时|并由)", ""))), 2, 40)

    return F.array(*(named(_all(text, p)) for p in INVESTORS))


def investor_texts(text: Column) -> Column:
    return F.array_distinct(F.flatten(investor_lists(text)))


#: Ends of texts in which a mention could go on in a text behind it, in the order of the forms that cross lines:
#: a quotation, an amount without its unit, and those of INVESTORS.
OPEN_ENDS = (r"[「“\"][^」”\"]{0,60}\z", r"\d\s*(?:万|亿)?\s*\z", r"由(?![^。；;，,]{2,80}?(?:领投|联合领投|投资|参投))[^。；;，,]{0,80}\z", r"(?:投资方包括|投资方为|投资机构包括)[^。；;]{0,100}\z", r"(?:领投方为|领投方是)[^。；;，,]{0,80}\z")


def open_at_end(text: Column) -> Column:
    """True if a company, amount or investor could reach from the text into one that follows on a new line. Texts that are
    not open name together what each one names."""
    found = F.lit(False)
    for p in OPEN_ENDS:
        found = found | text.rlike(p)
    return found


def parse_amount(c: Column) -> Column:
    """struct(amount, currency): the first number times the unit behind it; the currency by the first kind named."""
    low = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(","), F.lit(""))
    form = r"(?U)(\d+(?:\.\d+)?)\s*(万|亿|million|billion)?"
    number, unit = F.regexp_extract(low, form, 1), F.regexp_extract(low, form, 2)
    times = F.when(unit == "万", 1e4).when(unit == "亿", 1e8).when(unit == "million", 1e6).when(unit == "billion", 1e9).otherwise(1.0)
    currency = (
        F.when(contains_any(low, ("美元", "美金", "usd", "dollar")), "USD")
        .when(contains_any(low, ("港元", "hkd")), "HKD")
        .when(contains_any(low, ("欧元", "eur")), "EUR")
        .when(contains_any(low, ("元", "人民币", "rmb", "万", "亿")), "CNY")
    )
    known = number != ""
    return F.struct(F.when(known, number.cast("double") * times).alias("amount"), F.when(known, currency).alias("currency"))


def financing_signature(title: Column, summary: Column, shown: Column, entities: Column | None = None) -> Column:
    """struct(date, companies, amounts, rounds, title_norm, tokens) of an item; entities: array of company names."""
    text = F.concat(title, F.lit(" "), F.coalesce(summary, F.lit("")))
    companies = company_candidates(text)
    if entities is not None:
        named = F.filter(F.transform(F.coalesce(entities, F.array().cast("array<string>")), normalize_company_name), lambda x: x != "")
        companies = F.array_sort(F.array_union(companies, named))
    return F.struct(F.to_date(shown).alias("date"), companies.alias("companies"), amounts(text).alias("amounts"), rounds(text).alias("rounds"), normalize_dedupe_text(title).alias("title_norm"), title_tokens(text).alias("tokens"))
