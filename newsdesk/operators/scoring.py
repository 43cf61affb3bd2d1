"""Scores, categories and themes of content items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.functions.terms import Terms
from newsdesk.functions.text import contains_any

#: Source categories and words that add points (the points and reasons stand in score_content).
KEY_CATEGORIES = ("official_news", "official_research", "venture_media", "ai_media")
SIGNAL_WORDS = ("融资", "投资", "funding", "financing", "raised", "series")
#: Content types, parts of source categories and words of each report section.
FUNDING_TYPES = ("financing", "funding", "investment", "m_and_a", "acquisition")
FUNDING_SOURCES = ("financ", "fund", "investment", "acquisition", "m_and_a", "融资", "投资")
TECH_SOURCES = ("ai", "tech", "research", "github", "hacker", "model", "技术", "科技", "研究")
FUNDING_WORDS = (
    "融资", "获投", "获得投资", "完成投资", "战略投资", "融资轮", "种子轮", "天使轮", "pre-seed", "pre seed", "series a", "series b", "series c", "series d",
    "series e", "raised", "raises", "funding", "investment", "invests", "投资人", "领投", "跟投", "并购", "收购", "估值",
)
TECH_WORDS = (
    "人工智能", "大模型", "基础模型", "语言模型", "llm", "模型", "agent", "智能体", "ai infra", "ai基础设施", "算力", "gpu", "芯片", "半导体", "多模态",
    "机器人", "具身智能", "自动驾驶", "算法", "推理", "训练", "benchmark", "开源", "open source", "robotics", "semiconductor",
)
#: Themes and their words, in order.
TECH_THEMES = {
    "基础模型": ("大模型", "基础模型", "语言模型", "llm", "model"),
    "智能体": ("agent", "智能体"),
    "AI基础设施": ("ai infra", "ai基础设施", "算力", "inference", "推理", "训练"),
    "芯片与算力": ("芯片", "半导体", "gpu", "semiconductor"),
    "具身智能": ("具身智能", "机器人", "robotics", "自动驾驶"),
    "多模态": ("多模态", "multimodal"),
}
INDUSTRY_THEMES = {
    "政策与监管": ("政策", "监管", "regulation", "法案"),
    "企业服务": ("企业服务", "saas", "b2b", "enterprise"),
    "市场与公司动态": ("市场", "商业化", "营收", "公司", "企业"),
}


#: All words that texts of items are searched for, once.
ITEM_TERMS = Terms(SIGNAL_WORDS, FUNDING_WORDS, TECH_WORDS, *TECH_THEMES.values(), *INDUSTRY_THEMES.values())


def item_text(title: Column, summary: Column) -> Column:
    return F.lower(F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))))


def item_terms(title: Column, summary: Column) -> Column:
    """The terms of ITEM_TERMS in an item's text, as bits. Put them into a column of their own where several rules read them."""
    return ITEM_TERMS.found(item_text(title, summary))


def score_content(title: Column, summary: Column, category: Column, ai_related: Column, content_types: Column, relevance: Column, has_entities: Column) -> Column:
    """struct(score, confidence, reasons). content_types and relevance are arrays of lower-case tag values."""
    yes, no = ai_related.eqNullSafe(True), ai_related.eqNullSafe(False)
    rules = [
        (yes, 25, "内容被判断为与 AI 相关"),
        (no, -25, "内容被判断为与 AI 无关"),
        (F.array_contains(content_types, "financing"), 25, "包含融资内容类型标签"),
        (F.array_contains(relevance, "high"), 20, "AI 融资相关性为高"),
        (has_entities, 5, "已识别公司或机构实体"),
        (ITEM_TERMS.any_of(item_terms(title, summary), SIGNAL_WORDS), 10, "标题或摘要包含融资信号"),
        (category.isin(*KEY_CATEGORIES), 5, "来源属于重点情报来源"),
    ]
    held = [F.coalesce(test, F.lit(False)) for test, _, _ in rules]
    total = sum((F.when(h, points).otherwise(0) for h, (_, points, _) in zip(held, rules, strict=True)), F.lit(35))
    reasons = F.filter(F.array(*(F.when(h, F.lit(why)) for h, (_, _, why) in zip(held, rules, strict=True))), lambda x: x.isNotNull())
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("当前仅有基础规则评分"))).otherwise(reasons)
    confidence = F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.35), F.lit(0.45) + F.size(reasons) * F.lit(0.08))), 2)
    return F.struct(F.greatest(F.lit(0), F.least(F.lit(100), total)).alias("score"), confidence.alias("confidence"), reasons.alias("reasons"))


def effective_score(stored_score: Column, stored_confidence: Column, stored_reasons: Column, computed: Column) -> Column:
    """Stored values win: a score that is not null, a confidence that is neither null nor 0, reasons that are not empty."""
    confidence = F.when(F.coalesce(stored_confidence, F.lit(0.0)) != 0, stored_confidence).otherwise(computed["confidence"])
    reasons = F.when(F.coalesce(F.size(stored_reasons), F.lit(0)) > 0, stored_reasons).otherwise(computed["reasons"])
    return F.struct(F.coalesce(stored_score, computed["score"]).alias("score"), confidence.alias("confidence"), reasons.alias("reasons"))


def classify_content(content_types: Column, category: Column, found: Column) -> Column:
    """funding, technology or industry; found: the item_terms() of an item."""
    source = F.lower(F.coalesce(category, F.lit("")))
    return (
        F.when(F.coalesce(F.arrays_overlap(content_types, F.array(*map(F.lit, FUNDING_TYPES))), F.lit(False)), "funding")
        .when(contains_any(source, FUNDING_SOURCES) | ITEM_TERMS.any_of(found, FUNDING_WORDS), "funding")
        .when(contains_any(source, TECH_SOURCES) | ITEM_TERMS.any_of(found, TECH_WORDS), "technology")
        .otherwise("industry")
    )


def theme_for(category: Column, found: Column, sectors: Column | None = None) -> Column:
    """The first sector tag that names a theme, else the first theme one of whose words is found (item_terms())."""

    def by_words(themes: dict[str, tuple[str, ...]], rest: str) -> Column:
        out = F.lit(rest)
        for name, words in reversed(themes.items()):
            out = F.when(ITEM_TERMS.any_of(found, words), name).otherwise(out)
        return out

    words = F.when(category == "technology", by_words(TECH_THEMES, "其他技术")).otherwise(by_words(INDUSTRY_THEMES, "其他产业"))
    if sectors is None:
        return words

    def of(tag: Column) -> Column:
        t = F.lower(tag)
        return (
            F.when(t.isin("llm", "ai model"), "基础模型")
            .when(F.contains(t, F.lit("agent")), "智能体")
            .when(F.contains(t, F.lit("infra")), "AI基础设施")
            .when(t.isin("robotics", "embodied ai"), "具身智能")
            .when(F.contains(t, F.lit("semiconductor")), "芯片与算力")
        )

    return F.coalesce(F.try_element_at(F.filter(F.transform(sectors, of), lambda x: x.isNotNull()), F.lit(1)), words)


#: decision: review status and the score that it stands for
DECISIONS = {"relevant": ("reviewed", 80), "follow_up": ("follow_up", 70), "not_relevant": ("ignored", 20), "reset": ("unread", None)}


def apply_reviews(contents: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contents, audit). decisions: (content_id, seq, decision); contents needs score, confidence, reasons and
    review_status. Decisions of one content are folded in the order of seq; unknown ones are left out."""
    known = decisions.where(F.col("decision").isin(*DECISIONS))
    listed = known.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("seq", "decision"))).alias("_d"))
    start = F.struct(F.col("score").cast("int").alias("score"), F.col("confidence").cast("double").alias("confidence"), F.col("reasons").alias("reasons"), F.col("review_status").alias("status"), F.expr("cast(array() as array<struct<seq:bigint,decision:string,previous_status:string,previous_score:int>>)").alias("audit"))

    def step(state: Column, d: Column) -> Column:
        choice = d["decision"]
        status = F.when(choice == "relevant", "reviewed").when(choice == "follow_up", "follow_up").when(choice == "not_relevant", "ignored").otherwise("unread")
        score = F.when(choice == "relevant", F.greatest(state["score"], F.lit(80))).when(choice == "follow_up", F.greatest(state["score"], F.lit(70))).when(choice == "not_relevant", F.least(state["score"], F.lit(20))).otherwise(state["score"])
        scored = choice != "reset"
        return F.struct(
            score.cast("int").alias("score"),
            F.when(scored, F.greatest(F.coalesce(state["confidence"], F.lit(0.0)), F.lit(0.95))).otherwise(state["confidence"]).alias("confidence"),
            F.when(scored, F.concat(F.array(F.concat(F.lit("人工复核："), choice)), state["reasons"])).otherwise(state["reasons"]).alias("reasons"),
            status.alias("status"),
            F.concat(state["audit"], F.array(F.struct(d["seq"].cast("bigint").alias("seq"), choice.alias("decision"), state["status"].alias("previous_status"), state["score"].alias("previous_score")))).alias("audit"),
        )

    folded = contents.join(listed, "content_id", "left").withColumn("_s", F.when(F.col("_d").isNotNull(), F.aggregate("_d", start, step)).otherwise(start))
    new = folded.select(*(c for c in contents.columns if c not in ("score", "confidence", "reasons", "review_status")), F.col("_s.score").alias("score"), F.col("_s.confidence").alias("confidence"), F.col("_s.reasons").alias("reasons"), F.col("_s.status").alias("review_status"))
    audit = folded.select("content_id", F.explode("_s.audit").alias("a")).select("content_id", "a.*")
    return new, audit


def rescore(contents: DataFrame, computed: Column) -> DataFrame:
    """contents with computed scores (a score_content struct); rows that a person has reviewed keep theirs."""
    free = ~F.coalesce(F.col("review_status").isin("reviewed", "follow_up", "ignored"), F.lit(False))
    rows = contents.withColumn("_c", computed)
    for name in ("score", "confidence", "reasons"):
        rows = rows.withColumn(name, F.when(free, F.col(f"_c.{name}")).otherwise(F.col(name)))
    return rows.withColumn("review_status", F.when(free, "unread").otherwise(F.col("review_status"))).drop("_c")
