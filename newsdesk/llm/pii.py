"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Base patterns find emails, IP addresses, payment cards and phone numbers; they are the seeds. Every identifier-like
mention that touches no base span - a word that holds a digit or an @, or a stretch of up to STRETCH such words that
has the form of a kind - is an instance as well. The one or two words before an instance are its patterns. On the graph of
distinct (pattern, instance) pairs a pattern's confidence for a kind is the mean score of its instances, an
instance's score is 1 - product(1 - confidence) over its patterns, and seeds keep score 1; a few rounds of two
aggregations make them agree. Patterns need MIN_SUPPORT different seeds. Mentions that score THRESHOLD or more for a
kind and have its form are added as spans of that kind, the leftmost and longest where they overlap.

Only numbers leave the scan of the texts for the graph: patterns and instances are 64-bit hashes there.

The base patterns are written for linear time: a match starts where a run starts or where the last match ended
(\\G), and inner repeats are possessive, which gives the same matches.

Cases: null and empty texts have no spans; repeated rows are each found; rows are told apart by doc_id and text, so a
doc_id that is null or stands for several texts mixes nothing up; counts are of base spans; spans of one kind do not
overlap; of equally good kinds of a discovered value the one listed last wins; an empty table gives no rows;
other columns are kept by redact(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.linking import BROADCAST_IDS
from newsdesk.llm.tables import spare, stored

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single spaces or dashes; other lengths can't be cards
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold before a pattern is tried on it.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_TOKEN = r"""[^\s"'<>0-9@]*+[0-9@][^\s"'<>]*+"""
MENTION = rf"""(?<![^\s"'<>]){_TOKEN}"""
#: Forms that a discovered identifier of a kind may have.
FORMS = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^(?:[0-9]+(?:\.[0-9]+){3}|[0-9A-Fa-f]*(?::[0-9A-Fa-f]*){2,7})$",
    "card": r"^[0-9](?:[ -]?[0-9]){11,18}$",
    "phone": r"^[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}$",
}
#: Words of an identifier that is written in groups, at most: a card of 19 digits has 5 groups, a phone number 6.
STRETCH = 6
MIN_SUPPORT, ROUNDS, THRESHOLD, MIN_CONFIDENCE = 3, 3, 0.8, 0.5
SPAN = "array<struct<start:int,end:int,value:string>>"


#: Matches whose lengths are summed up together, so that places cost little in texts with very many matches.
SUMMED = 256


def _parts(text: Column, pattern: str, hint: str) -> Column:
    """The matches and what stands between them, in one column, so that a pattern runs once for each."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.when(text.rlike(hint), both)


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda n, x: n + x)


def _sizes(parts: Column) -> Column:
    """Code points of each match with the text before it."""
    return F.transform(parts["m"], lambda x, i: F.length(x) + F.length(parts["p"][i]))


def _sums(sizes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / SUMMED).cast("int")), lambda k: _total(F.slice(sizes, k * SUMMED + 1, F.lit(SUMMED))))


def _located(parts: Column, sizes: Column, sums: Column) -> Column:
    """Spans (start, end, value) in code points, end exclusive; an empty array without matches."""

    def span(x: Column, i: Column) -> Column:
        k = F.floor(i / SUMMED).cast("int")
        start = _total(F.slice(sums, F.lit(1), k)) + _total(F.slice(sizes, k * SUMMED + 1, i % SUMMED)) + F.length(parts["p"][i])
        return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("value"))

    return F.coalesce(F.transform(parts["m"], span), F.expr(f"cast(array() as {SPAN})"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _of_kind(spans: Column | str, kind: str) -> Column:
    """(start, end, kind) of the spans of one kind."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _bare(spans: Column | str, kind: str | None = None) -> Column:
    """(start, end) of the spans, of those of one kind if it is given."""
    if kind is not None:
        spans = F.filter(spans, lambda x: x["kind"] == kind)
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda x: _luhn(x["value"]),
    "phone": lambda x: F.length(_digits(x["value"])).between(9, 15),
}


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(doc_id, text)


def _numbered(spans: str, n: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.lit(n).alias("kind")))


def _words_before(between: Column) -> Column:
    """The last two words of a text, the last one first; fewer if there are no more."""
    back = F.reverse(between)
    words = F.array(F.regexp_extract(back, r"^\s*+(\S++)", 1), F.regexp_extract(back, r"^\s*+\S++\s++(\S++)", 1))
    return F.transform(F.filter(words, lambda x: x != ""), lambda x: F.lower(F.reverse(x)))


def _form(value: Column) -> Column:
    """The kinds (numbers in KINDS, from 1) whose form a value has."""
    return F.filter(F.array(*(F.when(value.rlike(FORMS[k]), F.lit(n)) for n, k in enumerate(KINDS, 1))), lambda x: x.isNotNull())


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, an array of spans for each kind, and the mentions with the words before them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = [*KINDS, "mention"]
    d = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), text.alias("_text"))
    patterns, hints = PATTERNS | {"mention": MENTION}, HINTS | {"mention": "[0-9@]"}
    d = d.select("doc_id", "key", *(_parts(F.col("_text"), patterns[k], hints[k]).alias(f"_{k}") for k in every))
    d = d.select("*", *(_sizes(F.col(f"_{k}")).alias(f"_n_{k}") for k in every))
    d = d.select("*", *(_sums(F.col(f"_n_{k}")).alias(f"_s_{k}") for k in every))
    found = {k: _located(F.col(f"_{k}"), F.col(f"_n_{k}"), F.col(f"_s_{k}")) for k in every}
    d = d.select("doc_id", "key", *(F.filter(found[k], VALID[k]).alias(k) for k in KINDS), found["mention"].alias("_found"), F.col("_mention.p").alias("_between"))
    seeds = F.concat(*(_numbered(k, n) for n, k in enumerate(KINDS, 1)))
    d = d.withColumn("_seeds", seeds)
    token = F.transform("_found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.exists("_seeds", lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"])).alias("touched")))
    d = d.withColumn("_tokens", token)

    def own(x: Column, i: Column) -> Column:
        """The seeds that start in a word, and the stretches from it that touch none."""
        before = F.when((i == 0) | (F.length(F.col("_between")[i]) > 1), F.col("_between")[i]).otherwise(F.lit(""))
        words = _words_before(before)
        begun = F.filter("_seeds", lambda s: (s["start"] >= x["start"]) & (s["start"] < x["end"]))
        named = F.transform(begun, lambda s: F.struct(s["start"].alias("start"), s["value"].alias("value"), s["kind"].alias("kind"), F.lit(1).alias("words")))

        def stretch(n: Column) -> Column:
            value = F.array_join(F.transform(F.slice("_tokens", i + 1, n), lambda t: t["value"]), " ")
            free = (i + n <= F.size("_tokens")) & ~F.exists(F.slice("_tokens", i + 1, n), lambda t: t["touched"]) & F.forall(F.slice("_between", i + 2, n - 1), lambda p: p == " ")
            return F.when(free, F.struct(x["start"].alias("start"), value.alias("value"), F.lit(None).cast("int").alias("kind"), n.alias("words")))

        lengths = F.sequence(F.lit(1), F.lit(STRETCH))
        every = F.concat(F.when(x["touched"], named).otherwise(F.array().cast(NAMED)), F.filter(F.transform(lengths, stretch), lambda y: y.isNotNull()))
        return F.transform(every, lambda y: F.struct(y["start"].alias("start"), y["value"].alias("value"), y["kind"].alias("kind"), y["words"].alias("words"), words.alias("before")))

    return d.select("doc_id", "key", *KINDS, F.flatten(F.transform("_tokens", own)).alias("mentions"))


NAMED = "array<struct<start:int,value:string,kind:int,words:int>>"


def discovered(found: DataFrame) -> DataFrame:
    """(doc_id, key, start, end, kind) of the mentions that the patterns of the seeds reveal. found: base_spans(), stored."""
    lead, tail = r"^[(\[]+(?![0-9])", r"[.,;:!?\])]+$"
    m = found.select("doc_id", "key", F.explode("mentions").alias("m"))
    free = F.col("m.kind").isNull()
    lead_chars = F.when(free, F.length(F.regexp_extract("m.value", lead, 0))).otherwise(0)
    value = F.when(free, F.regexp_replace(F.regexp_replace(F.col("m.value"), lead, ""), tail, "")).otherwise(F.col("m.value"))
    m = m.select("doc_id", "key", (F.col("m.start") + lead_chars).alias("start"), value.alias("value"), F.col("m.kind").alias("kind"), F.col("m.words").alias("words"), F.col("m.before").alias("before"))
    plain = lambda c: F.trim(F.regexp_replace(c, r"[^\p{L}]+", " "))
    m = m.withColumn("one", plain(F.get("before", F.lit(0)))).withColumn("two", plain(F.concat_ws(" ", F.get("before", F.lit(1)), F.get("before", F.lit(0)))))
    patterns = F.filter(F.array(F.when((F.size("before") > 1) & (F.length("two") > 1), F.xxhash64(F.lit(2), "two")), F.when(F.length("one") > 1, F.xxhash64(F.lit(1), "one"))), lambda x: x.isNotNull())
    m = m.select("doc_id", "key", "start", (F.col("start") + F.length("value")).alias("end"), F.xxhash64("value").alias("value"), "kind", "words", F.when(F.col("kind").isNull(), _form(F.col("value"))).alias("forms"), patterns.alias("patterns"))
    # a stretch of words is a mention only if it has a form
    m = stored(m.where("kind is not null or words = 1 or size(forms) > 0").drop("words"), "mentions")
    # distinct pairs: a mention that a third of the rows repeat is one instance
    edges = m.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    support = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= MIN_SUPPORT).select("pattern", F.col("kind").alias("of"))
    useful = stored(edges.join(support.select("pattern").distinct(), "pattern", "left_semi"), "edges")
    members = useful.groupBy("pattern").agg(F.count(F.lit(1)).alias("members"))
    pairs = useful.join(support, "pattern")
    scores = useful.where("kind is not null").select("value", F.col("kind").alias("of"), F.lit(1.0).alias("score")).distinct()
    for _ in range(ROUNDS):
        confidence = pairs.join(scores, ["value", "of"]).groupBy("pattern", "of").agg(F.sum("score").alias("sum")).join(members, "pattern").select("pattern", "of", (F.col("sum") / F.col("members")).alias("confidence"))
        confidence = confidence.where(F.col("confidence") >= MIN_CONFIDENCE)
        linked = pairs.join(confidence, ["pattern", "of"]).groupBy("value", "of").agg(F.max(F.coalesce(F.col("kind") == F.col("of"), F.lit(False))).alias("seed"), F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))).alias("miss"))
        scores = stored(linked.select("value", "of", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("miss")).alias("score")), "scores")
    shaped = m.where("kind is null").select("doc_id", "key", "start", "end", "value", F.explode("forms").alias("of"))
    good = scores.where(F.col("score") >= THRESHOLD)
    fresh = shaped.join(good, ["value", "of"]).groupBy("doc_id", "key", "start", "end").agg(F.max(F.struct("score", "of"))["of"].alias("kind"))
    return fresh.select("doc_id", "key", "start", "end", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("kind"))


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, the base spans of each kind, and `extra`, the discovered ones (start, end, kind)."""
    found = stored(base_spans(docs), "spans")
    spans = discovered(found).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "kind", "start", "end")
    listed = spans.groupBy("_id", "_key", "kind").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back")))).alias("x"))
    # leftmost and longest first; what overlaps the last one that stays goes
    kind = "named_struct('start', x.start, 'end', -x.back, 'kind', kind)"
    free = F.expr(f"aggregate(x, cast(array() as array<struct<start:int,end:int,kind:string>>), (out, x) -> if(size(out) > 0 and x.start < element_at(out, -1).end, out, concat(out, array({kind}))))")
    extra = listed.select("_id", "_key", free.alias("x")).groupBy("_id", "_key").agg(F.flatten(F.collect_list("x")).alias("extra"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)")
    joined = found.drop("mentions").join(extra, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.drop("_id", "_key").withColumn("extra", F.coalesce("extra", none))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span, base or discovered, replaced by the name of its kind in angle brackets; n_chars follows."""
    doc, key, at = spare(docs, "_span_id"), spare(docs, "_span_key"), spare(docs, "_spans")
    pieces = F.concat(*(_of_kind(k, k) for k in KINDS), F.col("extra"))
    spans = all_spans(docs).select(F.col("doc_id").alias(doc), F.col("key").alias(key), F.array_sort(F.array_distinct(pieces)).alias(at)).where(F.size(at) > 0)
    spans = stored(spans.dropDuplicates([doc, key]), "redactions")
    few = spans.count() <= BROADCAST_IDS // 10
    same = (row_key(docs["doc_id"], docs["text"]) == spans[key]) & docs["doc_id"].eqNullSafe(spans[doc])
    joined = docs.join(F.broadcast(spans) if few else spans, same, "left")
    # where the spans before the i-th end; a span that starts before that is inside or across one of them
    done = f"coalesce(array_max(transform(slice({at}, 1, i), y -> y.end)), 0)"
    text = F.expr(
        f"concat_ws('', transform({at}, (x, i) -> if(x.start >= {done}, concat(substring(text, {done} + 1, x.start - {done}), '<', upper(x.kind), '>'), '')),"
        f" substring(text, array_max({at}.end) + 1))"
    )
    out = joined.withColumn("text", F.when(F.col(at).isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(at).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op8_pii(spark, sf_dir):
    from newsdesk.llm.tables import read

    found = all_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_join(F.concat(*(_named(k, F.col(k)) for k in KINDS)), ",")
    whole = [_named(k, F.array_sort(F.concat(_bare(k), _bare("extra", k)))) for k in KINDS]
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.concat(*whole), ",").alias("spans"))
