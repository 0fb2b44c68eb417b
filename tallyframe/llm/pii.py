"""Personal data and the terms that give it away, in DataFrame functions alone.

Entities (mail addresses, IP addresses, card and phone numbers) are found by
pattern. How strongly a term reveals an entity is then estimated from the whole
corpus: its pointwise mutual information with the entity over the entity's
information content, which is 1 for a term that is never seen without it.
Terms at or above the threshold are generalised with the entity's spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import SPACE, col, stored

KINDS = ("email", "ip", "card", "phone")
#: Stands for a dot or separator between two label characters; not a character of any pattern.
MARK = "\ue000"
LABEL = "A-Za-z0-9"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
PUNCTUATION = ".,;:!?()\"'"
#: Elements that one fold adds up.
BLOCK = 128
#: Code points of a chunk of a text.
CHUNK = 1024

# The patterns match what these fixed ones match, leftmost and without overlap:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
# A run is entered at its start or where the last match ended, and inner dots
# and separators are marked first, so that no pattern repeats a group: long
# texts cost linear time and no stack.
EMAIL = (
    f"(?:(?<![{LABEL}._%+{MARK}-])|\\G)[{LABEL}._%+{MARK}-]++@[{LABEL}-]++{MARK}[{LABEL}{MARK}-]++"
)
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = f"(?<![0-9{MARK}])(?:[0-9]{MARK}?+){{15,18}}[0-9](?![0-9{MARK}])"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), body)[0]


def _chunked(text: Column) -> Column:
    """A text in chunks of ``CHUNK`` code points, because a place is found by counting from the start of a string."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, length: Column) -> Column:
    """``length`` code points of a chunked text from ``start`` on, counted from 0."""
    first = F.call_function("div", start, F.lit(CHUNK)).cast("int")
    last = F.call_function("div", start + F.greatest(length, F.lit(1)) - 1, F.lit(CHUNK)).cast("int")
    return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * CHUNK + 1, length)


def _scan(values: Column, start: Column, join) -> Column:
    """For each of a few numbers what ``join`` makes of ``start`` and all numbers before it."""
    none = F.array().cast("array<int>")

    def step(state: Column, v: Column) -> Column:
        return F.struct(join(state["at"], v).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    return F.aggregate(values, F.struct(start.alias("at"), none.alias("out")), step, lambda s: s["out"])


def _before(values: Column, join) -> Column:
    """For each number of an array what ``join`` makes of 0 and all numbers before it.

    A fold copies the array it grows at every step, so it is done in blocks of
    ``BLOCK``: their totals first, then each block from where the last one ended.
    """

    def blocked(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: F.slice(v, at, F.lit(BLOCK)))

        def joined(b: Column) -> Column:
            totals = F.transform(b, lambda x: F.aggregate(x, F.lit(0), join))
            return F.flatten(F.zip_with(b, _scan(totals, F.lit(0), join), lambda x, base: _scan(x, base, join)))

        return F.when(F.size(v) > 0, _let(blocks, joined)).otherwise(F.array().cast("array<int>"))

    return _let(values, blocked)


def _located(text: Column, pattern: str | Column, kind: str) -> Column:
    """All matches with their places in code points."""
    empty = F.array().cast(SPAN)

    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["found"]))

        def span(x: Column, before: Column) -> Column:
            start = before + F.length(x["gap"])
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["found"])).alias("end"), x["found"].alias("value"))

        return F.zip_with(pairs, _before(lengths, lambda a, n: a + n), span)

    def places(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, f: F.struct(g.alias("gap"), f.alias("found")))
        return F.when(F.size(found) > 0, _let(pairs, placed)).otherwise(empty)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def _with_value(spans: Column, value) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value(s["value"]).alias("value"))
    )


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right; every second digit from the right counts twice."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.try_cast("int").alias("d"), i.alias("i")))
    doubled = F.transform(
        F.filter(places, lambda x: x["d"].isNotNull()),
        lambda x: F.when(x["i"] % 2 == 0, x["d"]).when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def entity_spans(text: Column) -> dict[str, Column]:
    """For each kind the spans of a text, by start: kind, start, end (exclusive), value."""
    none = F.array().cast(SPAN)
    dotted = F.regexp_replace(F.translate(text, MARK, " "), f"(?<=[{LABEL}-])\\.(?=[{LABEL}-])", MARK)
    email = _let(dotted, lambda t: _with_value(_located(t, EMAIL, "email"), lambda v: F.translate(v, MARK, ".")))

    in_range = lambda v: F.forall(F.split(v, "\\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    ip = F.filter(_located(text, IP, "ip"), lambda s: in_range(s["value"]))

    joined = F.regexp_replace(F.translate(text, MARK, "x"), "(?<=[0-9])[\\x20-](?=[0-9])", MARK)
    card = _let(joined, lambda t: _with_value(_located(t, CARD, "card"), _digits))
    card = F.filter(card, lambda s: _luhn(s["value"]))

    phone = _with_value(_located(text, PHONE, "phone"), _digits)
    phone = F.filter(phone, lambda s: F.length(s["value"]).between(8, 15))
    return {
        "email": F.when(F.contains(text, F.lit("@")), email).otherwise(none),
        "ip": F.when(text.rlike("[0-9]\\.[0-9]"), ip).otherwise(none),
        "card": F.when(text.rlike("[0-9][\\x20-]?[0-9][\\x20-]?[0-9][\\x20-]?[0-9]"), card).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), phone).otherwise(none),
    }


def _terms(text: Column) -> Column:
    """The distinct words without punctuation around them, of letters, digits, hyphens, underscores and apostrophes alone."""
    words = F.transform(F.split(text, SPACE), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) >= 3) & w.rlike("^[\\p{L}\\p{M}\\p{N}'_-]+$"))


def disclosing_terms(
    mentions: DataFrame, texts: DataFrame, documents: int, threshold: float = 0.9, support: int = 3
) -> DataFrame:
    """Pairs of an entity's ``value`` and a ``term`` that reveals it, with the ``disclosure``.

    ``mentions`` has ``value``, ``context`` (what is counted: in ``sanitise`` a
    hash of the distinct text) and the ``terms`` of the context, and may have
    ``around``, a hash of the words next to the entity. Contexts count once per
    entity however many copies hold them, so copied texts alone reveal nothing.
    ``support`` is the number of distinct ``around``, or else of contexts, that
    a pair needs.

    disclosure = log2(N n(e,t) / (n(e) n(t))) / log2(N / n(e)), where N is the
    number of ``documents``, n(t) the ``texts`` that hold the term, and n(e),
    n(e,t) the contexts of the entity and those with the term; ``texts`` must
    be in the unit of the contexts. The contexts of any entity that hold a
    term are a lower bound of n(t), which rules out common words before the
    corpus is searched for the others.
    """
    apart = F.col("around" if "around" in mentions.columns else "context")
    contexts = mentions.groupBy("value", "context").agg(F.max("terms").alias("terms"), F.min(apart).alias("apart"))
    entities = contexts.groupBy("value").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= support)
    pairs = contexts.select("value", "apart", F.explode("terms").alias("term")).groupBy("value", "term")
    pairs = pairs.agg(F.count(F.lit(1)).alias("n_et"), F.count_distinct("apart").alias("support")).where(F.col("support") >= support)
    near = mentions.groupBy("context").agg(F.max("terms").alias("terms")).select(F.explode("terms").alias("near"))
    near = near.groupBy("near").agg(F.count(F.lit(1)).alias("least"))
    n = F.lit(float(documents))

    def disclosure(n_t: Column) -> Column:
        share = F.log2(n * F.col("n_et") / (F.col("n_e") * n_t)) / F.log2(n / F.col("n_e"))
        return F.when(F.col("n_e") < documents, share).otherwise(0.0)

    pairs = pairs.join(entities.withColumnRenamed("value", "entity"), F.col("value") == F.col("entity"))
    pairs = pairs.join(near, F.col("term") == F.col("near")).where(disclosure(F.col("least")) >= threshold)
    pairs = stored(pairs.select("value", "term", "n_e", "n_et"), "pairs")
    wanted = pairs.select(F.col("term").alias("w")).distinct()
    # Terms are counted before they meet the wanted ones: what is shuffled are counts, not all occurrences.
    seen = texts.select(F.explode(_terms(F.col("text"))).alias("seen")).groupBy("seen").agg(F.count(F.lit(1)).alias("n_t"))
    seen = seen.join(wanted, F.col("seen") == F.col("w"))
    scored = pairs.join(seen, F.col("term") == F.col("seen"))
    scored = scored.select("value", "term", disclosure(F.col("n_t")).alias("disclosure"))
    return scored.where(F.col("disclosure") >= threshold)


def _term_spans(text: Column, terms: Column, taken: Column) -> Column:
    """Whole-word occurrences of the terms outside the spans already taken."""
    edge = "[^\\x20\\x09-\\x0D.,;:!?()\"']"
    longest = F.array_sort(terms, lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(f"(?<!{edge})(?:"), F.array_join(longest, "|"), F.lit(f")(?!{edge})"))
    empty = F.array().cast(SPAN)

    def located(p: Column) -> Column:
        return _located(text, p, "term")

    spans = F.when(F.size(terms) > 0, _let(pattern, located)).otherwise(empty)
    free = lambda s: ~F.exists(taken, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    return F.coalesce(F.filter(spans, free), empty)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span as its kind in brackets; overlapping spans give one."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def parts(sorted_spans: Column, chunks: Column) -> Column:
        ends = F.transform(sorted_spans, lambda s: s["end"])

        def part(s: Column, at: Column) -> Column:
            before = _cut(chunks, at, s["start"] - at)
            return F.when(s["start"] >= at, F.concat(before, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        shown = F.zip_with(sorted_spans, _before(ends, lambda a, e: F.greatest(a, e)), part)
        return F.concat(F.array_join(shown, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _let(order, lambda o: _let(_chunked(text), lambda c: parts(o, c)))).otherwise(text)


def sanitise(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.9,
    support: int = 3,
    reach: int = 64,
) -> DataFrame:
    """All columns of ``docs`` with ``base_spans``, ``term_spans`` and ``clean_text``.

    ``base_spans`` has the entities by kind and start; ``term_spans`` the
    occurrences, in any document, of terms that reveal an entity. Both are
    counted together wherever they stand in the same text, over distinct texts;
    ``reach`` is how many characters around an entity must differ for a text
    to count towards ``support``. A null text counts as an empty one
    and has no spans. Rows that share an id and a text are treated alike, rows
    that share only one of them are not. Columns of the input with the added
    names, in any case, are replaced. An empty table gives no rows.
    """
    added = ("base_spans", "term_spans", "clean_text")
    names = [c for c in docs.columns if c.lower() not in added]
    plain = docs.select(*(col(docs, c).alias(f"_{i}") for i, c in enumerate(names)))
    plain = plain.withColumn("_text", F.coalesce(f"_{names.index(text_col)}", F.lit("")))
    plain = plain.withColumn("_key", F.xxhash64(f"_{names.index(id_col)}", "_text"))

    by_kind = entity_spans(F.col("_text"))
    every = F.concat(*(by_kind[k] for k in KINDS))
    spans = plain.withColumn("_spans", every).where(F.size("_spans") > 0)
    def seen(s: Column, chunks: Column) -> Column:
        reached = F.least(s["start"], F.lit(reach))
        left = _cut(chunks, s["start"] - reached, reached)
        left = F.when(s["start"] > reach, F.regexp_replace(left, "^[^\\x20\\x09-\\x0D]+", "")).otherwise(left)
        right = _cut(chunks, s["end"], F.lit(reach + 1))
        right = F.when(F.length(right) > reach, F.regexp_replace(right, "[^\\x20\\x09-\\x0D]+$", "")).otherwise(right)
        around = F.xxhash64(F.concat(left, F.lit(" "), right))
        return F.struct(F.concat_ws(":", s["kind"], s["value"]).alias("value"), around.alias("around"))

    mentioned = _let(_chunked(F.col("_text")), lambda c: F.transform("_spans", lambda s: seen(s, c)))
    found = spans.select(F.xxhash64("_text").alias("context"), F.explode(mentioned).alias("m")).select("context", "m.value", "m.around")
    found = stored(found.groupBy("value", "context").agg(F.min("around").alias("around")), "mentions")
    often = found.groupBy("value").agg(F.count_distinct("around").alias("n")).where(F.col("n") >= support)
    often = stored(found.join(often.select(F.col("value").alias("o")), F.col("value") == F.col("o")).drop("o"), "often")
    # Terms are sought outside the entities; what an entity is made of reveals nothing more.
    outside = sanitised(F.col("_text"), F.col("_spans")).alias("text")
    contexts = often.select(F.col("context").alias("c")).distinct()
    held = plain.withColumn("_spans", every).where(F.size("_spans") > 0).withColumn("h", F.xxhash64("_text"))
    held = held.join(contexts, F.col("h") == F.col("c")).dropDuplicates(["h"])
    held = stored(held.select("h", outside).select("h", _terms(F.col("text")).alias("terms")), "held")
    mentions = often.join(held, F.col("context") == F.col("h")).select("value", "context", "around", "terms")
    # Only here whole texts are shuffled, once, to count each distinct one once.
    texts = plain.select("_text").distinct().withColumn("_spans", every).select(outside)
    documents = plain.select(F.xxhash64("_text"), F.crc32(F.col("_text").cast("binary"))).distinct().count()
    revealing = disclosing_terms(mentions, texts, documents, threshold, support)
    revealing = stored(revealing.select(F.col("term").alias("t")).distinct(), "revealing")
    own = plain.select("_key", F.explode(_terms(F.col("_text"))).alias("term")).join(revealing, F.col("term") == F.col("t"))
    # Stored, so that its size is known: texts are shuffled only where it is too large to send around.
    own = own.groupBy(F.col("_key").alias("key")).agg(F.collect_set("term").alias("terms"))
    own = stored(own, "terms")

    judged = plain.join(own, F.col("_key") == F.col("key"), "left")
    based = judged.select("*", F.concat(*(by_kind[k] for k in KINDS)).alias("base_spans"))
    terms = F.when(F.col("terms").isNotNull(), _term_spans(F.col("_text"), F.col("terms"), F.col("base_spans")))
    based = based.withColumn("term_spans", F.coalesce(terms, F.array().cast(SPAN)))
    clean = sanitised(F.col("_text"), F.concat("base_spans", "term_spans"))
    return based.select(
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(names)), "base_spans", "term_spans", clean.alias("clean_text")
    )


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
