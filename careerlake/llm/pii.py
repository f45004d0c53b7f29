"""Personal data and the terms that give it away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Masking those alone leaves
words beside them that still tell whose they are. So the corpus is asked: the words around the
mentions of a protected value (an entity) are counted, as are all words, and the pointwise mutual
information of a term and an entity, measured against the entity's own information content, says
what share of the entity the term discloses:

    share = log2(n(t, e) * N / (n(t) * n(e))) / log2(N / n(e))

``n(t, e)`` counts the term's places beside the entity, ``n(t)`` all its places, ``n(e)`` all
places beside the entity and ``N`` all places of all terms. A term seen with the entity in at
least ``CONTEXTS`` different surroundings, of which a row counts one, is generalised from a share
of ``GENERALISE`` on and removed from ``REMOVE`` on; a share of 1 means that it occurs nowhere
else. Different surroundings are asked for so that copies of one passage are no evidence.

Counts cover every whole text. Null and empty texts have no spans; repeated rows have the same
spans each; empty tables give no rows. Places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlake.llm.common import fresh, let, positions, row_key, written

# Possessive quantifiers and the look-behinds change no match; they keep runs of any length linear.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = (
    ("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[ -]?+[0-9])++"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]"),
)
KINDS = (*(name for name, _ in PATTERNS), "remove", "general")
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "remove": "", "general": "<TERM>"}

TERM = r"\p{L}{4,}"
REACH = 120  # characters on either side of a mention that are its surroundings
CONTEXTS = 3
GENERALISE = 0.9
REMOVE = 0.98


def _located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs of start, end and value, in order.

    What lies between matches is split off, and lengths are added up.
    """

    def fold(parts: Column) -> Column:
        start = F.struct(
            F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found")
        )

        def step(acc: Column, i: Column) -> Column:
            value = F.get(parts.matches, i)
            begin = acc.at + F.length(F.get(parts.pieces, i))
            return let(F.struct(begin.alias("start"), (begin + F.length(value)).alias("end"), value.alias("value")),
                       lambda m: F.struct(m.end.alias("at"), F.concat(acc.found, F.array(m)).alias("found")))

        return F.aggregate(positions(F.size(parts.matches)), start, step).found

    return let(
        F.struct(
            F.split(text, pattern, -1).alias("pieces"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
        ),
        fold,
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def total(backwards: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            digit = F.substring(backwards, i + 1, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 0, digit).otherwise(F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2))

        return F.aggregate(positions(F.length(backwards)), F.lit(0), step) % 10 == 0

    return let(F.reverse(digits), total)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."),
            lambda part: let(F.regexp_replace(part, "^0+", ""), lambda p: F.when(F.length(p) > 3, False).when(
                F.length(p) == 0, True).otherwise(p.cast("int") <= 255)),
        )
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


# A text without these has no match of the kind; looking for them is cheaper.
_HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": lambda t: t.contains("+"),
}

_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def base_spans(text: Column) -> Column:
    """Base spans of a text, by start, then kind: structs of start, end, kind number and value."""

    def of(t: Column) -> Column:
        def of_kind(number: int, kind: str, pattern: str) -> Column:
            spans = F.transform(
                F.filter(_located(t, pattern), lambda m: _valid(kind, m.value)),
                lambda m: F.struct(
                    m.start.alias("start"), F.lit(number).alias("kind"), m.end.alias("end"), m.value.alias("value")
                ),
            )
            return F.when(_HINTS[kind](t), spans).otherwise(F.array().cast(_SPANS))

        return F.sort_array(F.concat(*[of_kind(n, kind, pattern) for n, (kind, pattern) in enumerate(PATTERNS)]))

    return let(F.coalesce(text, F.lit("")), of)


def _terms(text: Column, base: Column, span: Column) -> Column:
    """Whole terms near a span that lie in no base span: structs of term, start and end."""
    begin = F.greatest(span.start - REACH, F.lit(0))

    def within(part: Column, offset: Column, is_cut) -> Column:
        return let(part, lambda p: F.transform(
            F.filter(_located(p, TERM), lambda m: ~is_cut(m)),
            lambda m: F.struct(
                F.lower(m.value).alias("term"), (m.start + offset).alias("start"), (m.end + offset).alias("end")
            ),
        ))

    before = within(F.substring(text, begin + 1, span.start - begin), begin, lambda m: (m.start == 0) & (begin > 0))
    after = within(F.substring(text, span.end + 1, F.lit(REACH)), span.end, lambda m: m.end == REACH)
    return F.filter(
        F.concat(before, after), lambda w: ~F.exists(base, lambda s: (s.start < w.end) & (w.start < s.end))
    )


def _entity(span: Column) -> Column:
    """The protected value behind a span, whatever its spelling."""
    value = F.when(span.kind == 0, F.lower(span.value)).when(span.kind == 1, span.value).otherwise(_digits(span.value))
    return F.concat(span.kind.cast("string"), F.lit(":"), value)


def _mentions(text: Column, base: Column) -> Column:
    return let(F.coalesce(text, F.lit("")), lambda t: F.transform(base, lambda s: let(
        _terms(t, base, s),
        lambda terms: F.struct(
            _entity(s).alias("entity"), F.xxhash64(F.transform(terms, lambda w: w.term)).alias("context"),
            terms.alias("terms"),
        ),
    )))


def term_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``term, places`` over all texts; added up before the shuffle."""
    runs = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\P{L}+")
    return texts.select(F.explode(runs).alias("term")).filter(F.length("term") >= 4).groupBy("term").agg(
        F.count(F.lit(1)).alias("places")
    )


def disclosing(mentions: DataFrame, counts: DataFrame) -> DataFrame:
    """``entity, term, kind``: terms that disclose an entity beyond a threshold.

    ``mentions`` has key, entity, context and terms; ``counts`` is a written table of all terms.
    """
    places = mentions.select("key", "entity", "context", F.explode("terms").alias("t")).select(
        "key", "entity", "context", "t.term"
    )
    beside = places.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    in_rows = places.groupBy("entity", "term", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("context").alias("context")
    )
    together = in_rows.groupBy("entity", "term", "context").agg(F.sum("n").alias("n")).groupBy("entity", "term").agg(
        F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("contexts")
    ).filter(F.col("contexts") >= CONTEXTS)
    everything = counts.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    total = F.lit(float(everything))
    content = F.log2(total / F.col("n_e"))
    share = F.log2(F.col("n_te") * total / (F.col("places") * F.col("n_e"))) / content
    return together.join(counts, "term").join(beside, "entity").filter(content > 0).withColumn("share", share).filter(
        F.col("share") >= GENERALISE
    ).select(
        "entity", "term",
        F.when(F.col("share") >= REMOVE, KINDS.index("remove")).otherwise(KINDS.index("general")).alias("kind"),
    )


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Base spans per row (``key, doc_id, base``), and added spans per key (``key, added``).

    Texts are read twice, for spans and for counts, and never shuffled.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    located = written(
        source.select(
            row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text", base_spans(F.col("text")).alias("base")
        ).select(
            "key", "doc_id", "base",
            F.when(F.size("base") > 0, _mentions(F.col("text"), F.col("base"))).alias("mentions"),
        ),
        "spans",
    )
    mentions = located.select("key", F.explode("mentions").alias("m")).select("key", "m.*")
    counts = written(term_counts(source), "terms")
    flagged = written(disclosing(mentions, counts), "flagged")
    added = mentions.select("key", "entity", F.explode("terms").alias("t")).select("key", "entity", "t.*").join(
        flagged, ["entity", "term"]
    ).groupBy("key", "start", "end").agg(F.min("kind").alias("kind")).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("added")
    )
    return located.select("key", "doc_id", "base"), written(added, "added")


def described(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def merged(base: Column, added: Column) -> Column:
    """All spans by start, then kind."""
    plain = F.transform(base, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    more = F.transform(added, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    return F.sort_array(F.concat(plain, F.coalesce(more, F.array().cast("array<struct<start:int,kind:int,end:int>>"))))


def masked(text: Column, spans: Column) -> Column:
    """The text with its spans replaced; spans that overlap are replaced as one, by the first's mask."""
    masks = F.array(*[F.lit(MASKS[kind]) for kind in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(
            s.start >= acc.at,
            F.struct(s.end.alias("at"), F.concat(
                acc.out, F.array(F.substring(text, acc.at + 1, s.start - acc.at), F.get(masks, s.kind))
            ).alias("out")),
        ).otherwise(F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out")))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc.out, ""), F.substring(text, acc.at + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, finish))


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all spans masked in the text; other columns, rows and null texts stay."""
    _, added = detect(docs, doc_id, text)
    key, more = fresh(docs, "row_key"), fresh(docs, "added")
    joined = docs.withColumn(key, row_key(docs[doc_id], docs[text])).join(
        added.select(F.col("key").alias(key), F.col("added").alias(more)), key, "left"
    )
    spans = merged(base_spans(F.col(text)), F.col(more))
    return joined.withColumn(text, let(spans, lambda s: masked(F.col(text), s))).select(*docs.columns)
