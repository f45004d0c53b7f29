"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure
bit per rule. A policy is a versioned set of rules, so a verdict is one bitwise operation and
no policy change reads a text again. What a policy would do without one of its rules is
computed from counts per distinct bitmask.

Null and empty texts have no words and fail the rules for short texts. Repeated rows are
judged row by row. Columns other than the text are not touched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlake.llm.common import fresh, let, positions, words

SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; ``bit`` never changes its meaning."""

    bit: int
    name: str
    fails: Callable[[Column], Column]


RULES = (
    Rule(0, "few_words", lambda m: m.n_words < 20),
    Rule(1, "repeated_windows", lambda m: m.n_repeat_words * 100 > m.n_words * 30),
    Rule(2, "symbols", lambda m: m.n_symbols * 100 > m.n_words * 10),
    Rule(3, "duplicate_lines", lambda m: m.n_dup_lines * 2 > m.n_lines),
    Rule(4, "word_length", lambda m: (m.word_chars < m.n_words * 3) | (m.word_chars > m.n_words * 10)),
    Rule(5, "upper_case", lambda m: m.n_upper * 100 > m.word_chars * 30),
    Rule(6, "repeated_words", lambda m: m.n_repeat_next * 100 > m.n_words * 30),
)


@dataclass(frozen=True)
class Policy:
    """Rules that a document must pass, under a version."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {rule.name: rule.bit for rule in RULES}
        return sum(1 << bits[name] for name in self.rules)


# The base rules, and the policy of the pipeline.
BASE = Policy("base-1", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(rule.name for rule in RULES))


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more.

    The windows are sorted by hash, so equal ones are neighbours; the starts that have an equal
    neighbour are sorted again, and each adds the words up to the next start, eight at most.
    """
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twins = F.filter(
            s,
            lambda e, k: F.coalesce(F.get(s, k - 1).h == e.h, F.lit(False))
            | F.coalesce(F.get(s, k + 1).h == e.h, F.lit(False)),
        )
        return F.sort_array(F.transform(twins, lambda e: e.i))

    def total(p: Column) -> Column:
        steps = F.transform(
            p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(ordered, lambda s: let(starts(s), total))


def _repeat_words(w: Column) -> Column:
    """Words in eight-word windows that the text has twice or more, the first included."""
    windows = F.transform(
        positions(F.size(w) - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
    )
    return let(
        windows,
        lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(_covered(hs)),
    )


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct of longs; each is computed once."""

    def of(t: Column) -> Column:
        def of_words(w: Column) -> Column:
            lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
            joined = F.array_join(w, "")
            repeats = F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))
            return let(
                F.struct(lines.alias("lines"), joined.alias("joined")),
                lambda p: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(p.joined).cast("long").alias("word_chars"),
                    (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    (F.size(p.lines) - F.size(F.array_distinct(p.lines))).cast("long").alias("n_dup_lines"),
                    _repeat_words(w).cast("long").alias("n_repeat_words"),
                    F.size(p.lines).cast("long").alias("n_lines"),
                    (F.length(p.joined) - F.length(F.regexp_replace(p.joined, r"[A-ZÀ-Þ]+", "")))
                    .cast("long").alias("n_upper"),
                    repeats.cast("long").alias("n_repeat_next"),
                ),
            )

        return let(words(t), of_words)

    return let(F.coalesce(text, F.lit("")), of)


def failures(measured: Column) -> Column:
    """One bit per rule, set where the rule fails."""
    bits = [F.when(rule.fails(measured), F.lit(1 << rule.bit)).otherwise(0) for rule in RULES]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return total.cast("long")


def entry_of(text: Column) -> Column:
    """Ledger entry of a text: struct(measured, bits)."""
    return let(measurements(text), lambda m: F.struct(m.alias("measured"), failures(m).alias("bits")))


def passes(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask)) == 0


def ledger(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a ledger entry in a new column, and that column's name."""
    name = fresh(docs, "ledger")
    return docs.withColumn(name, entry_of(docs[text])), name


def accepted(docs: DataFrame, policy: Policy = STANDARD, text: str = "text") -> DataFrame:
    """The documents that pass every rule of a policy, with their columns as they are."""
    return docs.filter(let(entry_of(docs[text]), lambda e: passes(e.bits, policy)))


def ablations(bits: DataFrame, policy: Policy, column: str = "bits") -> DataFrame:
    """Effect of each rule of a policy: documents failing it, and failing nothing else.

    Counts per distinct bitmask come first (at most 2^rules rows, combined before the shuffle);
    everything else is bitwise work on those. An empty ledger gives zeros.
    """
    counted = bits.groupBy(F.col(column).bitwiseAND(F.lit(policy.mask)).alias("failed")).agg(
        F.count(F.lit(1)).alias("docs")
    )
    rules = [rule for rule in RULES if rule.name in policy.rules]

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("docs"))), F.lit(0)).cast("long")

    one_row = counted.agg(
        total(F.lit(True)).alias("docs"), total(F.col("failed") == 0).alias("kept"),
        *[
            F.struct(
                F.lit(rule.name).alias("rule"),
                total(F.col("failed").bitwiseAND(F.lit(1 << rule.bit)) != 0).alias("failing"),
                total(F.col("failed") == (1 << rule.bit)).alias("only_this"),
            ).alias(rule.name)
            for rule in rules
        ],
    )
    return one_row.select(
        F.lit(policy.version).alias("policy"), "docs", "kept",
        F.explode(F.array(*[F.col(rule.name) for rule in rules])).alias("r"),
    ).select("policy", "docs", "kept", "r.*")
