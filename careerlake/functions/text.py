"""Text cleaning, normalizing and tokenizing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from careerlake.functions.wordlists import CHUNK_STOP_WORDS

# Cells that mean "no value" in an extract.
NULL_TOKENS = ["nan", "None", "null"]

# Patterns of the two tag strippers and of the word-cloud tokenizer.
ANY_TAG = "<[^>]*>"
FILLED_TAG = "<[^>]+>"
WORD_CLOUD_TOKEN = r"(?U)\b[a-zA-Z_]{3,20}\b"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body).getItem(0)


def filled(c: Column) -> Column:
    """NULL for an empty string, the value otherwise."""
    return F.nullif(c, F.lit(""))


def first_filled(*candidates: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[filled(c) for c in candidates])


def or_default(c: Column, default) -> Column:
    """The value, or ``default`` where the key is missing."""
    return F.coalesce(c, F.lit(default))


def scrub_null_tokens(c: Column) -> Column:
    """Cells that spell a null become empty strings."""
    return F.when(c.isin(NULL_TOKENS), F.lit("")).otherwise(F.coalesce(c, F.lit("")))


def strip_tags(c: Column, pattern: str = ANY_TAG) -> Column:
    """Replace markup tags by a space and trim."""
    return F.trim(F.regexp_replace(c, pattern, " "))


def flat_line(c: Column) -> Column:
    """Newlines become spaces."""
    return F.translate(c, "\n", " ")


def clip(c: Column, size: int) -> Column:
    """First ``size`` characters."""
    return F.substring(c, 1, size)


def normalize(
    c: Column,
    stop_words: Sequence[str] = CHUNK_STOP_WORDS,
    segment: Callable[[Column], Column] | None = None,
) -> Column:
    """Lower-case words without punctuation and stop words.

    ``segment`` may join multi-word terms with ``_`` before stop words are dropped.
    """
    # Punctuation becomes a blank and blanks collapse: one pass over non-word runs.
    tidy = F.trim(F.regexp_replace(F.lower(c), r"(?U)\W+", " "))
    if segment is not None:
        tidy = segment(tidy)
    # A word holds no blank, so a stop word of several words shows up with "_" for its blanks.
    dropped = ["", *[s.replace(" ", "_") for s in stop_words if "_" not in s]]
    words = F.filter(F.split(tidy, " "), lambda w: ~w.isin(dropped))
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def normalize_query(
    c: Column,
    stop_words: Sequence[str] = CHUNK_STOP_WORDS,
    segment: Callable[[Column], Column] | None = None,
) -> Column:
    """Query text goes through the normalizer of the chunks, so the two are comparable."""
    return normalize(c, stop_words, segment)


def cloud_tokens(c: Column, stop_words: Sequence[str]) -> Column:
    """Words of four to twenty ASCII letters that are no stop words.

    The list is the site's own and always given; none is built in.
    """
    low = F.lower(F.regexp_replace(c, FILLED_TAG, " "))
    found = F.regexp_extract_all(low, F.lit(WORD_CLOUD_TOKEN), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 3) & ~w.isin(list(stop_words)))


def session_title(c: Column, words: int = 6) -> Column:
    """First words of the opening message, followed by dots."""
    split = F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), " ")
    return F.concat(F.array_join(F.slice(split, 1, words), " "), F.lit("..."))
