"""Benchmark items inside documents: size-partitioned MinHash containment search.

A text's set is its distinct five-word shingles over lower-cased letter and digit runs; fewer
words make one shingle, no words none. A short item inside a long document has a tiny Jaccard
similarity, so a signature of fixed length cannot see it. Here the signature grows with the
document: documents fall into size classes of powers of two, and a class of 2^s shingles has
2^s bins, of which each keeps the least hash in it. A shingle survives as the least of its bin
with a chance of 63 % at least, so an item with q shingles, of which a share t is in the
document, is missed only if t * q shingles all lose. Items are partitioned by size too: small
ones are sought in as many independent signatures as bring that chance below ``MISS``.

A document and an item that agree in one bin are candidates; the exact share of the item's
shingles in the document decides. A hit needs ``share`` of them, 0.8 unless told otherwise.

Null and empty texts, on either side, have no shingles and never match. Repeated documents are
each reported; repeated items are reported under each of their ids. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlake.llm.common import fresh, let, positions, row_key, written

SHINGLE = 5
SHARE = 0.8
MISS = 1e-3
LOSS = 1 / math.e  # chance that a shingle is not the least of its bin, at most


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _per_shingle(of: Column, shingle, whole) -> Column:
    """Distinct ``shingle(i)`` for every start i, or ``whole`` for a text of too few words."""
    many = F.transform(positions(F.size(of) - (SHINGLE - 1)), shingle)
    return F.when(F.size(of) >= SHINGLE, F.array_distinct(many)).when(F.size(of) > 0, F.array(whole)).otherwise(
        F.slice(F.array(whole), 1, 0)
    )


def hashes(text: Column) -> Column:
    """Distinct shingles of a text as 64-bit hashes; too few words fill up with nulls."""
    return let(tokens(text), lambda w: _per_shingle(
        w, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]),
        F.xxhash64(*[F.get(w, F.lit(k)) for k in range(SHINGLE)]),
    ))


def shingles(text: Column) -> Column:
    """Distinct shingles of a text as strings."""
    return let(tokens(text), lambda w: _per_shingle(
        w, lambda i: F.array_join(F.slice(w, i + 1, F.lit(SHINGLE)), " "), F.array_join(w, " ")
    ))


def _signature(found: Column) -> Column:
    """The least hash of each bin, with as many bins as the size class has shingles."""

    def of(ordered: Column) -> Column:
        size_class = F.ceil(F.log2(F.greatest(F.size(ordered), F.lit(2)))).cast("int")
        return let(
            F.lit(64) - size_class,
            lambda shift: F.filter(
                ordered,
                lambda h, i: (i == 0)
                | (F.call_function("shiftright", h, shift) != F.call_function("shiftright", F.get(ordered, i - 1), shift)),
            ),
        )

    return let(F.sort_array(found), of)


def _permuted(h: Column, permutation: int) -> Column:
    return h if permutation == 0 else F.xxhash64(h, F.lit(permutation))


def _each(found: Column, permutation: int) -> Column:
    return F.transform(found, lambda h: _permuted(h, permutation))


def signatures(text: Column, permutations: int) -> Column:
    """All bins of all signatures of a text, as hashes that differ between signatures."""
    return let(hashes(text), lambda found: F.concat(*[
        _signature(found if p == 0 else _each(found, p)) for p in range(permutations)
    ]))


def _signatures_needed(size: Column, share: float) -> Column:
    """Independent signatures that bring an item's chance of being missed below ``MISS``."""
    return F.ceil(F.lit(math.log(MISS) / math.log(LOSS)) / (F.ceil(size * share))).cast("int")


def find(
    docs: DataFrame, items: DataFrame, share: float = SHARE,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``key, doc_id, item_id, shared, item_shingles, containment`` for every hit.

    The documents are read twice; only hashes meet the items. Items join by size: the planner
    broadcasts their written table if its size allows, and shuffles both sides if not.
    """
    source = docs.select(
        row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")
    )
    sought = written(
        items.select(
            F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"),
            shingles(F.col(item_text)).alias("shingles"), hashes(F.col(item_text)).alias("hashes"),
        ).filter(F.size("hashes") > 0).withColumn("signatures", _signatures_needed(F.size("hashes"), share)),
        "items",
    )
    permutations = sought.agg(F.max("signatures")).first()[0] or 1
    wanted = written(
        sought.select(
            "item", F.posexplode(F.array(*[_each(F.col("hashes"), p) for p in range(permutations)])).alias("p", "hs"),
            "signatures",
        ).filter("p < signatures").select("item", F.explode("hs").alias("hash")),
        "wanted",
    )
    bins = source.select("key", F.explode(signatures(F.col("text"), permutations)).alias("hash"))
    pairs = written(bins.join(wanted, "hash").select("key", "item").distinct(), "pairs")
    keys = written(pairs.select("key").distinct(), "keys")
    parts = pairs.join(sought.select("item", "item_id", "shingles"), "item").groupBy("key").agg(
        F.collect_list(F.struct("item_id", "shingles")).alias("items")
    )
    found = let(shingles(F.col("text")), lambda own: F.transform(
        "items",
        lambda it: F.struct(
            it.item_id.alias("item_id"),
            F.size(F.array_intersect(own, it.shingles)).cast("long").alias("shared"),
            F.size(it.shingles).cast("long").alias("item_shingles"),
        ),
    ))
    checked = source.join(keys, "key", "left_semi").join(parts, "key").select(
        "key", "doc_id", F.explode(found).alias("hit")
    )
    return checked.select(
        "key", "doc_id", "hit.*", (F.col("hit.shared") / F.col("hit.item_shingles")).alias("containment")
    ).filter(F.col("shared") >= F.ceil(F.col("item_shingles") * share))


def clean(
    docs: DataFrame, items: DataFrame, share: float = SHARE,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The documents without any hit, with their columns as they are."""
    hit = written(
        find(docs, items, share, doc_id, text, item_id, item_text).select("key").distinct(), "hits"
    )
    name = fresh(docs, "row_key")
    return docs.withColumn(name, row_key(docs[doc_id], docs[text])).join(
        hit.withColumnRenamed("key", name), name, "left_anti"
    ).drop(name)
