"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.llm import (
    bpe, contamination, grading, hardneg, periodic, pii, quality, secrets, sharding, simhash, toxicity, urls, warc,
)
from careerlake.llm.common import table, words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _count_of(spans: str, kind: int | str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    _, records = warc.archived(table(spark, folder, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), VOCABULARY, ids=False)


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    base, added = pii.detect(table(spark, folder, "documents"))
    counts = [_count_of("base", k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    return base.join(added, "key", "left").select(
        "doc_id", *counts, F.sha2(pii.described(F.col("base")), 256).alias("base_sha256"),
        pii.described(pii.merged(F.col("base"), F.col("added"))).alias("spans"),
    )


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scanned(table(spark, folder, "documents"))

    def described(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    counts = [_count_of("spans", kind).alias(f"n_{kind}") for kind in secrets.BASE]
    base = F.filter("spans", lambda s: s.kind.isin(*secrets.BASE))
    return found.select(
        "doc_id", *counts, F.sha2(described(base), 256).alias("base_sha256"), described(F.col("spans")).alias("spans")
    )


def op5_contamination(spark: SparkSession, folder: str) -> DataFrame:
    hits = contamination.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return hits.select("doc_id", "item_id", "shared", "item_shingles", "containment")


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged, entry = quality.ledger(docs)
    measured, bits = judged[entry].measured, judged[entry].bits
    return judged.select(
        "doc_id", measured.n_words.alias("n_words"), measured.word_chars.alias("word_chars"),
        measured.n_symbols.alias("n_symbols"), measured.n_dup_lines.alias("n_dup_lines"),
        measured.n_repeat_words.alias("n_repeat_words"),
        (~quality.passes(bits, quality.BASE)).alias("base_failed"),
        quality.passes(bits, quality.STANDARD).alias("kept"), bits.alias("bits"),
    )


def op7_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.shuffled(rows, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op9_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Grade 0: toxic; 1: of low quality; 2: good. Kept if grade 2 is likelier than not."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    grades = table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality")).alias("grade")
    )
    scored = grading.graded(docs, grading.train(docs, grades, top=2))
    return scored.select(
        "doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_1", 6).alias("tail_1"),
        F.round("tail_2", 6).alias("tail_2"), (F.col("tail_2") > 0.5).alias("kept"),
    )


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of texts of which about a tenth end in repeats; a null id repeats nothing."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    n, h = F.size(words(F.col("text"))), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    numbered = docs.withColumn("n", F.when(h % 10 == 0, n).otherwise(0)).withColumn("g", g)
    at = F.col("g") % F.col("n")
    period = 1 + F.floor((F.col("n") - at) / (3 + F.col("g") % 8))
    changed = numbered.withColumn("text", F.when(F.col("n") > 0, periodic.repeated(F.col("text"), at, period)).otherwise(F.col("text")))
    found = periodic.with_runs(changed.select("doc_id", "text"))
    best = periodic.longest(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"),
        best.period.alias("period"), F.floor(1000 * best.length / best.period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, folder, "labels").select("doc_id", "toxic").filter(~held_out)
    found = toxicity.scored(docs, toxicity.train(docs, labels))
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    whole = table(spark, folder, "embeddings").filter(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    rows = whole.select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double"))).alias("vector"),
    )
    return hardneg.hard_negatives(rows, F.col("id") % 50 == 0)


QUERIES = {
    query.__name__: query
    for query in (
        op1_warc, op2_bpe, op3_pii, op4_secrets, op5_contamination, op6_quality, op7_shards, op8_urls,
        op9_grades, op10_simhash, op11_runs, op12_toxicity,
        op13_hard_negatives,
    )
}

ORACLE = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') body FROM pages),
d AS (SELECT page_id, strlen(body) payload_bytes, sha1(body) hex, max(page_id) OVER (PARTITION BY body) last FROM p),
parts AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) fives FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) payload_bytes,
       array_to_string(list_transform(fives, lambda x: array_to_string(list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS INT) + 1, 1)), '')), '') payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END record_type,
       CASE WHEN page_id <> last THEN last END refers_to
FROM parts""",
    "op5_contamination": r"""
WITH words AS (SELECT 'd' kind, doc_id id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') ws FROM documents
               UNION ALL
               SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
shingles AS (SELECT DISTINCT kind, id, array_to_string(ws[i:i+4], ' ') s
             FROM words, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) r(i) WHERE len(ws) > 0),
sizes AS (SELECT id, count(*) n FROM shingles WHERE kind = 'i' GROUP BY 1),
shared AS (SELECT d.id doc_id, i.id item_id, count(*) shared
           FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY 1, 2)
SELECT doc_id, item_id, shared, n item_shingles, shared / n containment
FROM shared JOIN sizes ON item_id = id WHERE shared >= ceil(0.8 * n)""",
    "op6_quality": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws
           FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') k FROM w, unnest(range(1, len(ws) - 6)) r(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, sum(least(8, coalesce(following - i, 8))) n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) following FROM twice) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls,
             coalesce(n, 0) n_repeat_words,
             len(regexp_extract_all(array_to_string(ws, ''), '[A-ZÀ-Þ]')) n_upper,
             len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) n_repeat_next
      FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, len(ls) - len(list_distinct(ls)) n_dup_lines,
             CASE WHEN n_words < 20 THEN 1 ELSE 0 END
             + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
             + CASE WHEN 2 * (len(ls) - len(list_distinct(ls))) > len(ls) THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 16 ELSE 0 END
             + CASE WHEN 100 * n_upper > 30 * word_chars THEN 32 ELSE 0 END
             + CASE WHEN 100 * n_repeat_next > 30 * n_words THEN 64 ELSE 0 END bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) n_repeat_words,
       bits & 3 <> 0 base_failed, bits = 0 kept, CAST(bits AS BIGINT) bits
FROM b""",
    "op13_hard_negatives": """
WITH rows AS (
    SELECT vec_id id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.id anchor_id, r.id, a.label = r.label same,
           CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) score
    FROM rows a JOIN rows r ON a.id % 50 = 0 AND a.id <> r.id),
pos AS (
    SELECT anchor_id, id positive_id, score positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS "rank",
       id negative_id, positive_score, score negative_score
FROM pos p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT same
     AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY "rank" <= 3""",
}
