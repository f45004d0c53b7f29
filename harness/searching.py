"""Vector, keyword and hybrid search over the given tables, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from careerlake.functions import matching, text, vectors
from careerlake.functions.wordlists import QUERY_STOP_WORDS
from careerlake.operators import cells, postings
from careerlake.operators.embed import embed_hashed, embed_with
from careerlake.operators.nearest import BRANCH_SIZE, nearest
from careerlake.operators.ranking import average_rank, fused_score
from careerlake.plans import prompts, search
from careerlake.session import scratch_path
from harness import roles
from harness.cleaning import sql_normalize
from harness.roles import table, with_search

INTRODUCTION = "You advise on jobs."
RULES = "[RULES]:\n1. Use the listed jobs only.\n"
_TITLE, _PLACES = "red widget", ["the", "small"]
_DIMENSION = 64


def vector_codec(spark, sf):
    """Vectors as text and back."""
    stored = table(spark, sf, "embeddings").select(
        "vec_id", vectors.vector_to_text(F.col("embedding")).alias("written"))
    back = vectors.vector_from_text(F.col("written"))
    total = F.aggregate(back, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return stored.select("vec_id", F.size(back).cast("bigint").alias("dimension"),
                         F.round(total, 5).alias("total"))


def cosine_topk(spark, sf):
    """Nearest stored vectors of each label's mean vector."""
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding")
    wanted = roles.centroids(spark, sf).select(
        F.col("label").cast("bigint").alias("query_id"), "embedding")
    found = nearest(docs, wanted, BRANCH_SIZE)
    return found.select("query_id", "job_id", F.col("rank").cast("bigint").alias("rank"),
                        F.round("vector_distance", 6).alias("vector_distance"))


def cosine_topk_cells(spark, sf):
    """The same through cells of documents, exactly."""
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding")
    wanted = roles.centroids(spark, sf).select(
        F.col("label").cast("bigint").alias("query_id"), "embedding")
    index = cells.CellIndex.build(docs, scratch_path(spark, "cells"), cells=16)
    found = cells.nearest_by_cells(index, wanted, BRANCH_SIZE, probes=4, exact=True)
    return found.select("query_id", "job_id", F.col("rank").cast("bigint").alias("rank"),
                        F.round("vector_distance", 6).alias("vector_distance"))


def cosine_pairs(spark, sf):
    """Distance of each vector to the mean of its own label, in the JVM."""
    means = roles.centroids(spark, sf).withColumnRenamed("embedding", "mean")
    pairs = table(spark, sf, "embeddings").join(means, "label")
    distance = vectors.cosine_distance(F.col("embedding"), F.col("mean"))
    return pairs.select("vec_id", F.round(distance, 6).alias("vector_distance"))


def vector_search(spark, sf):
    """One request: nearest to a vector among jobs that mention a place."""
    found = search.vector_search(
        roles.search_documents(spark, sf), [1.0] * _DIMENSION, _PLACES)
    return found.select("job_id", "job_title", F.round("vector_distance", 6).alias("vector_distance"))


def keyword_search(spark, sf):
    """One request: all title words, in jobs that mention a place."""
    found = search.keyword_search(
        roles.search_documents(spark, sf), _TITLE.split(), _PLACES)
    return found.select("job_id", "job_title", "vector_distance")


def _title_requests(spark, sf):
    """Every part name as a request; places vary by part."""
    key, first = F.col("p_partkey"), F.substring_index("p_name", " ", 1)
    return table(spark, sf, "part").select(
        key.alias("query_id"), matching.split_words(F.lower("p_name")).alias("title_words"),
        search.place_terms(
            F.when(key % 4 == 1, F.array(first)).when(key % 4 == 2, F.array(F.lit("The"), F.lit("small")))
            .when(key % 4 == 3, F.array(F.lit("nowhere land"), F.lit("nll"))).otherwise(F.array())).alias("places"))


def keyword_table(spark, sf):
    """All part names as keyword requests, through an index built by two loads."""
    docs, path = roles.search_documents(spark, sf), scratch_path(spark, "titles")
    for load in (0, 1):
        postings.index_titles(docs.filter(F.col("job_id") % 2 == load)).append(path)
    found = postings.keyword_table(_title_requests(spark, sf), docs, postings.TitleIndex.read(spark, path))
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "job_id")


def query_keywords(spark, sf):
    """Keywords of every user message, with one place name taken out."""
    said = table(spark, sf, "conversations").filter("role = 'user'")
    words = matching.query_keywords(F.col("text"), F.array(F.lit("the")))
    text = search.search_text(F.lit("red widget"), F.col("text"), F.col("text"))
    return said.select("conv_id", "turn", F.array_join(words, "|").alias("keywords"), text.alias("search_text"))


def intent_parse(spark, sf):
    """Wanted titles and places from JSON text, some of it broken."""
    wanted = F.to_json(F.struct(
        F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("job_title"),
        F.array("p_brand", F.lit("  "), F.concat("p_type", F.lit(" ")), F.lit("x")).alias("locations")))
    written = F.when(F.col("p_partkey") % 7 == 0, F.lit("not json")).otherwise(wanted)
    intent = search.parse_intent(written)
    return table(spark, sf, "part").select(
        "p_partkey", intent.alias("intent")).select(
        "p_partkey", "intent.job_title", F.array_join("intent.locations", "|").alias("locations"),
        F.upper(search.requested_label(F.col("intent.locations"))).alias("requested"))


_KEYWORDS = ["the", "widget", "tion", "re", "the"]


def lexical_score(spark, sf):
    """Points of every document for one request; documents without any are dropped."""
    titles = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    docs = table(spark, sf, "documents").join(titles, "doc_id")
    forms = docs.select(
        "doc_id", matching.searchable(F.col("p_name")).alias("title"),
        matching.searchable_chunk(F.col("text")).alias("chunk"))
    score = matching.once(F.struct("title", "chunk"), lambda t: matching.lexical_score(
        t["title"], t["chunk"], F.lit(_TITLE), matching.literal_terms(_TITLE.split()),
        matching.literal_terms(_KEYWORDS)))
    kept = forms.select("doc_id", matching.scores_kept(score).alias("lexical_score"))
    return kept.filter("lexical_score IS NOT NULL").select(
        "doc_id", F.col("lexical_score").cast("bigint").alias("lexical_score"))


def avg_tie_rank(spark, sf):
    """Average-tie ranks of part sizes within each brand, both ways."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    up = average_rank(part, "p_size", ["p_brand"], True, "rank_up")
    both = average_rank(up, "p_size", ["p_brand"], False, "rank_down")
    return both.select("p_partkey", "rank_up", "rank_down")


def rrf(spark, sf):
    """Fusion of two global ranks of all parts."""
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    ranked = average_rank(average_rank(part, "p_retailprice", (), True, "r1"),
                          "p_size", (), False, "r2")
    return ranked.select("p_partkey", F.round(fused_score(F.col("r1"), F.col("r2")), 12).alias("rrf_score"))


def _searched(spark, sf):
    requests = search.prepare_requests(roles.requests(spark, sf))
    return requests, search.hybrid_search(requests, roles.search_documents(spark, sf))


def hybrid_search(spark, sf):
    """Every request against every vectorized document."""
    rows = _searched(spark, sf)[1].rows
    return rows.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "job_id", "job_title",
        F.round("vector_distance", 6).alias("vector_distance"),
        F.col("lexical_score").cast("bigint").alias("lexical_score"),
        "vector_rank", "lexical_rank", F.round("rrf_score", 12).alias("rrf_score"), "is_fallback")


def search_scopes(spark, sf):
    """Where each request had to look."""
    return _searched(spark, sf)[1].scopes.select("query_id", "requested_location", "is_fallback")


def rag_context(spark, sf):
    """Ranked results of every request as one context text."""
    return prompts.search_context(_searched(spark, sf)[1].rows)


def prompt_table(spark, sf):
    """Prompts of every request, continuing the conversation of the same number."""
    from careerlake.operators.history import last_turns

    requests, found = _searched(spark, sf)
    past = last_turns(roles.messages(spark, sf)).groupBy("conv_id").agg(F.array_sort(
        F.collect_list(F.struct("position", "role", "content"))).alias("past"))
    history = past.select(F.col("conv_id").alias("query_id"), F.transform(
        "past", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        .alias("history"))
    asked = requests.join(history, "query_id", "left")
    table_ = prompts.prompt_table(asked, found.rows, found.scopes, INTRODUCTION, RULES)
    return table_.select("query_id", F.array_join(F.transform(
        "messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("prompt"))


def embed_text(spark, sf):
    """The hashed vector of every document: places in use with their values, in ten-thousandths."""
    docs = embed_hashed(table(spark, sf, "documents").select("doc_id", "text"), "text")
    used = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e.x != 0)
    listed = F.transform(used, lambda e: F.concat_ws(":", e.i, F.round(e.x.cast("double") * 10000).cast("bigint")))
    return docs.select("doc_id", F.size("embedding").cast("bigint").alias("size"), F.array_join(listed, ",").alias("embedding"))


def letter_counts():
    """An encoder for checks: counts of five letters, padded to a short vector."""
    import numpy as np

    def encode(texts):
        return np.array([[t.count(letter) for letter in "aeiou"] for t in texts], dtype="float32")

    return encode


def embed_encoder(spark, sf):
    """Vectors from a pluggable encoder."""
    rows = embed_with(table(spark, sf, "documents").select("doc_id", "text"), "text", letter_counts)
    return rows.select("doc_id", *[F.col("embedding")[i].cast("bigint").alias(f"n{i}") for i in range(5)])


def embedded_requests(spark, sf):
    """Benchmark texts as requests without vectors: embedded like the documents, then searched."""
    def embed(df, column):
        return embed_with(df, column, letter_counts)

    docs = embed(table(spark, sf, "documents").select(
        F.col("doc_id").alias("job_id"), text.normalize(F.col("text")).alias("chunk")), "chunk")
    asked = search.prepare_requests(table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("user_query"),
        F.lit("").alias("cv_text"), F.lit("").alias("job_title"),
        F.array().cast("array<string>").alias("locations")), embed)
    return nearest(docs, asked, 5).select(
        "query_id", "job_id", F.col("rank").cast("bigint").alias("rank"),
        F.round("vector_distance", 6).alias("vector_distance"))


QUERIES = {
    "embedded_requests": embedded_requests,
    "vector_codec": vector_codec,
    "cosine_topk": cosine_topk,
    "cosine_topk_cells": cosine_topk_cells,
    "cosine_pairs": cosine_pairs,
    "vector_search": vector_search,
    "keyword_search": keyword_search,
    "keyword_table": keyword_table,
    "query_keywords": query_keywords,
    "intent_parse": intent_parse,
    "lexical_score": lexical_score,
    "avg_tie_rank": avg_tie_rank,
    "rrf": rrf,
    "hybrid_search": hybrid_search,
    "search_scopes": search_scopes,
    "rag_context": rag_context,
    "prompt_table": prompt_table,
    "embed_text": embed_text,
    "embed_encoder": embed_encoder,
}

# --- SQL --------------------------------------------------------------------------


def _padded(low: str) -> str:
    return f"' ' || regexp_replace({low}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g') || ' '"


def _mentions(low: str, padded: str, term: str) -> str:
    return (f"CASE WHEN length({term}) > 3 THEN contains({low}, {term}) "
            f"ELSE contains({padded}, ' ' || {term} || ' ') END")


_FORMS = f"""SELECT *, lower(job_title) AS tl, lower(company_name) AS ol,
    lower(replace(chunk_text, '_', ' ')) AS cl, {_padded('lower(job_title)')} AS tp,
    {_padded('lower(company_name)')} AS op, {_padded("lower(replace(chunk_text, '_', ' '))")} AS cp
    FROM docs"""


def _near(term: str) -> str:
    return " OR ".join(f"({_mentions(a, b, term)})" for a, b in (("cl", "cp"), ("ol", "op"), ("tl", "tp")))


def _score(wanted: str, words: str, keywords: str) -> str:
    return f"""CASE WHEN {wanted} = '' THEN 0 WHEN contains(tl, {wanted}) THEN 10000
        WHEN contains(cl, {wanted}) THEN 1000 ELSE 0 END
      + CASE WHEN len({words}) > 0 AND len(list_filter({words},
          lambda w: NOT ({_mentions('tl', 'tp', 'w')}))) = 0 THEN 5000 ELSE 0 END
      + CAST(coalesce(list_sum(list_transform({keywords}, lambda w:
          CASE WHEN {_mentions('tl', 'tp', 'w')} THEN 100
               WHEN {_mentions('cl', 'cp', 'w')} THEN 10 ELSE 0 END)), 0) AS BIGINT)"""


_STOP = "[" + ", ".join(f"'{w}'" for w in QUERY_STOP_WORDS) + "]"


def _keywords(query: str) -> str:
    split = f"list_filter(string_split_regex({query}, '\\s+'), lambda w: length(w) > 1)"
    stripped = f"list_transform({split}, lambda w: trim(w, ',.?!\"()'))"
    return f"list_filter({stripped}, lambda w: NOT list_contains({_STOP}, w))"


_SEARCH = {
    "forms": _FORMS,
    "asked": f"""SELECT *, list_filter(string_split(wanted, ' '), lambda w: w <> '') AS words,
        {_keywords('list_reduce(list_prepend(lower(user_query), places), lambda q, s: replace(q, s, chr(32)))')}
          AS keywords FROM requests""",
    "pairs": f"""SELECT query_id, job_id, len(places) > 0 AS placed,
        len(places) = 0 OR len(list_filter(places, lambda p: {_near('p')})) > 0 AS near,
        wanted <> '' AND len(list_filter(words, lambda w: NOT ({_mentions('tl', 'tp', 'w')}))) = 0
          AS titled,
        round(list_cosine_distance(embedding, wanted_vector), 12) AS d
        FROM asked, forms""",
    "scoped": """SELECT 'near' AS scope, * FROM pairs WHERE near
        UNION ALL SELECT 'wide', * FROM pairs WHERE placed""",
    "branches": """SELECT query_id, scope, job_id, d FROM (SELECT *, row_number() OVER (
            PARTITION BY query_id, scope ORDER BY d, job_id) AS r FROM scoped) WHERE r <= 300
        UNION ALL SELECT query_id, scope, job_id, 0.0 FROM (SELECT *, row_number() OVER (
            PARTITION BY query_id, scope ORDER BY job_id) AS r FROM scoped WHERE titled) WHERE r <= 300""",
    "merged": """SELECT query_id, scope, job_id, min(d) AS d FROM branches GROUP BY 1, 2, 3""",
    "kept": """SELECT *, scope = 'wide' AS is_fallback FROM merged m WHERE scope = 'near'
        OR NOT EXISTS (SELECT 1 FROM merged n WHERE n.query_id = m.query_id AND n.scope = 'near')""",
    "scored": f"""SELECT k.query_id, k.job_id, k.d, k.is_fallback, f.job_title, f.company_name,
        f.salary_text, f.job_url, f.chunk_text, a.wanted <> '' OR len(a.keywords) > 0 AS asks,
        {_score('a.wanted', 'a.words', 'a.keywords')} AS score
        FROM kept k JOIN asked a USING (query_id) JOIN forms f USING (job_id)""",
    "ranked": """SELECT *, rank() OVER (PARTITION BY query_id ORDER BY d)
          + (count(*) OVER (PARTITION BY query_id, d) - 1) / 2.0 AS vr,
        rank() OVER (PARTITION BY query_id ORDER BY score DESC)
          + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2.0 AS lr
        FROM scored WHERE score > 0 OR NOT asks""",
    "fused": """SELECT *, 1 / (60 + CAST(vr AS DOUBLE)) + 1 / (60 + CAST(lr AS DOUBLE)) AS rrf
        FROM ranked""",
    "best": """SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY query_id ORDER BY rrf DESC, job_id) AS rn FROM fused) WHERE rn <= 10""",
    "scopes": """SELECT query_id, array_to_string(places[1:2], ', ') AS requested_location,
        len(places) > 0 AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.query_id = a.query_id
          AND m.scope = 'near') AS is_fallback FROM asked a""",
    "context": """SELECT query_id, string_agg('- Tên Job: ' || job_title || ' | Công ty: '
          || company_name || ' | Lương: ' || coalesce(salary_text, 'None') || ' | Link: ' || job_url
          || ' | Chi tiết: ' || substr(replace(chunk_text, chr(10), ' '), 1, 800) || '...'
          || chr(10) || chr(10), '' ORDER BY rn) AS context FROM best GROUP BY query_id""",
}

# The public 32-bit hash of words, seed 42, in integer arithmetic (fixed values: its constants).
_M = "4294967296"


def _turned(x: str, by: int) -> str:
    return f"(({x}) * {1 << by} % {_M} + ({x}) // {1 << (32 - by)})"


def _mixed(k: str) -> str:
    return f"({_turned(f'(({k}) * 3432918353 % {_M})', 15)} * 461845907 % {_M})"


def _word_of(b: str, at: str, size: int) -> str:
    return "(" + " + ".join(f"{b}[{at} + {j + 1}] * {256 ** j}" for j in range(size)) + ")"


def _reduced(fours: str) -> str:
    step = f"({_turned('xor(h, k)', 13)} * 5 + 3864292196) % {_M}"
    return f"list_reduce(list_prepend(42::HUGEINT, list_transform({fours}, lambda k: {_mixed('k')})), lambda h, k: {step})"


def _closed(h: str) -> str:
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        h = f"(xor({h}, ({h}) // {1 << shift}) * {factor} % {_M})"
    return f"xor({h}, ({h}) // 65536)"


_KW_LITERAL = "[" + ", ".join(f"'{w}'" for w in _KEYWORDS) + "]"
_PLACE_FILTER = " OR ".join(f"({_near(chr(39) + p + chr(39))})" for p in _PLACES)
_TITLE_FILTER = " AND ".join(f"({_mentions('tl', 'tp', chr(39) + w + chr(39))})" for w in _TITLE.split())

ORACLE = {
    "vector_codec": """SELECT vec_id, len(embedding) AS dimension,
        round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings""",
    "embed_text": f"""WITH said AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS w
          FROM documents),
        bytes AS (SELECT w, list_transform(range(strlen(w)),
            lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INT), 2) AS HUGEINT)) AS b FROM (SELECT DISTINCT w FROM said)),
        cut AS (SELECT w, len(b) AS n, list_transform(range(len(b) // 4), lambda i: {_word_of('b', '4 * i', 4)}) AS fours,
            coalesce(list_sum(list_transform(range(len(b) % 4), lambda j: b[len(b) // 4 * 4 + j + 1] * (1 << (8 * j)))), 0)::HUGEINT AS rest
          FROM bytes),
        mixed AS (SELECT w, n, xor({_reduced('fours')}, CASE WHEN n % 4 > 0 THEN {_mixed('rest')} ELSE 0 END) AS h FROM cut),
        closed AS (SELECT w, {_closed('xor(h, n::HUGEINT)')} AS h FROM mixed),
        places AS (SELECT w, ((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 384 + 384) % 384 AS i FROM closed),
        counted AS (SELECT doc_id, CAST(i AS INT) AS i, count(*) AS n FROM said JOIN places USING (w) GROUP BY 1, 2),
        scaled AS (SELECT doc_id, i, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS x FROM counted),
        lists AS (SELECT doc_id, string_agg(i || ':' || CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT), ',' ORDER BY i) AS e
          FROM scaled GROUP BY 1)
        SELECT doc_id, CAST(384 AS BIGINT) AS size, coalesce(e, '') AS embedding FROM documents LEFT JOIN lists USING (doc_id)""",
    "embedded_requests": f"""WITH counted AS (
          SELECT doc_id AS id, 'd' AS kind, {sql_normalize('text')} AS t FROM documents
          UNION ALL SELECT item_id, 'q', {sql_normalize("' ' || text")} FROM benchmark),
        vectors AS (SELECT id, kind, list_transform(['a', 'e', 'i', 'o', 'u'],
          lambda c: CAST(length(t) - length(replace(t, c, '')) AS DOUBLE)) AS v FROM counted)
        SELECT query_id, job_id, r AS rank, round(d, 6) AS vector_distance FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d NULLS LAST, job_id) AS r FROM (
            SELECT q.id AS query_id, d.id AS job_id, CASE WHEN list_sum(d.v) > 0 THEN
              round(list_cosine_distance(d.v, q.v), 12) END AS d
            FROM vectors q JOIN vectors d ON q.kind = 'q' AND d.kind = 'd')) WHERE r <= 5""",
    "cosine_topk": with_search("""SELECT query_id, job_id, r AS rank, round(d, 6) AS vector_distance
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, job_id) AS r FROM (
          SELECT CAST(c.label AS BIGINT) AS query_id, vec_id AS job_id,
            round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), c.embedding), 12) AS d
          FROM embeddings e, centroids c)) WHERE r <= 300"""),
    "cosine_pairs": with_search("""SELECT vec_id, round(list_cosine_distance(
        CAST(e.embedding AS DOUBLE[]), c.embedding), 6) AS vector_distance
        FROM embeddings e JOIN centroids c USING (label)"""),
    "vector_search": with_search(f"""SELECT job_id, job_title, round(list_cosine_distance(embedding,
          list_transform(range({_DIMENSION}), lambda i: 1.0::DOUBLE)), 6) AS vector_distance
        FROM forms WHERE {_PLACE_FILTER}
        ORDER BY list_cosine_distance(embedding,
          list_transform(range({_DIMENSION}), lambda i: 1.0::DOUBLE)), job_id LIMIT 300""",
        {"forms": _FORMS}),
    "keyword_search": with_search(f"""SELECT job_id, job_title, 0.0::DOUBLE AS vector_distance
        FROM forms WHERE ({_PLACE_FILTER}) AND {_TITLE_FILTER} ORDER BY job_id LIMIT 300""",
        {"forms": _FORMS}),
    "keyword_table": with_search(f"""SELECT query_id, job_id,
          row_number() OVER (PARTITION BY query_id ORDER BY job_id) AS rank
        FROM asked_titles, forms
        WHERE len(list_filter(words, lambda w: NOT ({_mentions('tl', 'tp', 'w')}))) = 0
          AND (len(places) = 0 OR len(list_filter(places, lambda p: {_near('p')})) > 0)
        QUALIFY rank <= 300""",
        {"forms": _FORMS, "asked_titles": """SELECT p_partkey AS query_id,
          list_filter(string_split(lower(p_name), ' '), lambda w: w <> '') AS words,
          CASE p_partkey % 4 WHEN 1 THEN [lower(split_part(p_name, ' ', 1))] WHEN 2 THEN ['the', 'small']
            WHEN 3 THEN ['nowhere land', 'nll'] ELSE CAST([] AS VARCHAR[]) END AS places FROM part"""}),
    "query_keywords": f"""SELECT conv_id, turn,
        array_to_string({_keywords("replace(lower(text), 'the', ' ')")}, '|') AS keywords,
        'red widget ' || text || CASE WHEN text = '' THEN '' ELSE ' ' ||
          trim(regexp_replace(substr(text, 1, 500), '\\s+', ' ', 'g')) END AS search_text
        FROM conversations WHERE role = 'user'""",
    "intent_parse": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE lower(p_name) END
          AS job_title,
        CASE WHEN p_partkey % 7 = 0 THEN '' ELSE lower(p_brand || '|' || p_type) || '|x' END AS locations,
        CASE WHEN p_partkey % 7 = 0 THEN '' ELSE upper(p_brand || ', ' || p_type) END AS requested
        FROM part""",
    "lexical_score": f"""SELECT doc_id, score AS lexical_score FROM (
        SELECT doc_id, {_score(f"'{_TITLE}'", f"string_split('{_TITLE}', ' ')", _KW_LITERAL)} AS score
        FROM (SELECT doc_id, lower(p_name) AS tl, {_padded('lower(p_name)')} AS tp,
            lower(replace(text, '_', ' ')) AS cl, {_padded("lower(replace(text, '_', ' '))")} AS cp
          FROM documents JOIN part ON p_partkey = doc_id)) WHERE score > 0""",
    "avg_tie_rank": """SELECT p_partkey,
        CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size)
          + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS DOUBLE) AS rank_up,
        CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC)
          + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS DOUBLE) AS rank_down FROM part""",
    "rrf": """SELECT p_partkey, round(1 / (60 + CAST(r1 AS DOUBLE)) + 1 / (60 + CAST(r2 AS DOUBLE)), 12)
          AS rrf_score FROM (SELECT p_partkey,
            rank() OVER (ORDER BY p_retailprice)
              + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS r1,
            rank() OVER (ORDER BY p_size DESC)
              + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS r2 FROM part)""",
    "hybrid_search": with_search("""SELECT query_id, rn AS rank, job_id, job_title,
        round(d, 6) AS vector_distance, CAST(score AS BIGINT) AS lexical_score,
        CAST(vr AS DOUBLE) AS vector_rank, CAST(lr AS DOUBLE) AS lexical_rank,
        round(rrf, 12) AS rrf_score, is_fallback FROM best""", _SEARCH),
    "search_scopes": with_search("SELECT * FROM scopes", _SEARCH),
    "rag_context": with_search("SELECT * FROM context", _SEARCH),
    "prompt_table": with_search(f"""SELECT a.query_id, 'system: {INTRODUCTION}' || chr(10)
          || '[DỮ LIỆU TỪ HỆ THỐNG]:' || chr(10) || coalesce(context, 'Trống.') || chr(10)
          || CASE WHEN s.is_fallback THEN chr(10) || '⚠️ LỖI: HIỆN KHÔNG CÓ CÔNG VIỆC TẠI ('
               || upper(requested_location) || '). Các công việc ở trên nằm ở khu vực KHÁC.' || chr(10)
             ELSE '' END
          || '{RULES.replace(chr(10), "' || chr(10) || '")}' || chr(10)
          || coalesce(past || chr(10), '') || 'user: ' || user_query AS prompt
        FROM asked a LEFT JOIN context USING (query_id) JOIN scopes s USING (query_id)
        LEFT JOIN (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS past
          FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
                FROM conversations) WHERE r <= 6 GROUP BY conv_id) ON conv_id = a.query_id""", _SEARCH),
    "embed_encoder": "SELECT doc_id, " + ", ".join(
        f"CAST(length(text) - length(replace(text, '{c}', '')) AS BIGINT) AS n{i}"
        for i, c in enumerate("aeiou")) + " FROM documents",
}

ORACLE["cosine_topk_cells"] = ORACLE["cosine_topk"]
