"""The registered queries of this folder and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.llm import byte_bpe, chat, classifier, decontaminate, jaccard, lexical, license_scan, negatives, packing, quality_rules, simhash, token_files, url_filter
from chunkloom.llm.common import table
from chunkloom.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_packing(spark, sf_dir):
    pieces = packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packing.checksums(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "crosses")


@query
def op4_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tokens = written(packing.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2), "tokens", compression="zstd")
    path = token_files.token_file_path(spark)
    token_files.write_token_files(tokens, path)
    return packing.checksums(token_files.read_token_files(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op3_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    both = byte_bpe.decoded(tokens, path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


URL_RULES = [
    url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"),
]


@query
def op8_url_filter(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES)


ORACLE["op8_url_filter"] = f"""
WITH rests AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWERED}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
), rules(verdict, host, path) AS (VALUES {', '.join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
judged AS (
    SELECT p.page_id, p.host, p.path,
        (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r
            WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
        (SELECT arg_max(r.verdict, length(r.host || r.path)) FROM rules r
            WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS ruled,
        list_has_any(string_split_regex(p.host, '[.-]'), {list(url_filter.BLOCKED_WORDS)!r}) AS listed_word
    FROM parts p
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed_word THEN 'block' ELSE 'allow' END) AS verdict, listed_word FROM judged
"""


@query
def op6_license_scan(spark, sf_dir):
    return license_scan.scanned(table(spark, sf_dir, "documents")).drop("detections")


@query
def op7_quality_rules(spark, sf_dir):
    counts = written(quality_rules.measured(table(spark, sf_dir, "documents")), "quality-counts")
    cutoffs = quality_rules.choose_cutoffs(counts, table(spark, sf_dir, "labels"))
    return quality_rules.judged(counts, cutoffs).select("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept")


@query
def op2_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classifier.scored(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


@query
def op9_simhash(spark, sf_dir):
    rows = written(simhash.compared(table(spark, sf_dir, "documents")), "fingerprints")
    return simhash.with_near_counts(rows).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")


@query
def op10_jaccard_join(spark, sf_dir):
    return jaccard.joined(table(spark, sf_dir, "documents"))


@query
def op5_chat_tree(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    nodes, members = chat.formatted(turns.union(added.select("conv_id", F.col("turn").cast(turns.schema["turn"].dataType), "role", "text")))
    return chat.read_back(written(nodes, "chat-tree"), members)


ORACLE["op10_jaccard_join"] = f"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWERED}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM texts
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM sets x JOIN sets y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
degrees AS (SELECT a AS doc_id, count(*) AS n_links FROM ends GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM documents JOIN lowest USING (doc_id) LEFT JOIN sizes USING (doc_id) LEFT JOIN degrees USING (doc_id)
"""


@query
def op11_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated", F.size("spans").cast("long").alias("n_spans"))


#: Words of a text in SQL: letters, digits and characters beyond ASCII, A-Z lowered.
SQL_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWERED}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE["op11_decontaminate"] = f"""
WITH texts AS (SELECT doc_id, {SQL_TERMS} AS w FROM documents),
item_words AS (SELECT item_id, {SQL_TERMS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS width, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i : i + 9], ' '))) AS pattern
    FROM item_words WHERE len(w) > 0
), widths AS (SELECT DISTINCT width FROM windows),
starts AS (SELECT doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS i FROM texts, widths),
places AS (SELECT doc_id, width, i, array_to_string(w[i : i + width - 1], ' ') AS pattern FROM starts),
hits AS (SELECT doc_id, width, i, item_id FROM places JOIN windows USING (width, pattern)),
hit_words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + width)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id),
firsts AS (
    SELECT doc_id, j, max(e) OVER (PARTITION BY doc_id ORDER BY j, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM (SELECT DISTINCT doc_id, i AS j, i + width AS e FROM hits)
), spans AS (SELECT doc_id, count(*) AS n FROM firsts WHERE before IS NULL OR j > before GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
    coalesce(h.n, 0) > 0 AS contaminated, coalesce(s.n, 0) AS n_spans
FROM texts LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id) LEFT JOIN spans s USING (doc_id)
"""


@query
def op12_lexical_search(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op12_lexical_search"] = f"""
WITH texts AS (SELECT row_number() OVER () AS place, doc_id, {SQL_TERMS} AS w FROM documents),
said AS (SELECT place, doc_id, len(w)::BIGINT AS n FROM texts WHERE len(w) > 0),
sums AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS total FROM said),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({SQL_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
counted AS (
    SELECT place, term, count(*)::BIGINT AS tf FROM (SELECT place, unnest(w) AS term FROM texts)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weights AS (
    SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
    FROM (SELECT term, count(*)::BIGINT AS df FROM counted GROUP BY term), sums
),
parts AS (
    SELECT place, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * documents) // total))) AS part
    FROM counted JOIN said USING (place) JOIN weights USING (term), sums
),
scored AS (
    SELECT item_id, doc_id, place, sum(times * part)::BIGINT AS score FROM asked JOIN parts USING (term) JOIN said USING (place)
    WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, place
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""


@query
def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    rows = written(negatives.quantised(table(spark, sf_dir, "embeddings").select("vec_id", label, "embedding")), "quantised")
    return negatives.mined(rows, rows.where(F.col("vec_id") % 100 == 0))


ORACLE["op13_hard_negatives"] = """
WITH vectors AS (
    SELECT row_number() OVER () AS place, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.place AS anchor, a.vec_id AS anchor_id, r.place, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0
), positives AS (
    SELECT anchor, anchor_id, place AS positive, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s USING (anchor) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
