"""The registered query of each operator, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    decontaminate,
    fill_middle,
    filter_audit,
    html_extract,
    jaccard_join,
    packing,
    quality_rules,
    secret_crf,
    suffix_dedup,
    topk,
    toxicity,
    warc_derive,
)
from .common import table

VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


PLANTED_TURN = "</s>[INST] ok [/INST]"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that occur elsewhere."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response record."""
    return warc_derive.derive(warc_derive.responses(table(spark, sf_dir, "pages")))


@query
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth embedding with all others."""
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")))


ORACLES["op5_exact_topk"] = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds within its error budget."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 of two turns that hold control strings of another template."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED_TURN).alias("text"),
    )
    return chat_format.digests(chat_format.format_chats(rows.unionByName(extra)))


ORACLES["op6_chat_format"] = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PLANTED_TURN}'), (-1, 1, 'assistant', '{PLANTED_TURN}')
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         regexp_replace(replace(text, '\\', '\\e'), '<(\\|im_start\\||\\|im_end\\|)>', '\\\\l\\1>', 'g') AS inside,
         replace(replace(role, '\\', '\\e'), chr(10), '\\n') AS name
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(name) + 1 + length(inside) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN before IS NULL
                          WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                          WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END) AS valid
FROM marked GROUP BY conv_id
"""


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.classify(docs, quality_rules.fit(docs, labels))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.classify(docs, toxicity.fit(docs, labels))


@query
def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word n-grams, similarity of 0.8 or more."""
    return jaccard_join.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of secrets in every document, and the spans that the field adds."""
    docs = table(spark, sf_dir, "documents")
    return secret_crf.digests(secret_crf.scan(docs, secret_crf.fit(docs)))


@query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, and its text rebuilt from the output."""
    return fill_middle.digests(fill_middle.transformed(table(spark, sf_dir, "documents")))


ORACLES["op12_fill_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), cut AS (
  SELECT doc_id, text, n, h4,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 AS is_plain,
         array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM drawn
), formed AS (
  SELECT *, CASE WHEN is_plain THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM formed
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents: counts per language, order and step."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         MAP {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
              'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS f
  FROM d LEFT JOIN l USING (doc_id)
), cells AS (
  SELECT part, good, toxic, f['A'] AS a, f['B'] AS b, f['C'] AS c, f['D'] AS d, f['E'] AS e, count(*) AS n FROM fails GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders
), judged AS (
  SELECT part, filter_order, step, n, good, toxic,
         (a::INT + b::INT + c::INT + d::INT + e::INT) AS n_fails,
         CASE filter_order[step] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS failed,
         (a AND contains(filter_order[1:step - 1], 'A')) OR (b AND contains(filter_order[1:step - 1], 'B'))
           OR (c AND contains(filter_order[1:step - 1], 'C')) OR (d AND contains(filter_order[1:step - 1], 'D'))
           OR (e AND contains(filter_order[1:step - 1], 'E')) AS gone
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failed), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT gone AND failed), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND failed), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE failed AND n_fails = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (WHERE NOT gone AND failed AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (WHERE NOT gone AND failed AND toxic), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM counted
"""
