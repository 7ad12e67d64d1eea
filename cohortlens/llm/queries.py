"""Registered queries of the training-data operators; the thin contract views over the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_packing, chat_prefix, cover_tree_codes, decontaminate, html_article, line_dedup, quality_forest, simhash_popcount, spherical_cells, token_output, tokenizer_alignment, toxicity_grammar, warc_fixity
from .common import held_out, materialize, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity_grammar.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity_grammar.score(docs, model, spans=False)
    return scored.withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted", *(f"n_{k}" for k in toxicity_grammar.KINDS))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as WARC replicas; the second has some records with another last byte, and each lacks some of the other's."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    own = warc_fixity.record_bytes(F.col("url"), F.col("html"))
    rotten = F.when(F.pmod("page_id", F.lit(97)) == 13, F.concat(F.substring(own, 1, F.octet_length(own) - 1), F.encode(F.lit("X"), "UTF-8"))).otherwise(own)
    here = warc_fixity.records(pages).filter("page_id is null or page_id % 401 <> 5")
    there = warc_fixity.records(pages, rotten).filter("page_id is null or page_id % 389 <> 7")
    return warc_fixity.audit(warc_fixity.tree(here), warc_fixity.tree(there))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_article.extract(read(spark, sf_dir, "pages"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_prefix.digest(chat_prefix.examples(turns.unionByName(chat_prefix.control_conversation(spark))))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents"), share=line_dedup.EDIT_SHARE).select("doc_id", "text", "n_lines", "n_kept")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.packed_documents(read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_popcount.near_duplicates(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), least=1)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_output.write_tokens(read(spark, sf_dir, "documents"), token_output.token_folder(spark))
    read_back = materialize(token_output.digests(token_output.read_tokens(spark, folder)), "token-digests")
    return token_output.with_starts(read_back).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_forest.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "anomaly", F.array(*map(F.lit, quality_forest.CAUSES))[F.col("cause")].alias("cause"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment.aligned_scores(read(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical_cells.near_duplicates(read(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree_codes.codes(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_html_extraction": op3_html_extraction,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_line_dedup": op5_line_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_token_output": op9_token_output,
    "op10_quality_rules": op10_quality_rules,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_vector_codes": op13_vector_codes,
}
# op 4: turns and loss text straight from the table; the formatted length follows from the template's marks.
_OP4 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(17 + length(regexp_replace(replace(role, '\', '\\'), '(<)(/?s>|</?SYS>>)|(\[)(/?INST\])', '\0#', 'g'))
           + length(regexp_replace(replace(text, '\', '\\'), '(<)(/?s>|</?SYS>>)|(\[)(/?INST\])', '\0#', 'g'))) OVER w AS chars
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars) FILTER (WHERE role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM numbered GROUP BY conv_id
"""

# op 2: records straight from the table, compared one by one.
_OP2 = """
WITH made AS (
  SELECT page_id, coalesce(page_id // 1024, -1) AS segment,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) ||
    'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) ||
    chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) AS body FROM pages),
placed AS (
  SELECT page_id, segment, strlen(body) + 1 AS len, sha256(body || chr(10)) AS a,
    CASE WHEN page_id % 97 = 13 THEN sha256(body || 'X') ELSE sha256(body || chr(10)) END AS b,
    sum(strlen(body) + 1) OVER (PARTITION BY segment ORDER BY page_id, sha256(body || chr(10)) ROWS UNBOUNDED PRECEDING) - strlen(body) - 1 AS pos
  FROM made),
sides AS (
  SELECT *, page_id IS NULL OR page_id % 401 <> 5 AS here, page_id IS NULL OR page_id % 389 <> 7 AS there FROM placed)
SELECT segment::BIGINT AS segment, pos::BIGINT AS "offset", page_id,
  CASE WHEN NOT there THEN 'missing' WHEN NOT here THEN 'additional' ELSE 'corrupt' END AS status,
  CASE WHEN here THEN len END::BIGINT AS first_length, CASE WHEN there THEN len END::BIGINT AS second_length,
  CASE WHEN here THEN a END AS first_digest, CASE WHEN there THEN b END AS second_digest
FROM sides WHERE (here OR there) AND (here <> there OR a <> b)
"""



def _op13(rounds: int) -> str:
    """Every part against every entry in every round, in whole numbers."""
    made = ["""
kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label, [floor(x::DOUBLE * 1024)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) t(p)),
c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY n) - 1 AS j, x AS c
  FROM parts JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS n FROM kept) USING (rid) WHERE n <= 256)"""]
    for k in range(rounds + 1):
        made.append(f"""
a{k} AS MATERIALIZED (
  SELECT rid, p, any_value(x) AS x, min((list_dot_product(x::DOUBLE[], x::DOUBLE[]) + list_dot_product(c::DOUBLE[], c::DOUBLE[])
    - 2 * list_dot_product(x::DOUBLE[], c::DOUBLE[]))::BIGINT * 256 + j) AS best
  FROM parts JOIN c{k} USING (p) GROUP BY rid, p)""")
        if k < rounds:
            made.append(f"""
s{k} AS (
  SELECT p, j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
    SELECT p, best % 256 AS j, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 4097) t(i) WHERE i <= len(x) GROUP BY ALL) GROUP BY p, j),
c{k + 1} AS MATERIALIZED (SELECT p, j, coalesce(s.c, b.c) AS c FROM c{k} b LEFT JOIN s{k} s USING (p, j))""")
    return "WITH " + ",".join(made) + f""",
coded AS (SELECT rid, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (rid)
"""


# op 12: every pair of vectors, then reachability.
_OP12 = """
WITH RECURSIVE kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x,
    embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0 AND len([c FOR c IN embedding IF c <> 0]) > 0 AS usable FROM embeddings),
scaled AS MATERIALIZED (SELECT rid, x, sqrt(list_dot_product(x, x)) AS norm FROM kept WHERE usable),
links AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM scaled a JOIN scaled b ON a.rid <> b.rid AND len(a.x) = len(b.x)
  AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95),
reached AS (SELECT rid AS a, rid AS b FROM kept UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
named AS (SELECT r.a AS rid, min(k.vec_id) AS component_id FROM reached r JOIN kept k ON k.rid = r.b GROUP BY r.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = rid) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM kept JOIN named USING (rid)
"""

ORACLE: dict[str, str] = {"op2_warc_fixity": _OP2, "op4_chat_formatting": _OP4, "op12_embedding_near_dedup": _OP12, "op13_vector_codes": _op13(cover_tree_codes.ROUNDS)}
