"""The queries of this subpackage, with production parameters, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, cascade, chat, jaccard, lm, mixing, nbsvm, packing, substrings, warc
from ._spark import materialise, table, word_count


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = cascade.quality_cascade(docs, outputs=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), required=cascade.too_short_or_repetitive)
    failed = (F.col("rejected_by") == "required").eqNullSafe(F.lit(True))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key")), "sizes")
    return mixing.mix_sources(sizes, "source", "size", "key").drop("source", "key")


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_texts(docs, crc_of_id("doc_id") % 7 != 2).select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def crc_of_id(id: str):
    """crc32 of the id as text; 0 for a null id."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))


def op9_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"), crc_of_id("doc_id") % 5 != 0)
    return nbsvm.classify(docs, model).select("doc_id", (crc_of_id("doc_id") % 5 == 0).alias("held_out"), "score", "predicted")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    read = chat.read_chats(chat.format_chats(rows.unionByName(own)))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_quality_rules, op4_mixing, op5_multi_index_hashing, op6_warc, op7_lm_scoring, op8_jaccard_join, op9_nb_svm, op10_chat_formatting)}

ORACLES = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
hit AS (SELECT r, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + o AS i FROM hit, (SELECT unnest(generate_series(0, 34)) AS o)),
word AS (SELECT doc_id, r, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op3_quality_rules": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT r, doc_id, len(w) AS n, length(array_to_string(w, '')) AS chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS sym,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) AS stutters,
  len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS bare FROM d),
g AS (SELECT r, i, s, md5(array_to_string(w[i:i + s - 1], ' ')) AS k FROM (SELECT r, w, s, unnest(generate_series(1, len(w) - s + 1)) AS i FROM d, (SELECT unnest([2, 3, 8]) AS s) WHERE len(w) >= s)),
often AS (SELECT r, s, k, count(*) AS n FROM g GROUP BY r, s, k),
top AS (SELECT r, max(n) AS pair FROM often WHERE s = 2 GROUP BY r),
cover AS (SELECT r, s, count(DISTINCT i + o) AS rep FROM (SELECT r, s, i, unnest(generate_series(0, s - 1)) AS o FROM g JOIN often USING (r, s, k) WHERE n > 1 AND s > 2) GROUP BY r, s),
m AS (SELECT c.*, coalesce(x.rep, 0) AS rep, coalesce(y.rep, 0) AS far, coalesce(pair, 0) AS pair, len(lines) - len(list_distinct(lines)) AS dup, len(lines) AS n_lines
  FROM c LEFT JOIN cover x ON x.r = c.r AND x.s = 3 LEFT JOIN cover y ON y.r = c.r AND y.s = 8 LEFT JOIN top ON top.r = c.r)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, sym::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words,
  n < 50 OR 100 * rep > 50 * n AS base_failed,
  NOT (n < 50 OR 100 * rep > 30 * n OR 100 * sym > 10 * n OR 100 * dup > 30 * n_lines OR 100 * stutters > 20 * n OR 100 * chars > 1500 * n
    OR 100 * bare > 40 * n OR 100 * pair > 20 * n OR 100 * far > 30 * n) AS kept FROM m""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(d, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM q""",
    "op8_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id""",
    "op10_chat_formatting": """
WITH t AS (
  SELECT conv_id::BIGINT conv_id, turn::BIGINT turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w AS i, lag(r) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (r = 'assistant'), '')) AS loss_sha256,
  (7 + sum(length(replace(x, '<', '<~')) + CASE WHEN before = r THEN 8 ELSE 16 + length(replace(r, '<', '<~')) + CASE WHEN i = 1 THEN 0 ELSE 7 END END))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id""",
}
