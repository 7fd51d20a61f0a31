"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghawk.llm.decontaminate import contaminated_pairs
from loghawk.llm import quality_rules
from loghawk.llm import chat_format, fill_middle, kneser_ney, mixing, phrases, secret_scan, warc
from loghawk.llm.html_render import html_text
from loghawk.llm.simhash import simhash_groups
from loghawk.llm.substring_dedup import substring_dedup
from loghawk.llm.suffix_dedup import suffix_dedup
from loghawk.session import ensure_checkpoint_dir, scratch_path, ship_package
from loghawk.sources.tables import read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return read_table(spark, sf_dir, name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(_table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled of good quality and not toxic."""
    return _table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.quality_report(docs, quality_rules.fit_distinct(docs, trusted_ids(spark, sf_dir)))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents")).drop("found")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(part == 2, F.lit(False)).alias("held_out"))
    model = kneser_ney.fit(docs.where("NOT held_out"))
    return kneser_ney.score(docs, model, flag_col="held_out")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixing.by_position(plan).select("doc_id", "size", "source_size", "target", "taken", "first_position")


#: A conversation whose texts hold marks that templates use.
CONTROL_CONV, CONTROL_TEXT = -7, r"\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(CONTROL_CONV, 0, "user", CONTROL_TEXT), (CONTROL_CONV, 1, "assistant", CONTROL_TEXT)],
                                    rows.schema)
    rows = rows.unionByName(control)
    return chat_format.read_back(chat_format.format_turns(rows, chat_format.text_part(F.col("text"))))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents")).drop("k")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = _table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    warc.write_warc(pages, folder)
    return warc.read_warc(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                               "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_secret_scans": op7_secret_scans,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_source_mixing": op9_source_mixing,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_warc": op13_warc,
}

ORACLE: dict[str, str] = {}
ORACLE["op3_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13
), keyed AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM win
), seen AS (
  SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM seen WHERE gone
), cut AS (
  SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE
         [x[1] FOR x IN list_zip(ws, range(1, len(ws) + 1)) IF NOT list_contains(ps, x[2])] END, ' ')) AS kept_sha256
FROM w LEFT JOIN cut ON w.doc_id = cut.doc_id
"""

ORACLE["op10_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(15 + length(role) + length(text)
         + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), chr(10), ''))
         + length(text) - length(replace(replace(text, '\', ''), '<', ''))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLE["op11_phrase_mining"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), places AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM places, range(1, 6) AS t(k) WHERE i + k - 1 <= len(ws)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), size AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k >= 2 AND f >= 100
), cut AS (
  SELECT lang, phrase, a, ws, unnest(range(1, k)) AS cut_at FROM c
), scored AS (
  SELECT cut.lang, cut.phrase, a, cut_at, l.f AS l, r.f AS r, n,
         (1000::HUGEINT * a::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = array_to_string(ws[1:cut_at], ' ')
  JOIN f AS r ON r.lang = cut.lang AND r.phrase = array_to_string(ws[cut_at + 1:], ' ') JOIN size ON size.lang = cut.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1
), inside AS (
  SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, ws, a, k, unnest(range(1, k)) AS i FROM c), range(2, 6) AS t(j)
  WHERE j > i AND j <= k AND j - i + 1 < k GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase
  WHERE longer IS NULL OR 100 * longer < 100 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

ORACLE["op12_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), e AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), f AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100
              THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e
), g AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
         array_to_string(u[b + 1:], '') AS s FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g
"""

ORACLE["op13_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), b AS (
  SELECT page_id, first, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
         array_to_string([lpad(bin(CAST('0x' || c AS INTEGER)), 4, '0') FOR c IN string_split(sha1(t), '')], '') AS bits FROM p
)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST('0b' || substr(bits, 5 * i + 1, 5) AS INTEGER), 1)
                        FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
