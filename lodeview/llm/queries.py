"""One query per operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, html_text, mixing, near, packing, quality, substring, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level vocabulary, wherever it is installed."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(_table(spark, sf_dir, "documents"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(_table(spark, sf_dir, "pages"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(_table(spark, sf_dir, "pages"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op5_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.report(turns.unionByName(probe))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(_table(spark, sf_dir, "documents"))


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(_table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.verdict("base")).alias("base_failed"), quality.verdict("v1").alias("kept"), "failed",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_pack_sequences, op3_near_dedup, op4_warc_archive, op5_format_chats, op6_main_text, op7_exact_dedup, op8_quality_ledger, op9_toxicity, op10_substring_dedup)}

_SPACES = r"[\x20\x09-\x0D]+"
_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": rf"""
        WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size,
                             ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
        src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
        wts AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM src),
        lev AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                           - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                          / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wts),
        tgt AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM lev),
        rep AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM tgt),
        bud AS (SELECT *, target - repeats * source_size AS budget FROM rep),
        grp AS (SELECT b.source, b.h, sum(b.size) AS n FROM base b GROUP BY b.source, b.h),
        run AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM grp),
        edge AS (SELECT r.source, min(r.h) AS hb, arg_min(r.upto, r.h) AS upto, arg_min(r.n, r.h) AS n FROM run r JOIN bud u ON r.source IS NOT DISTINCT FROM u.source
                 WHERE u.budget > 0 AND r.upto > u.budget GROUP BY r.source),
        thr AS (SELECT u.*, CASE WHEN e.hb IS NULL THEN 0 WHEN e.upto - u.budget < u.budget - (e.upto - e.n) THEN e.hb + 1 ELSE e.hb END AS threshold
                FROM bud u LEFT JOIN edge e ON u.source IS NOT DISTINCT FROM e.source)
        SELECT b.doc_id, b.size, t.source_size, t.target, (b.size * (t.repeats + CASE WHEN b.h < t.threshold THEN 1 ELSE 0 END))::BIGINT AS taken,
               b.source, (t.repeats + CASE WHEN b.h < t.threshold THEN 1 ELSE 0 END)::BIGINT AS copies
        FROM base b JOIN thr t ON b.source IS NOT DISTINCT FROM t.source""",
    "op4_warc_archive": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS lead FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to FROM m""",
    "op5_format_chats": r"""
        WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
                   SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS escaped FROM t),
        m AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS fresh, row_number() OVER w AS rn FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(escaped) + CASE WHEN fresh THEN 12 + length(role) + 1 + 11 ELSE 10 END)::BIGINT AS formatted_chars
        FROM m GROUP BY conv_id""",
    "op7_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op8_quality_ledger": rf"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, regexp_extract_all(text, '{_WORDS}') AS ws FROM d),
        tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        rep AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
        cov AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
        lin AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORDS}')),
        dup AS (SELECT r, count(*) AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lin GROUP BY r),
        m AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, list_sum(list_transform(w.ws, lambda x: length(x)))::BIGINT AS word_chars,
                     length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n_dup_lines, 0) AS n_dup_lines,
                     coalesce(cov.n_repeat_words, 0) AS n_repeat_words, coalesce(dup.n_lines, 0) AS n_lines,
                     len(list_filter(w.ws, lambda x: regexp_matches(x, '[A-Z].*[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_upper_words
              FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
        f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (4 * n_symbols > n_words)::BIGINT
                     + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines)::BIGINT
                     + 16 * (n_words > 0 AND (coalesce(word_chars, 0) < 2 * n_words OR coalesce(word_chars, 0) > 14 * n_words))::BIGINT
                     + 32 * (100 * n_upper_words > 50 * n_words)::BIGINT)::BIGINT AS failed FROM m)
        SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept, failed FROM f""",
    "op10_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
        bad AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
        wrd AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
        lab AS (SELECT w.doc_id, w.i, w.w, max(b.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
                FROM wrd w LEFT JOIN bad b ON w.doc_id = b.doc_id AND w.i = b.i),
        agg AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM lab GROUP BY doc_id)
        SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN agg USING (doc_id)""",
}
