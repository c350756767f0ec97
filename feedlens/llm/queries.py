"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import (
    chat, decontaminate, language, licenses, line_dedup, merkle, mixing, near_dedup, pii, quality, secrets, substring_dedup, vector_codes
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.formatted(chat.with_probe(_table(spark, sf_dir, "conversations"), spark)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op7_chat_formatting, op10_quality_rules)}

ORACLES["op7_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
      ELSE '\r' || replace(replace(replace(replace(role, '\', '\s'), '#', '\h'), '</turn>', '\t'), ':', '\c') END AS shown,
    replace(replace(replace(text, '\', '\s'), '#', '\h'), '</turn>', '\t') AS kept,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    lead(role, 1, 'end') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS after
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown) + length(kept) + 15)::BIGINT AS formatted_chars,
  bool_and((before || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')
    AND (after <> 'end' OR role = 'assistant')) AS valid
FROM marked GROUP BY conv_id
"""

_STOPS = ", ".join(f"'{x}'" for x in dict.fromkeys(quality.STOP_WORDS.split()))
ORACLES["op10_quality_rules"] = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), found AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM windows
), hit AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM found, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id
), counts AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words
  FROM split s LEFT JOIN hit h ON h.doc_id = s.doc_id
), judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, concat_ws(',',
    CASE WHEN n_words < 50 THEN 'few_words' END, CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated_windows' END,
    CASE WHEN 100 * word_chars < 250 * n_words OR 100 * word_chars > 1500 * n_words THEN 'short_or_long_words' END,
    CASE WHEN 100 * n_symbols > 20 * n_words THEN 'symbols' END, CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 'repeated_lines' END,
    CASE WHEN 100 * n_stop_words < 2 * n_words THEN 'stop_words' END) AS broken
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND broken = '') AS kept,
  n_lines, n_stop_words, broken FROM judged
"""


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op9_minhash_near_dedup"] = op9_minhash_near_dedup


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


QUERIES["op8_substring_dedup"] = op8_substring_dedup


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secret_spans(_table(spark, sf_dir, "documents")))


QUERIES |= {f.__name__: f for f in (op2_benchmark_decontamination, op4_secret_scans)}


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES["op6_line_dedup"] = op6_line_dedup


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    shares = [F.round(F.get("p", F.lit(k)), 6).alias(f"p_{name}") for k, name in enumerate(mixing.DOMAINS)]
    return out.select("doc_id", "n_words", *shares, F.round("rate", 6).alias("rate"), F.round("residual", 6).alias("residual"))


QUERIES["op5_mixing"] = op5_mixing


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.pii(_table(spark, sf_dir, "documents")))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op1_pii, op3_license_scans)}


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text", language.held_out(F.col("doc_id")).alias("held_out"))
    return language.identified(docs, language.learned(docs.where("not held_out")), ["doc_id", "held_out"])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


QUERIES |= {f.__name__: f for f in (op11_language_id, op12_merkle_manifest, op13_vector_codes)}


def merkle_sql(levels: int = 6) -> str:
    """The manifest with its levels written out, for up to 16 ** levels rows a source and as many sources."""

    def shown(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in fields)

    def others(k: int, name: str) -> str:
        """Of each node of a level: its run's other digests before it, after it, its parent, and whether it has one."""
        run = "PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN"
        return f"""{name}{k}o AS MATERIALIZED (SELECT g, pos, d, n > 1 AS up,
          CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS b,
          CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS a
          FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}))"""

    def tree(name: str) -> list[str]:
        out = []
        for k in range(levels):
            out.append(others(k, name))
            out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT g, pos // 16 AS pos, CASE WHEN bool_or(up) THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d
          FROM {name}{k}o GROUP BY g, pos // 16)""")
        return out

    def fold(k: int, before: str, name: str, at: str, group: str) -> str:
        return f"""{before}{name}{k} AS MATERIALIZED (SELECT f.* REPLACE (f.proof || o.b || o.a AS proof, CASE WHEN o.up THEN sha256(o.b || f.now || o.a) ELSE f.now END AS now)
          FROM {before}{name}{k - 1} f JOIN {name}{k - 1}o o ON o.g IS NOT DISTINCT FROM {group} AND o.pos = {at} // {16 ** (k - 1)})"""

    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, 8 * length(doc_id::VARCHAR)),
      lambda i: ((ord(substr(doc_id::VARCHAR, i // 8 + 1, 1)) >> (i % 8)::INT) & 1)::BIGINT)), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"hashed AS MATERIALIZED (SELECT doc_id, source AS g, sha256({shown('text')}) AS d, CASE WHEN {crc} % 5 = 0 THEN sha256({shown(lowered)}) END AS t FROM documents)",
        "leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM hashed)",
        "l0 AS MATERIALIZED (SELECT g, pos, d FROM leaves)", *tree("l"),
        f"tops AS MATERIALIZED (SELECT g AS source, d, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS pos FROM l{levels})",
        "t0 AS MATERIALIZED (SELECT 0 AS g, pos, d FROM tops)", *tree("t"),
        "xl0 AS MATERIALIZED (SELECT doc_id, g, pos, d, coalesce(t, d) AS now, '' AS proof FROM leaves)",
        *[fold(k, "x", "l", "f.pos", "f.g") for k in range(1, levels + 1)],
        f"yt0 AS MATERIALIZED (SELECT f.*, p.pos AS top, p.d AS subroot FROM xl{levels} f JOIN tops p ON p.source IS NOT DISTINCT FROM f.g)",
        *[fold(k, "y", "t", "f.top", "0") for k in range(1, levels + 1)],
    ]
    return "WITH " + ",\n".join(steps) + f"""
SELECT y.doc_id, y.d AS leaf, y.subroot, r.d AS root, sha256(y.proof) AS proof_sha256, y.now AS folded_root, y.now = r.d AS verified FROM yt{levels} y, t{levels} r"""


def codes_sql(rule: vector_codes.Codes = vector_codes.Codes()) -> str:
    """The codes with their rounds written out."""
    away = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
    floor = f"list_transform(embedding, lambda x: floor({rule.scale} * x::DOUBLE)::BIGINT)"
    good = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, {floor} AS x, row_number() OVER (ORDER BY vec_id NULLS LAST, {floor}) AS row FROM embeddings WHERE {good})",
        f"""parts AS MATERIALIZED (SELECT row, k AS part, x[(k * len(x) // {rule.parts} + 1):((k + 1) * len(x) // {rule.parts})] AS x
      FROM kept, (SELECT unnest(range(0, {rule.parts})) AS k))""",
        f"c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM parts WHERE row <= {rule.entries})",
    ]
    for k in range(rule.rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT row, part, min(struct_pack(away := away, entry := entry)) AS m FROM (
      SELECT p.row, p.part, c.entry, coalesce({away}, 0)::BIGINT AS away FROM parts p JOIN c{k} c ON c.part = p.part) GROUP BY row, part)""")
        steps.append(f"""c{k + 1} AS MATERIALIZED (WITH used AS (
        SELECT a.part, a.m.entry AS entry, i, floor(sum(p.x[i]) / count(*))::BIGINT AS v
        FROM a{k} a JOIN parts p ON p.row = a.row AND p.part = a.part, unnest(range(1, len(p.x) + 1)) AS u(i) GROUP BY a.part, a.m.entry, i
      ), means AS (SELECT part, entry, list(v ORDER BY i) AS x FROM used GROUP BY part, entry)
      SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN means m ON m.part = c.part AND m.entry = c.entry)""")
    last = rule.rounds
    return "WITH " + ",\n".join(steps) + f""", books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{last}
), coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', a.m.entry), '' ORDER BY a.part) AS code, sum(a.m.away)::BIGINT AS error
  FROM a{last} a JOIN kept k ON k.row = a.row GROUP BY k.row, k.vec_id, k.label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books"""


ORACLES["op12_merkle_manifest"] = merkle_sql()
ORACLES["op13_vector_codes"] = codes_sql()
