"""The op queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vitalgrid.llm import chat_format, html_extract, langid, line_dedup, mixing, ngram_join, periodic_runs, quality, sentencepiece_bpe, shard_tree, spelling, topk, warc

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(_read(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.neighbours(_read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
) WHERE rank <= 5
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.mark(_read(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(rows.unionByName(planted))


OP5_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), hit AS (
  SELECT conv_id, bool_or(CASE WHEN role = 'assistant' THEN contains(text, '</s>') ELSE contains(text, ' [/INST]') END) AS clash
  FROM turns GROUP BY conv_id
), sized AS (
  SELECT t.*, length(text) - length(replace(replace(replace(replace(text, '\\', ''), '[', ''), ']', ''), '<', '')) AS coded,
         length(role) + length(role) - length(replace(replace(replace(replace(role, '\\', ''), '[', ''), ']', ''), '<', '')) AS role_chars,
         clash AND (contains(text, '[') OR contains(text, '<') OR contains(text, '\\')) AS coding
  FROM turns t JOIN hit h ON t.conv_id IS NOT DISTINCT FROM h.conv_id
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + CASE WHEN coding THEN 1 + coded ELSE 0 END
           + CASE WHEN role = 'assistant' THEN 10 ELSE 16 + role_chars END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_read(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.positions(_read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_read(spark, sf_dir, "documents"))


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
           lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_of r ON r.a = d.doc_id
"""


def crc32_sql(text: str) -> str:
    """DuckDB's expression of the unsigned crc32 of a text's UTF-8; it reads the table ``crc_table``, column ``tab``."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295::BIGINT)"


CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
)"""


SHARDS = 40


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.assignments(_read(spark, sf_dir, "documents"), SHARDS)


_DRAW = "(-ln((('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, 'null'), '@', name)), 1, 13))::BIGINT + 0.5) / 4503599627370496)) / weight"

OP11_SQL = f"""
WITH {CRC_TABLE}, d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32
  FROM documents, crc_table
), ids AS (SELECT DISTINCT doc_id FROM d
), regions AS (SELECT concat('r', r) AS name, 10 AS weight, r AS region, NULL AS added FROM range(4) x(r)
), racks AS (SELECT r AS region, k AS rack, concat('r', r, '.k', k) AS name, 5 AS weight FROM range(4) x(r), range(2) y(k)
), leaves AS (
  SELECT r AS region, k AS rack, (r * 2 + k) * 5 + s AS shard, concat('r', r, '.k', k, '.', (r * 2 + k) * 5 + s) AS name, 1 AS weight FROM range(4) x(r), range(2) y(k), range(5) z(s)
), top AS (
  SELECT doc_id, arg_min(region, {_DRAW}) AS region, min({_DRAW}) AS least FROM ids, regions GROUP BY doc_id
), middle AS (
  SELECT doc_id, region, least, arg_min(rack, {_DRAW}) AS rack FROM top JOIN racks USING (region) GROUP BY doc_id, region, least
), placed AS (
  SELECT doc_id, least, arg_min(shard, {_DRAW}) AS shard FROM middle JOIN leaves USING (region, rack) GROUP BY doc_id, least
), grown AS (
  SELECT doc_id, shard, CASE WHEN {_DRAW} < least THEN 40 ELSE shard END AS grown_shard FROM (SELECT *, '+40' AS name, 1 AS weight FROM placed)
)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY d.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM d JOIN grown b ON d.doc_id IS NOT DISTINCT FROM b.doc_id
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
), hashed AS (SELECT run, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM runs, crc_table
), altered AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM hashed
), words AS (SELECT word, count(*) AS n FROM altered WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5
), less AS (
  SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM less x JOIN less y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM less x JOIN words y ON x.d = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM less x JOIN words y ON x.d = y.word
), best AS (
  SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND r = 1
), chain AS (
  SELECT word, word AS root, form AS up FROM forms UNION ALL SELECT c.word, c.up, f.form FROM chain c JOIN forms f ON f.word = c.up
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.up IS NULL
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(_read(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH {CRC_TABLE}, h AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {crc32_sql("doc_id::VARCHAR")} AS h
  FROM documents, crc_table
), g AS (SELECT *, len(w) AS n, h // 10 AS g FROM h
), a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g
), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a
), t AS (
  SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p
), six AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 5)) AS i FROM t)
), same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i
), stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same) GROUP BY doc_id, q, k
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS r FROM runs) WHERE r = 1
), all_of AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), gone_of AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
), x AS (SELECT t.doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t JOIN gone_of USING (doc_id)
), left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(CASE WHEN n_runs IS NULL THEN array_to_string(w, ' ') ELSE coalesce(left_over.s, '') END) AS collapsed_sha256
FROM t LEFT JOIN all_of USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_topk": op2_topk,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_chat_format": op5_chat_format,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_ngram_join": op10_ngram_join,
    "op11_sharding": op11_sharding,
    "op12_spelling": op12_spelling,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk": OP2_SQL,
    "op5_chat_format": OP5_SQL,
    "op10_ngram_join": OP10_SQL,
    "op11_sharding": OP11_SQL,
    "op12_spelling": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}
