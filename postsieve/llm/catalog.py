"""The registered queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm import byte_bpe, chat, exact, jaccard, lattice, licenses, lines, mixing, prefix_trie, secrets, suffixes, toxicity, whitening
from postsieve.llm.common import table


def op1_lattice_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.link_vectors(table(spark, sf, "embeddings"))


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf, "documents"), licenses.templates(spark)))


def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(table(spark, sf, "documents"))


def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf, "documents"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.judge(docs, toxicity.fit(docs, table(spark, sf, "labels")))


def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf, "documents")).drop("kept")


def op7_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    mixed = mixing.mix_sources(docs, mixing.proportional(docs, power=0.7))
    return mixed.select("doc_id", "source", "mix_slot", "mix_place", "mix_balanced")


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.token_rows(spark, table(spark, sf, "documents"), path, public_tokenizers.PATTERN)


def op9_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(rows))


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.keep_last_copies(table(spark, sf, "documents").select("doc_id", "text"))


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf, "conversations")).drop("ref_conv_id", "ref_pos")


def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.drop_repeated_lines(table(spark, sf, "documents")).drop("keep_runs")


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


QUERIES = {
    "op1_lattice_dedup": op1_lattice_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_secret_scan": op3_secret_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_chat_format": op9_chat_format,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_line_dedup": op12_line_dedup,
    "op13_whitening": op13_whitening,
}

OP10_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM t JOIN g USING (text)
"""

# crc32 is worked out byte by byte; a path is the list of all turns of a prefix.
OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS rn,
    coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS crc
  FROM (SELECT DISTINCT c FROM turns)),
kept AS (SELECT c, xor(crc, 4294967295) % 4 AS h FROM convs),
parts AS (
  SELECT k.c, 0 AS part, rn, r, t FROM kept k JOIN turns o ON o.c = k.c - k.c % 20 AND rn <= h
  UNION ALL SELECT c, 1, rn, r, t FROM turns JOIN kept USING (c) WHERE rn > h),
rebuilt AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, rn) AS d FROM parts),
prefixes AS (
  SELECT c, d, list({'r': r, 't': t}) OVER (PARTITION BY c ORDER BY d) AS path,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt
  UNION ALL SELECT c, 0, [], 0 FROM kept),
ends AS (SELECT c, max(d) AS d FROM prefixes GROUP BY c),
nodes AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE e.c IS NOT NULL), '')) AS ends_sha256
  FROM prefixes p LEFT JOIN ends e USING (c, d) GROUP BY d, path),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]),
children AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (d, path)),
above AS (SELECT path[1:a] AS path, n_children, (n_convs - 1) * words AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted)),
sums AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (path)
"""

OP12_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> last AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES = {"op10_exact_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_line_dedup": OP12_SQL}
