"""The registered queries of this subpackage, with SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.llm.decontamination import find_passages, passage_digest
from dayglass.llm.fill_in_middle import fill_digest
from dayglass.llm.fingerprints import edited_by_next
from dayglass.llm.frames import crc_bucket, table
from dayglass.llm.jaccard_join import jaccard_components
from dayglass.llm.language_model import score_texts
from dayglass.llm.pieces import encode_pieces, piece_digest
from dayglass.llm.prefix_trie import conversation_paths, prefix_nodes, turn_ids
from dayglass.llm.quality import fit_quality, score_quality
from dayglass.llm.secrets import finding_rows, fit_scanner, scan_secrets
from dayglass.llm.token_files import read_documents, write_token_files
from dayglass.llm.toxicity import fit_toxicity, score_toxicity
from dayglass.llm.url_filter import judge_urls
from dayglass.llm.warc import archive_digest, read_archives, write_archives
from dayglass.session import scratch_path


#: Fixed values of the url query: host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return judge_urls(table(spark, folder, "pages"), rules)


_URL_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path, row_number() OVER () AS n FROM rest),
rules(h, p, v) AS (VALUES %s),
hits AS (
  SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (n)
""" % ", ".join(str(r) for r in URL_RULES)


def op6_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_bucket("doc_id", 10) == 0
    scored = score_texts(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return passage_digest(find_passages(docs, table(spark, folder, "benchmark"), keep=["doc_id"]))


_PASSAGE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
spots AS (
  SELECT n, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM d, (SELECT DISTINCT size FROM windows), unnest(range(1, len(w) - size + 2)) AS u(i)),
found AS (SELECT n, i, size, item_id FROM spots JOIN windows USING (size, words)),
hit AS (SELECT n, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + size)) AS u(p) GROUP BY n),
item AS (
  SELECT n, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (n) LEFT JOIN item USING (n)
"""


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edited_by_next(table(spark, folder, "documents"))


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return piece_digest(encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"]))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return finding_rows(scan_secrets(docs, fit_scanner(docs), keep=["doc_id"]))


def _judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_bucket("doc_id", 5) == 0
    model = fit_toxicity(docs, table(spark, folder, "labels"), ~held_out)
    return _judged(score_toxicity(docs, model, keep=["doc_id"]), held_out)


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_bucket("doc_id", 3) == 1
    model = fit_quality(docs, table(spark, folder, "labels"), ~held_out)
    return _judged(score_quality(docs, model, keep=["doc_id"]), held_out)


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_documents(spark, path)


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_digest(table(spark, folder, "documents"))


_FILL_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS w, CAST('0x' || s[1:8] AS BIGINT) AS h1,
         CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, folder, "pages"), path)
    return archive_digest(read_archives(spark, path))


_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS smallest FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN smallest IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN smallest IS DISTINCT FROM page_id THEN smallest END AS refers_to
FROM f
"""


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_nodes(conversation_paths(turn_ids(table(spark, folder, "conversations")), group=100, most=6))


_TRIE_SQL = """
WITH raw AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(role, '') AS role FROM conversations),
own AS (
  SELECT conv_id, length(text) AS chars, sha256(length(role) || ':' || role || text) AS id,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM raw),
ids AS (
  SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS name FROM raw),
drawn AS (
  SELECT conv_id, name, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda k: CAST(ascii(name[k]) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)),
    4294967295), 4294967295) % 6 AS h FROM ids),
rebuilt AS (
  SELECT d.conv_id, 0 AS part, o.i, o.id, o.chars FROM drawn d JOIN own o ON o.conv_id = d.conv_id - d.conv_id % 100 AND o.i <= d.h
  UNION ALL
  SELECT d.conv_id, 1, o.i, o.id, o.chars FROM drawn d JOIN own o ON o.conv_id IS NOT DISTINCT FROM d.conv_id AND o.i > d.h),
paths AS (
  SELECT conv_id, chars, string_agg(id, '') OVER w AS path, count(*) OVER w AS depth FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
members AS (
  SELECT conv_id, path, depth, chars FROM paths UNION ALL SELECT conv_id, '', 0, 0 FROM ids),
longest AS (
  SELECT conv_id, max(depth) AS last FROM members GROUP BY conv_id),
nodes AS (
  SELECT path, depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
         sha256(coalesce(string_agg(coalesce(CAST(m.conv_id AS VARCHAR), ''), ',' ORDER BY m.conv_id NULLS LAST) FILTER (WHERE depth = last), '')) AS ends
  FROM members m JOIN longest l ON l.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY path, depth),
kids AS (
  SELECT path[1:64 * (depth - 1)] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT n.path[1:64 * k] AS path, sum(own) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids ON kids.path = n.path, unnest(range(0, n.depth + 1)) AS u(k) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below ON below.path = n.path LEFT JOIN kids ON kids.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:64 * (n.depth - 1)]
"""


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_ngram_join": op5_ngram_join,
    "op6_lm_scores": op6_lm_scores,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_token_files": op9_token_files,
    "op10_pieces": op10_pieces,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_warc": op12_warc,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL = {
    "op4_url_filter": _URL_SQL,
    "op7_decontamination": _PASSAGE_SQL,
    "op11_fill_in_middle": _FILL_SQL,
    "op12_warc": _WARC_SQL,
    "op13_prefix_trie": _TRIE_SQL,
}
