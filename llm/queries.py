"""Queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import alignment, decontaminate, embeddings, knn, linededup, mixing, quality, repair, secrets, simhash, tokenbin, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("spans")


OP2_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM item, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
gram AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM doc, sizes, unnest(range(1, len(w) - k + 2)) AS u(i)),
hit AS (SELECT doc_id, i, gram.k, item_id FROM gram JOIN win ON win.k = gram.k AND win.g = gram.g),
place AS (SELECT doc_id, count(DISTINCT p) AS n FROM hit, unnest(range(i, i + k)) AS u(p) GROUP BY doc_id),
name AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(place.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(name.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, place.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN place USING (doc_id) LEFT JOIN name USING (doc_id)
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, which arrive in two parts: the second finds the blobs of the first in the ledger."""
    docs, late = table(spark, sf_dir, "documents"), F.xxhash64("doc_id") < 0
    return secrets.scan_history([docs.where(~late), docs.where(late)])


def _op4_sql() -> str:
    """Matches and the gaps between them give the places; patterns are the operator's, kept ones as the contract says."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({text(name)}, {k}, {text(pattern)})" for k, (name, (_, pattern)) in enumerate(secrets.RULES.items()))
    base = ", ".join(map(text, secrets.BASE))
    return f"""
WITH rule(kind, place, pattern) AS (VALUES {rules}),
doc AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT row, kind, place, regexp_extract_all(text, pattern) AS found, regexp_split_to_array(text, pattern) AS gaps,
    CASE kind WHEN 'assign' THEN regexp_extract_all(text, pattern, 1) END AS value FROM doc, rule),
one AS (
  SELECT row, kind, place, length(found[i]) AS n, length(value[i]) AS v,
    coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS s
  FROM m, unnest(range(1, len(found) + 1)) AS u(i)),
kept AS (
  SELECT row, kind, place, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS line FROM one
  WHERE CASE kind WHEN 'assign' THEN v >= 6 WHEN 'access' THEN n >= 20 ELSE true END),
found AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
    string_agg(line, ',' ORDER BY s, place) FILTER (kind IN ({base})) AS base, string_agg(line, ',' ORDER BY s, place) AS spans
  FROM kept GROUP BY row)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN found USING (row)
"""


def op5_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_cut", F.sha2("text", 256).alias("text_sha256"), "text")


OP8_SQL = r"""
WITH line AS (
  SELECT doc_id, i AS pos, l, trim(l, E' \t\r\x0b\x0c') AS own, len(regexp_extract_all(l, '[^\t-\r ]+')) AS words
  FROM documents, unnest(string_split(text, E'\n')) WITH ORDINALITY AS u(l, i)),
pair AS (
  SELECT a.doc_id, a.pos, b.doc_id AS other, a.pos - b.pos AS diagonal, a.words FROM line a JOIN line b ON a.own = b.own
  WHERE b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.pos < a.pos)),
step AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY pos) AS run FROM pair),
total AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, other, diagonal, run) AS total FROM step),
gone AS (SELECT DISTINCT doc_id, pos FROM total WHERE total >= 50),
kept AS (SELECT doc_id, string_agg(l, E'\n' ORDER BY pos) AS rest FROM line ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM line GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n_cut FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_cut, 0) AS BIGINT) AS n_cut, sha256(out) AS text_sha256, out AS text
FROM (SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(rest, '') END AS out FROM documents LEFT JOIN kept USING (doc_id))
LEFT JOIN n USING (doc_id) LEFT JOIN cut USING (doc_id)
"""


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE own AS (SELECT row_number() OVER () AS row, * FROM embeddings),
v AS (
  SELECT row, label, CAST(embedding AS DOUBLE[]) AS e FROM own
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.row AS a, b.row AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.row <> b.row AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT row AS a, row AS b FROM own UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
c AS (SELECT a, min(vec_id) AS c FROM reach JOIN own ON b = row GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(c AS BIGINT) AS component_id, vec_id IS NOT DISTINCT FROM c AS kept
FROM own LEFT JOIN n ON n.a = row JOIN c ON c.a = row
"""


def op11_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products for each vector whose id is divisible by 100, over all others."""
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.row, q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.row <> v.row AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM pair) WHERE rank <= 10
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.Repair(repair.damaged(table(spark, sf_dir, "conversations"))).report()


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.report(table(spark, sf_dir, "documents"), *files)


QUERIES = {f.__name__: f for f in (
    op1_toxicity_chain, op2_decontamination, op3_url_filter, op4_secret_ledger, op5_pivotal_mixing,
    op6_quality_cotraining, op7_token_output, op8_line_dedup, op9_simhash_neardup, op10_embedding_neardup,
    op11_voronoi_knn, op12_conversation_repair, op13_tokenizer_alignment,
)}
ORACLE_SQL = {"op2_decontamination": OP2_SQL, "op4_secret_ledger": _op4_sql(), "op8_line_dedup": OP8_SQL, "op10_embedding_neardup": OP10_SQL, "op11_voronoi_knn": OP11_SQL}
