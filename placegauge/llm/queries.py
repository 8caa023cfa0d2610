"""The operators over the given tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import hashlib
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placegauge.llm import (
    decontaminate,
    id_files,
    language,
    line_templates,
    main_text,
    near_text,
    near_vectors,
    packing,
    secret_scan,
    spelling,
    substrings,
    token_counts,
    vector_codes,
)
from placegauge.llm.common import joined_digest, shared_folder, table

VOCABULARY = "byte_bpe_50k.json"


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        joined_digest(F.col("items").cast("array<string>")).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicated(table(spark, folder, "documents"))


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, folder, "embeddings"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = language.identified(table(spark, folder, "documents"))
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        language.held_out().alias("held_out"),
        "lang_pred",
        "score",
    )


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY)
    )


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, folder, "documents"), size=4)


def op9_id_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    id_files.write_ids(
        table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), path
    )
    return id_files.document_digests(spark, path)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: lines dropped, and the digest of what is left of its text."""
    found = line_templates.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "lines_dropped",
        F.sha2("text", 256).alias("text_sha256"),
    )


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents").select("doc_id", "text"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")
    )
    codes, codebooks = vector_codes.compressed(rows)
    numbers = ",".join(str(x) for book in codebooks for entry in book.tolist() for x in entry)
    return vector_codes.with_label_errors(codes).select(
        F.col("id").alias("vec_id"),
        "code",
        "error",
        "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"),
    )


def op13_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return main_text.extracted(pages).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_minhash": op8_minhash,
    "op9_id_files": op9_id_files,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling": op11_spelling,
    "op12_vector_codes": op12_vector_codes,
    "op13_main_text": op13_main_text,
}

# The same rules in DuckDB's SQL.
WORDS = (
    "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP1_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce({WORDS.format(text='text')}, []) AS w FROM documents),
i AS (SELECT item_id, {WORDS.format(text='text')} AS w FROM benchmark
      WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS m, w[s : s + least(10, len(w)) - 1] AS win
      FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
q AS (SELECT doc_id, m, s, w[s : s + m - 1] AS win
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s
            FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS MATERIALIZED (SELECT doc_id, q.m, s, item_id FROM q JOIN p ON q.win = p.win AND q.m = p.m),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit
      FROM (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP2_SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, s, hash(array_to_string(w[s : s + 49], ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS low FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS k FROM s JOIN m USING (h) WHERE low < doc_id),
r AS (SELECT doc_id, count(*) AS n, list(k) AS ks FROM g GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.k) AS kept
      FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.k = g.k GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP8_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[s : s + 3], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS s FROM d WHERE len(w) > 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
      FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN c ca ON a = ca.doc_id JOIN c cb ON b = cb.doc_id
      WHERE 100 * shared >= 80 * (ca.n + cb.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP3_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0
    AND len(list_filter(embedding, lambda z: z <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.vec_id = l.a),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

# crc32 of the UTF-8 bytes of ``<doc_id>:<run>`` by a table of its 256 byte steps.
OP11_SQL = """
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
  GROUP BY ALL),
b AS (
  SELECT run, n, list_transform(string_split(coalesce(doc_id::VARCHAR, 'null') || ':' || run, ''),
    lambda z: unicode(z)::BIGINT) AS cs FROM r),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
      flatten(list_transform(cs, lambda z: CASE WHEN z < 128 THEN [z] ELSE [195, z - 64] END))),
    lambda c, z: xor(c >> 8, crc[(xor(c, z) & 255) + 1])), 4294967295) AS h FROM b, t),
w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT)
      || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
d AS MATERIALIZED (
  SELECT DISTINCT word, n, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS cut FROM k),
s AS MATERIALIZED (
  SELECT word, n, substr(word, 1, i::INT - 1) || '*' || substr(word, i::INT + 1) AS gap FROM k),
p AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT d.word, w.word AS near, w.n AS near_n FROM d JOIN w ON d.cut = w.word
    UNION ALL SELECT w.word, d.word, d.n FROM d JOIN w ON d.cut = w.word
    UNION ALL SELECT x.word, y.word, y.n FROM s x JOIN s y ON x.gap = y.gap AND x.word <> y.word)),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN form_n >= 2 * w.n THEN form END AS form,
    CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN (
    SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n
    FROM p GROUP BY word) USING (word)),
c(word, root, step) AS (
  SELECT word, word, 0 FROM f
  UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n
FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word) USING (word)
"""


def _lloyd_sql(rounds: int = 4) -> str:
    """Plain Lloyd: distances of all parts to all entries, round by round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT vec_id, p.part, p.x, entry,
      list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) AS d
    FROM p JOIN c{k} c USING (part))
  GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT part, entry, list(m ORDER BY i) AS x FROM (
      SELECT part, entry, i, floor(sum(z) / count(*)) AS m FROM (
        SELECT part, entry, unnest(x) AS z, generate_subscripts(x, 1) AS i FROM a{k})
      GROUP BY part, entry, i) GROUP BY part, entry) n USING (part, entry))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda z: floor(1024 * z::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS x
  FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)),{",".join(steps)},
e AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a{rounds} JOIN v USING (vec_id) GROUP BY ALL),
s AS (SELECT label, sum(error)::BIGINT AS label_error FROM e GROUP BY label),
b AS (
  SELECT sha256(string_agg(z::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (
    SELECT part, entry, unnest(x) AS z, generate_subscripts(x, 1) AS i FROM c{rounds}))
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM e JOIN s ON e.label IS NOT DISTINCT FROM s.label, b
"""


ORACLES = {
    "op1_decontamination": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op3_embedding_dedup": OP3_SQL,
    "op8_minhash": OP8_SQL,
    "op11_spelling": OP11_SQL,
    "op12_vector_codes": _lloyd_sql(),
}
