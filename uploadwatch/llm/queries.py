"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uploadwatch.llm import chat, decontam, dedup, lexical, licenses, lm, packing, secrets, spelling, store, tokens, topk, toxicity
from uploadwatch.scratch import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.prefix_tables(table(spark, sf_dir, "documents"), keep_table=False)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(*added.columns).unionByName(added)
    path = scratch_path(spark, "windows")
    chat.write_windows(chat.windows(turns), path)
    return chat.read_back(chat.read_windows(spark, path))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store_and_read(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DEDUP_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS shingle FROM w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 2) END)) AS u(i)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT node, b FROM reach JOIN both_ways ON a = seen),
parts AS (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN parts USING (doc_id)
"""

LEAKS_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i + 1 : i + 10], ' ') AS shown FROM b, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 9) END)) AS u(i)),
sizes AS (SELECT DISTINCT size FROM items),
shown AS (SELECT doc_id, i, size, array_to_string(w[i + 1 : i + size], ' ') AS shown FROM d, sizes, unnest(range(greatest(0, len(w) - size + 1))) AS u(i)),
met AS MATERIALIZED (SELECT doc_id, i, size, item_id FROM shown JOIN items USING (size, shown)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM met), unnest(range(i, i + size)) AS u(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _places_sql(kind: str, pattern: str, group: int = 0, least: str = "true") -> str:
    """doc_id, kind, rank, start, past of a pattern's matches; a group may leave out what stands before it."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {secrets.KINDS.index(kind) if kind in secrets.KINDS else 9} AS rank, CAST(past - size AS BIGINT) AS start, CAST(past AS BIGINT) AS past FROM (
  SELECT doc_id, length(shown[i]) AS size, length(inner_[i]) AS inside, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(whole[1:i], lambda g: length(g))) AS past FROM (
    SELECT doc_id, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS whole, regexp_extract_all(t, '{quoted}', {group}) AS inner_, {'whole' if kind != 'user' else 'inner_'} AS shown FROM docs WHERE regexp_matches(t, '{quoted}')
  ), unnest(range(1, len(whole) + 1)) AS u(i)) WHERE {least}"""


#: No look-around: a bare key is a run of exactly 40 characters, and what stands before a user name is matched with it.
SECRETS_SQL = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS MATERIALIZED (
  {_places_sql("assign", secrets.ASSIGN, 2, f"inside >= {secrets.LEAST_VALUE}")}
  UNION ALL {_places_sql("access", secrets.ACCESS)}
  UNION ALL {_places_sql("hex", secrets.HEX)}
  UNION ALL {_places_sql("secret", "[A-Za-z0-9+/]+", 0, "size = 40")}
  UNION ALL {_places_sql("endpoint", secrets.ENDPOINT)}
  UNION ALL {_places_sql("user", "(?i)(?:^|[^A-Za-z0-9])(" + secrets.USER.split(")", 2)[2] + ")", 1)}),
linked AS (
  SELECT x.* FROM parts x WHERE kind = 'secret' AND EXISTS (SELECT 1 FROM parts y WHERE y.doc_id = x.doc_id AND y.kind = 'access' AND abs(y.start - x.start) <= {secrets.SCOPE})
  UNION ALL SELECT x.* FROM parts x WHERE kind = 'endpoint' AND EXISTS (SELECT 1 FROM parts y WHERE y.doc_id = x.doc_id AND y.kind IN ('access', 'user') AND abs(y.start - x.start) <= {secrets.SCOPE})
    AND EXISTS (SELECT 1 FROM parts y WHERE y.doc_id = x.doc_id AND y.kind IN ('secret', 'assign') AND abs(y.start - x.start) <= {secrets.SCOPE})),
found AS (SELECT *, true AS base FROM parts WHERE rank < 3 UNION ALL SELECT *, false FROM linked),
listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (NOT base) AS n_linked,
  string_agg(kind || ':' || start || ':' || past, ',' ORDER BY start, rank, past) FILTER (base) AS base, string_agg(kind || ':' || start || ':' || past, ',' ORDER BY start, rank, past) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM docs LEFT JOIN listed USING (doc_id)
"""

RANKED_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{lexical.TERM}')) AS term FROM documents),
tf AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
sizes AS MATERIALIZED (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
every AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM sizes),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, every GROUP BY term, n_docs),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{lexical.TERM}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scored AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total))))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN sizes USING (r), every GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= {lexical.K}
"""

#: DuckDB has no crc32; its table follows from the polynomial, and a string's bytes from its hexadecimal form.
_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) AS u(i))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, {1}[1 + (xor(c, b) & 255)])), 4294967295)"

#: Words one edit apart share the pattern that a left-out or blotted letter leaves.
VARIANTS_SQL = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {spelling.SHORTEST} GROUP BY ALL),
marked AS MATERIALIZED (SELECT run, n, coalesce({_CRC.format("doc_id || ':' || run", "t")}, 1) AS h FROM runs, crc),
said AS (SELECT CASE WHEN h % {spelling.PERIOD} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 : length(run)] ELSE run END AS word, n FROM marked),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM said WHERE length(word) >= {spelling.SHORTEST} GROUP BY word HAVING sum(n) >= {spelling.OFTEN}),
cut AS MATERIALIZED (SELECT DISTINCT word, n, word[1 : i] || word[i + 2 : length(word)] AS rest FROM words, unnest(range(length(word))) AS u(i)),
blot AS MATERIALIZED (SELECT word, n, word[1 : i] || '*' || word[i + 2 : length(word)] AS rest FROM words, unnest(range(length(word))) AS u(i)),
pairs AS MATERIALIZED (
  SELECT a.word AS word, b.word AS near, b.n AS near_n FROM blot a JOIN blot b ON a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.RATIO} * n THEN near END AS form, CASE WHEN near_n >= {spelling.RATIO} * n THEN near_n END AS form_n FROM words LEFT JOIN near USING (word)),
walk(word, goal) AS (SELECT word, word FROM forms UNION SELECT walk.word, form FROM walk JOIN forms ON forms.word = goal WHERE form IS NOT NULL)
SELECT f.word, f.form, goal AS root, f.n, f.n_near, f.form_n FROM walk JOIN forms f USING (word) JOIN forms e ON e.word = goal WHERE e.form IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_topk_search, op3_token_counts, op4_decontamination, op5_chat_formatting, op6_toxicity, op7_license_scan, op8_token_store, op9_packing, op10_secret_scan, op11_ranked_search, op12_spelling_variants, op13_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": DEDUP_SQL, "op2_topk_search": TOPK_SQL, "op4_decontamination": LEAKS_SQL, "op10_secret_scan": SECRETS_SQL, "op11_ranked_search": RANKED_SQL, "op12_spelling_variants": VARIANTS_SQL}
