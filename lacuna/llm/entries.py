"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import collocations, exact_dedup, hard_negatives, katz, language, near_duplicates, neighbours, packing, quality, sentencepiece_scan, sharding, url_filter, warc
from lacuna.llm.shared import Scratch, id_crc32, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.default_tokenizer())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encode(table(spark, sf_dir, "documents"), sentencepiece_scan.default_model())


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where(F.pmod(F.col("vec_id"), F.lit(50)) == 0), 5)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it comes back from the store, whether its shard is within the limits, and whether shards were merged.

    The table arrives in seven parts of like size: of so many shards in two neighbouring tiers, four share one, so merges are due whatever the sizes are.
    """
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(7))
    store = sharding.shard([docs.where(part == k) for k in range(7)], Scratch(spark, "sharding").path("documents"))
    of = store.manifest().agg(F.count("*").alias("shards"), F.max("generation").alias("newest")).first()
    fits = F.col("shard_bytes").between(1, sharding.OVERSIZE * sharding.TARGET_BYTES)
    merged = of["shards"] < store.appended() and of["newest"] > 0
    return store.read(described=True).select("doc_id", F.length("text").cast("bigint").alias("text_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), fits.alias("in_limits"), F.lit(merged).alias("merged"))


def op11_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores, _ = katz.fit_and_score(docs, id_crc32(F.col("doc_id"), 7) != 2)
    return scores.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.hard_negatives(rows, rows.where(F.pmod("vec_id", F.lit(100)) == 0)).drop("products")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: Ranks as the sum over all numbers of links followed; what comes after 200 is below 1e-14 of all.
OP1_SQL = r"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
c AS (SELECT page_id, html, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
j AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c),
v AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM j),
h AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM v WHERE host <> '' GROUP BY host),
k AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS href FROM c),
l AS (SELECT src, CASE WHEN starts_with(href, '//') THEN 'x:' || href ELSE href END AS href FROM k),
d AS (SELECT src, CASE WHEN strpos(href, '://') > 0 THEN translate(regexp_extract(substr(href, strpos(href, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS dst FROM l),
e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS n FROM d WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
m AS (SELECT src AS frm, dst AS too, 0.85 * n / sum(n) OVER (PARTITION BY src) AS ts, 0.0 AS ds FROM e
      UNION ALL SELECT dst, src, 0.0, 0.85 * n / sum(n) OVER (PARTITION BY dst) FROM e),
x AS (SELECT host, 0 AS step, 0.15e0 * a / greatest(sum(a) OVER (), 1) AS t, 0.15e0 * b / greatest(sum(b) OVER (), 1) AS d FROM h
      UNION ALL SELECT m.too, x.step + 1, sum(x.t * m.ts), sum(x.d * m.ds) FROM x JOIN m ON x.host = m.frm WHERE x.step < 200 GROUP BY m.too, x.step),
s AS (SELECT host, sum(t) AS t, sum(d) AS d FROM x GROUP BY host),
p AS (SELECT 0.1e0 * 0.15e0 / greatest(count(*), 1) AS prior FROM h WHERE a + b > 0)
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.ruled, CASE WHEN s.d > 0.5 * (s.d + s.t + p.prior) THEN 'block' ELSE 'allow' END) AS verdict
FROM v CROSS JOIN p LEFT JOIN s ON v.host = s.host
"""


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""


OP6_SQL = r"""
WITH r AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM r),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM l),
s AS (SELECT doc_id, unnest(shingles) AS shingle FROM l),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, n AS n_shingles, component_id, component_id = doc_id AS stays FROM n JOIN c USING (doc_id)
"""


OP10_SQL = """
SELECT doc_id, length(text) AS text_chars, sha256(text) AS text_sha256, true AS in_limits, true AS merged FROM documents
"""


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e AS a JOIN e AS c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""


OP13_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
o AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) AS k(m) WHERE len(ws) >= m),
f AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS f FROM o GROUP BY lang, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
x AS (SELECT c.lang, c.phrase, c.a, k.k, u.f AS l, v.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (u.f::HUGEINT * v.f) AS score
      FROM c JOIN range(1, 5) AS k(k) ON k.k < c.m JOIN f AS u ON u.lang = c.lang AND u.phrase = array_to_string(c.ws[1:k.k], ' ')
      JOIN f AS v ON v.lang = c.lang AND v.phrase = array_to_string(c.ws[k.k + 1:c.m], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND c.m > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 100 * b.a),
s AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM b ANTI JOIN d USING (lang, phrase))
SELECT * FROM s WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_quality_classifier, op3_language_id, op4_exact_dedup, op5_packing, op6_warc, op7_sentencepiece, op8_ngram_jaccard_join, op9_nearest_neighbours, op10_sharding, op11_katz_lm, op12_hard_negatives, op13_collocations, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op6_warc": OP6_SQL, "op8_ngram_jaccard_join": OP8_SQL, "op10_sharding": OP10_SQL, "op12_hard_negatives": OP12_SQL, "op13_collocations": OP13_SQL}
