"""The registered queries of this subpackage (op1 ... op13) and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from trailsift.llm import (centroids, credentials, language_id, licenses, lm_score, minhash, mixing, packing, quality,
                           source_audit, url_filter, vector_links, wrappers)
from trailsift.llm.common import fold, prepare, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def byte_bpe() -> str:
    """Path of the public byte-level BPE file."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(fold(F.col("doc_id")) != 0), "text", "lang", F.xxhash64("doc_id"))
    found = language_id.identify(docs, model, ["doc_id"])
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")


@query
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)


SQL["op2_minhash_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS g FROM words),
sets AS (SELECT g, min(doc_id) AS node, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM grams)
  WHERE len(g) > 0 GROUP BY g),
items AS (SELECT node, n, unnest(g) AS s FROM sets),
links AS (
  SELECT a.node AS x, b.node AS y FROM items a JOIN items b ON a.s = b.s AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT node AS x, node AS y FROM sets UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
comps AS (SELECT x AS node, min(y) AS root FROM reach GROUP BY x)
SELECT q.doc_id, len(q.g) AS n_shingles, coalesce(c.root, q.doc_id) AS component_id,
  q.doc_id = coalesce(c.root, q.doc_id) AS kept
FROM (SELECT doc_id, list_sort(g) AS g FROM grams) q
LEFT JOIN sets s ON s.g = q.g LEFT JOIN comps c ON c.node = s.node
"""


@query
def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed_documents(docs).withColumn("due_time", F.round("due_time", 9))


def _due_sql(share: str, schedule: mixing.Schedule) -> str:
    """The time at which a share of a source's demand is due: the schedule's integral is a quadratic a piece."""
    total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
    cases, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        start, slope = w0 / total, (w1 - w0) / (t1 - t0) / total
        part = (t1 - t0) * (w0 + w1) / 2 / total
        left = f"greatest({share} - {before!r}::DOUBLE, 0::DOUBLE)"
        root = f"sqrt(greatest({start * start!r}::DOUBLE + ({2 * slope!r})::DOUBLE * {left}, 0::DOUBLE))"
        before += part
        cases.append((before, f"{t0!r}::DOUBLE + 2::DOUBLE * {left} / ({start!r}::DOUBLE + {root})"))
    text = cases[-1][1]
    for end, value in reversed(cases[:-1]):
        text = f"CASE WHEN {share} <= {end!r}::DOUBLE THEN {value} ELSE {text} END"
    return f"least({text}, 1::DOUBLE)"


SQL["op3_curriculum_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
src AS (
  SELECT source, sum(size)::DOUBLE AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r,
    1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sized GROUP BY source),
shares AS (
  SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS all_w,
    (sum(s) OVER () - coalesce(sum(3 * s) OVER lower, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER lower, 0)) AS share
  FROM src WINDOW lower AS (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rest AS (
  SELECT *, 3 * s / w < share AS capped,
    total - sum(CASE WHEN 3 * s / w < share THEN 3 * s ELSE 0 END) OVER () AS left_over,
    all_w - sum(CASE WHEN 3 * s / w < share THEN w ELSE 0 END) OVER () AS free FROM shares),
goal AS (SELECT source, s, r, CASE WHEN capped OR free <= 0 THEN 3 * s ELSE least(3 * s, w * left_over / free) END AS target
  FROM rest),
placed AS (
  SELECT z.doc_id, z.size, z.k, g.s, g.r, g.target, floor(g.target + 0.5) AS quota,
    coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.k, z.doc_id NULLS FIRST, z.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized z JOIN goal g ON z.source IS NOT DISTINCT FROM g.source),
met AS (
  SELECT *, greatest(0, least(size, quota - start)) AS first, (start + first / 2.0::DOUBLE) / quota AS share FROM placed),
due AS (
  SELECT *, CASE WHEN first > 0 THEN CASE r % 3 WHEN 0 THEN """ + _due_sql("share", mixing.SCHEDULES[0]) + """
    WHEN 1 THEN """ + _due_sql("share", mixing.SCHEDULES[1]) + " ELSE " + _due_sql("share", mixing.SCHEDULES[2]) + r""" END END
    AS due FROM met)
SELECT doc_id, size, s::BIGINT AS source_size, target,
  (first + greatest(0, least(size, quota - s - start)) + greatest(0, least(size, quota - 2 * s - start)))::BIGINT AS taken,
  round(due, 9) AS due_time,
  CASE WHEN first > 0 THEN row_number() OVER (PARTITION BY first > 0 ORDER BY due, r, k, doc_id NULLS FIRST) - 1 END AS position
FROM due
"""


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


@query
def op6_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read_table(spark, sf_dir, "pages"))


@query
def op7_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_vectors(read_table(spark, sf_dir, "embeddings"), 0.93)


SQL["op7_vector_links"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comps AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT m.vec_id, coalesce(d.n, 0) AS n_links, c.root AS component_id, m.vec_id = c.root AS kept
FROM embeddings m JOIN comps c ON c.x = m.vec_id LEFT JOIN degree d ON d.x = m.vec_id
"""


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), byte_bpe(), 2048)


@query
def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold(F.col("doc_id"))
    return lm_score.score_documents(read_table(spark, sf_dir, "documents"), byte_bpe(), part == 1, part != 1)


@query
def op10_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


@query
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read_table(spark, sf_dir, "documents"))


SQL["op11_source_audit"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
places AS (
  SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM places GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
counts AS (SELECT lang, source, term, count(*) AS c FROM places JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(max(z.v), 0) AS v, coalesce(sum(c.c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes z ON z.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + g.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (z.n + z.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes z ON z.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
priced AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM cells WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""


@query
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dimension=64)


def _cluster_sql(k: int, rounds: int, seed: int, dimension: int) -> str:
    """Every round as a table of its own: centroids ``c<n>``, assignments ``a<n>``."""
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, [floor(1024 * x::DOUBLE)::HUGEINT FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dimension}
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k, x FROM v QUALIFY k < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT id, vec_id, x, best.k AS k, best.d AS d FROM (
    SELECT v.id, v.vec_id, v.x, min({{'d': list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) FOR i IN range(1, {dimension + 1})]),
      'k': c.k}}) AS best FROM v CROSS JOIN c{n} c GROUP BY v.id, v.vec_id, v.x))""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
      SELECT k, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n}, range(1, {dimension + 1}) r(i) GROUP BY k, i)
    GROUP BY k) m ON m.k = c.k)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT a.vec_id, a.k::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string([y::VARCHAR FOR y IN c.x], ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""


SQL["op12_centroid_clusters"] = _cluster_sql(8, 10, 3, 64)


@query
def op13_credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digest(read_table(spark, sf_dir, "documents"))
