"""Queries over the given tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketweave.llm.ann import approximate_neighbours
from marketweave.llm.centroids import cluster_report
from marketweave.llm.common import table
from marketweave.llm.decontaminate import contamination_report
from marketweave.llm.htmltext import main_texts
from marketweave.llm.lm import scores
from marketweave.llm.neardup import duplicate_classes
from marketweave.llm.packing import packing_report
from marketweave.llm.pii import personal_data_report
from marketweave.llm.quality import quality_scores
from marketweave.llm.runs import run_report
from marketweave.llm.secrets import secret_report
from marketweave.llm.suffixes import without_repeats
from marketweave.llm.topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ball_tree_top_k": lambda s, d: top_k(table(s, d, "embeddings")),
    "op2_quality_discriminant": lambda s, d: quality_scores(table(s, d, "documents"), table(s, d, "labels")),
    "op3_kneser_ney_scores": lambda s, d: scores(table(s, d, "documents")),
    "op4_disclosing_terms": lambda s, d: personal_data_report(table(s, d, "documents")),
    "op5_secret_token_efficiency": lambda s, d: secret_report(table(s, d, "documents")),
    "op6_prefix_filtered_decontamination": lambda s, d: contamination_report(table(s, d, "documents"), table(s, d, "benchmark")),
    "op7_maximal_repeats": lambda s, d: without_repeats(table(s, d, "documents")),
    "op8_hilbert_packing": lambda s, d: packing_report(table(s, d, "documents")),
    "op9_order_minhash_classes": lambda s, d: duplicate_classes(table(s, d, "documents")),
    "op10_consensus_main_text": lambda s, d: main_texts(table(s, d, "pages")),
    "op11_sharded_lloyd": lambda s, d: cluster_report(table(s, d, "embeddings")),
    "op12_periodic_runs": lambda s, d: run_report(table(s, d, "documents")),
    "op13_learned_partitions": lambda s, d: approximate_neighbours(table(s, d, "embeddings")),
}



def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after another; means by whole numbers, rounded down."""
    steps = [f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER w AS INTEGER) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL WINDOW w AS (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), x) QUALIFY row_number() OVER w <= {k})"]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'c': c}}) AS best FROM (
            SELECT v.rid, v.vec_id, v.x, c, CAST(list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
                SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL) GROUP BY c)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), {", ".join(steps)}
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.c = c{rounds}.c
"""


ORACLES: dict[str, str] = {
    "op11_sharded_lloyd": _lloyd_sql(),
    # every pair of equal words at most a quarter of the text apart; stretches of one distance; the smallest one
    "op12_periodic_runs": r"""
WITH h AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS UBIGINT)),
      lambda a, b: list_reduce(CAST(range(8) AS UBIGINT[]), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b)), CAST(4294967295 AS UBIGINT)), 4294967295) AS h
  FROM documents
), a AS (
  SELECT rid, doc_id, w, CAST(len(w) AS BIGINT) AS n, h % 10 = 0 AND len(w) > 0 AS turned, CAST(h // 10 AS BIGINT) AS g FROM h
), t AS MATERIALIZED (
  SELECT rid, doc_id, n, CASE WHEN turned THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE w END AS w FROM a
), p AS (
  SELECT rid, n, unnest(w) AS word, unnest(range(n)) AS i FROM t
), e AS (
  SELECT x.rid, y.i - x.i AS q, x.i FROM p x JOIN p y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), s AS (
  SELECT rid, q, min(i) AS a, count(*) + q AS size FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM e) GROUP BY rid, q, k HAVING count(*) + q >= greatest(6, 4 * q)
), r AS MATERIALIZED (
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.rid = s.rid AND o.q < s.q AND o.a <= s.a AND o.a + o.size >= s.a + s.size)
), g AS (
  SELECT rid, count(*) AS n_runs, sha256(string_agg(a || ',' || size || ',' || q || chr(10), '' ORDER BY a, q)) AS runs_sha256, min({'l': -size, 'a': a, 'q': q}) AS best FROM r GROUP BY rid
), gone AS (
  SELECT rid, list(DISTINCT i) AS gone FROM (SELECT rid, unnest(range(a + q, a + size)) AS i FROM r) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.a AS start, -best.l AS length, best.q AS period, 1000 * -best.l // best.q AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(gone, i)), lambda i: w[1 + i]) END, ' ')) AS collapsed_sha256
FROM t LEFT JOIN g USING (rid) LEFT JOIN gone USING (rid)
""",
    "op1_ball_tree_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
""",
    "op6_prefix_filtered_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS window
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS window
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, dw.size, i, item_id FROM dw JOIN bw ON dw.window = bw.window AND dw.size = bw.size
), words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
