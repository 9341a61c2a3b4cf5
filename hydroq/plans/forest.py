"""Queries over isolation forests."""

from pyspark.sql import functions as F

from hydroq.operators import forest
from hydroq.plans.catalog import obs, query
from hydroq.sources.test_tables import observations_sql

_COLUMNS = ("MeasurementValueNum", "SampleDetectLimit", "LabCode")


def _average(n):
    return f"(CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1.0::DOUBLE) + {forest.EULER}) - 2 * ({n} - 1.0::DOUBLE) / {n} WHEN {n} = 2 THEN 1 ELSE 0 END)"


_SCORED = f"""
WITH RECURSIVE obs AS ({observations_sql()}), numbers AS MATERIALIZED (
  {" UNION ALL ".join(f"SELECT row_key, '{c}' AS c, CAST({c} AS DOUBLE) AS v FROM obs WHERE {c} IS NOT NULL" for c in _COLUMNS)}
), ranked AS MATERIALIZED (
  SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY md5(CAST(row_key AS VARCHAR)), v) - 1 AS r FROM numbers
), sizes AS (
  SELECT c, count(*) AS n, least(count(*), {forest.TREES * forest.SAMPLE}) AS pool FROM numbers GROUP BY c
), draws AS MATERIALIZED (
  SELECT r.c, tree, r.v FROM (SELECT c, tree, (tree * {forest.SAMPLE} + i) % pool AS place FROM sizes, range({forest.TREES}) a(tree), range({forest.SAMPLE}) b(i) WHERE i < pool) d JOIN ranked r ON r.c = d.c AND r.r = d.place
), tree AS (
  SELECT c, tree, 1::BIGINT AS node, 0 AS depth, '-inf'::DOUBLE AS low, list_sort(list(v)) AS vs, count(*) AS total FROM draws GROUP BY c, tree
  UNION ALL
  SELECT c, tree, 2 * node + side, depth + 1, CASE side WHEN 0 THEN low ELSE split END, list_filter(vs, lambda x: (x > split) = (side = 1)), total FROM (
    SELECT *, CASE WHEN cut >= vs[-1] THEN vs[1] ELSE cut END AS split FROM (
      SELECT *, vs[1] + CAST('0x' || substr(md5('{forest.SEED}:' || c || ':' || tree || ':' || node), 1, 12) AS BIGINT) / 281474976710656::DOUBLE * (vs[-1] - vs[1]) AS cut FROM tree
      WHERE vs[1] < vs[-1] AND depth < ceil(log2(greatest(total, 2))))
  ), range(2) s(side)
), leaves AS MATERIALIZED (
  SELECT c, tree, low, depth + {_average("len(vs)")} AS path FROM tree WHERE NOT (vs[1] < vs[-1] AND depth < ceil(log2(greatest(total, 2))))
), scored AS MATERIALIZED (
  SELECT x.c, x.v, any_value(k) AS k, pow(2, -round(sum(path) / {forest.TREES}, 7) / any_value({_average(f"least(n, {forest.SAMPLE})")})) AS score
  FROM (SELECT * FROM (SELECT c, v, count(*) AS k FROM numbers GROUP BY c, v) JOIN sizes USING (c), range({forest.TREES}) t(tree)) x ASOF JOIN leaves l ON x.c = l.c AND x.tree = l.tree AND x.v > l.low GROUP BY x.c, x.v
), cuts AS (
  SELECT c, quantile_cont(score, {1 - forest.CONTAMINATION}) AS cut FROM numbers JOIN scored USING (c, v) GROUP BY c
)
"""


@query("f31_isolation_forest", _SCORED + "SELECT c AS \"column\", v AS value, k AS n, score FROM scored JOIN cuts USING (c) WHERE score > cut", "score", raw_sql=True)
def _(spark, sf):
    return forest.isolation_outliers(obs(spark, sf, "row_key", *_COLUMNS), _COLUMNS).where("is_outlier").drop("is_outlier")


@query(
    "f31_isolation_summary",
    _SCORED + """SELECT c AS "column", sum(k)::BIGINT AS numbers, coalesce(sum(k) FILTER (score > cut), 0)::BIGINT AS outliers, max(score) AS top_score, max(v) FILTER (score <= cut) AS largest_inlier
    FROM scored JOIN cuts USING (c) GROUP BY c""",
    "top_score", raw_sql=True,
)
def _(spark, sf):
    found = forest.isolation_outliers(obs(spark, sf, "row_key", *_COLUMNS), _COLUMNS)
    out = F.col("is_outlier")
    return found.groupBy("column").agg(F.sum("n").alias("numbers"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("outliers"), F.max("score").alias("top_score"), F.max(F.when(~out, F.col("value"))).alias("largest_inlier"))
