"""What the plans share: tables, the prediction table, and SQL text for the same things."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.scoring import score_by_centroids

SCALE = 10.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def predictions(spark: SparkSession, sf_dir: str, scale: float = SCALE) -> DataFrame:
    """(vec_id, gold, family, grp, z, p, t): a centroid scorer's answers on embeddings."""
    rows = score_by_centroids(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", scale)
    return rows.withColumn("family", F.concat(F.lit("f"), (F.col("vec_id") % 4).cast("string"))).withColumn("grp", F.col("vec_id") % 50)


def pred_sql(scale: float = SCALE, name: str = "pred") -> str:
    """The same as common table expressions (without WITH)."""
    n = name
    return f"""{n}_dims AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
{n}_cent AS (SELECT label, list(c ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS c FROM {n}_dims GROUP BY 1, 2) GROUP BY 1),
{n}_z AS (SELECT e.vec_id, e.label AS gold, list({scale}::DOUBLE * list_cosine_similarity(e.embedding::DOUBLE[], c.v) ORDER BY c.label) AS z FROM embeddings e CROSS JOIN {n}_cent c GROUP BY 1, 2),
{n}_e AS (SELECT vec_id, gold, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM {n}_z),
{n} AS (SELECT vec_id, gold, 'f' || (vec_id % 4) AS family, vec_id % 50 AS grp, z, list_transform(e, lambda x: x / list_sum(e)) AS p,
  list_transform(range(len(z)), lambda i: CASE WHEN i = gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS t FROM {n}_e)"""


def over(expr: str, p: str = "p") -> str:
    """SQL: the sum of expr over places i of p."""
    return f"list_sum(list_transform(range(1, len({p}) + 1), lambda i: {expr}))"


NLL = over("-t[i] * ln(greatest(least(p[i], 1.0::DOUBLE), 1e-12::DOUBLE))")
BRIER = over("(p[i] - t[i]) * (p[i] - t[i])")
ENTROPY = over("-p[i] * ln(greatest(least(p[i], 1.0::DOUBLE), 1e-12::DOUBLE))")
ARGMAX = "(list_position(p, list_max(p)) - 1)"
CONF = "list_max(p)"
HIT = f"(CASE WHEN {ARGMAX} = gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def md5_draw(modulus: str, *parts: str) -> str:
    """SQL: draw() of functions.hashing."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 7))::BIGINT % ({modulus}))"
