"""Stand-in views: the test tables dressed as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rows(self) -> DataFrame:
        """Labelled documents as source rows; ``_pos`` is the id."""
        d = self.table("documents").join(self.table("labels"), "doc_id")
        return d.select(F.col("doc_id").alias("_pos"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("model_id"), F.col("lang").alias("dataset_id"), F.col("doc_id").cast("string").alias("problem_id"), F.col("text").alias("original_problem"), (F.col("quality") == 1).alias("model_is_robust"))

    def labels(self) -> DataFrame:
        return self.table("labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("is_robust"))

    def labels_by_model(self) -> DataFrame:
        return self.labels().join(self.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("model_id")), "id")

    def predictions(self) -> DataFrame:
        """All documents predicted by length: every 11th twice, every 13th invalid, every 17th left out."""
        d = self.table("documents").where(F.col("doc_id") % 17 != 0)
        copies = F.explode(F.when(F.col("doc_id") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        return d.select(F.col("doc_id").alias("id"), (F.col("n_chars") >= 1000).alias("is_robust"), (F.col("doc_id") % 13 != 0).alias("valid"), copies.alias("_c")).withColumn("_pos", F.col("id") * 2 + F.col("_c")).drop("_c")

    def steps(self) -> DataFrame:
        """Embeddings times 40 as logits, ten steps a response; even steps take the arg-max, odd ones the label."""
        e = self.table("embeddings")
        x = F.transform("embedding", lambda v: v.cast("double") * 40)
        s = e.select(F.floor(F.col("vec_id") / 10).alias("resp_id"), (F.col("vec_id") % 10).alias("step"), "vec_id", x.alias("logits"), "label")
        top = (F.array_position("logits", F.array_max("logits")) - 1).cast("long")
        return s.withColumn("token", F.when(F.col("vec_id") % 2 == 0, top).otherwise(F.col("label").cast("long"))).drop("label")

    def scores(self) -> DataFrame:
        return self.table("events").select("event_id", F.col("value").alias("score"), (F.col("event_type") != "error").alias("label"), "user_id")


ROWS = "v_rows AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS id, source AS model_id, lang AS dataset_id, CAST(doc_id AS VARCHAR) AS problem_id, text AS original_problem, quality = 1 AS robust FROM documents JOIN labels USING (doc_id))"
LABELS = "v_labels AS (SELECT doc_id AS id, quality = 1 AS robust FROM labels)"
PRED = (
    "v_pred AS (SELECT doc_id AS id, n_chars >= 1000 AS robust, doc_id % 13 <> 0 AS valid, doc_id * 2 + c AS pos FROM documents, (VALUES (0), (1)) t(c) "
    "WHERE doc_id % 17 <> 0 AND (c = 0 OR doc_id % 11 = 0))"
)
FIRST = "f AS (SELECT id, arg_min(robust, pos) robust, arg_min(valid, pos) valid, count(*) n FROM v_pred GROUP BY id)"
STEPS = (
    "v_x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE * 40 x, generate_subscripts(embedding, 1) - 1 i FROM embeddings), "
    "v_m AS (SELECT vec_id, any_value(label) lab, max(x) m, arg_max(i, (x, -i)) top FROM v_x GROUP BY vec_id), "
    "v_z AS (SELECT vec_id, ln(sum(exp(x - m))) z FROM v_x JOIN v_m USING (vec_id) GROUP BY vec_id), "
    "v_lp AS (SELECT vec_id, i, x - m - z lp, top, CASE WHEN vec_id % 2 = 0 THEN top ELSE lab END token FROM v_x JOIN v_m USING (vec_id) JOIN v_z USING (vec_id)), "
    "v_step AS (SELECT vec_id // 10 resp_id, vec_id % 10 step, any_value(token)::BIGINT AS token, max(CASE WHEN i = token THEN lp END) log_prob, -sum(exp(lp) * lp) entropy, exp(max(lp)) top1_prob, "
    "any_value(top)::BIGINT top1_id, exp(max(lp)) - exp(max(CASE WHEN i <> top THEN lp END)) margin FROM v_lp GROUP BY vec_id)"
)
