"""The registry of queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import linear as L
from ..functions import tokens as T
from ..operators import cache, digests, evaluate, families, quality, selection
from ..sources import readers
from .views import FIRST, LABELS, PRED, ROWS, STEPS, Views

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of ``Views``; ``sql`` is what DuckDB runs for it."""

    def add(f):
        def run(spark, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        _Q[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(x):
    return F.round(x, 6)


_COVERED = "coalesce(f.n = 1 AND f.valid AND f.robust IS NOT NULL, false)"
_COUNTS = (
    f"round(count(*) FILTER ({_COVERED} AND f.robust = l.robust) / count(*), 6) AS accuracy, round(count(*) FILTER ({_COVERED}) / count(*), 6) AS coverage, "
)


@query(f"WITH {LABELS}, {PRED}, {FIRST} SELECT {_COUNTS} count(*) FILTER (NOT {_COVERED}) + (SELECT count(*) FROM f WHERE n > 1) + (SELECT count(*) FROM f WHERE id NOT IN (SELECT id FROM v_labels)) AS invalid_predictions, count(*) AS n_labels FROM v_labels l LEFT JOIN f ON f.id = l.id")
def score_summary(v: Views):
    s = evaluate.score(v.labels(), v.predictions())
    return s.select(r6("accuracy").alias("accuracy"), r6("coverage").alias("coverage"), "invalid_predictions", "n_labels")


@query(f"WITH {LABELS}, {PRED}, {FIRST}, l AS (SELECT v_labels.*, source AS model_id FROM v_labels JOIN documents ON doc_id = id) SELECT model_id, {_COUNTS} count(*) FILTER (NOT {_COVERED}) AS invalid_predictions, count(*) AS n_labels FROM l LEFT JOIN f ON f.id = l.id GROUP BY model_id")
def score_by_model(v: Views):
    s = evaluate.score(v.labels_by_model(), v.predictions(), by="model_id")
    return s.select("model_id", r6("accuracy").alias("accuracy"), r6("coverage").alias("coverage"), "invalid_predictions", "n_labels")


@query(f"WITH {LABELS}, {PRED} SELECT DISTINCT id FROM v_pred p WHERE NOT EXISTS (SELECT 1 FROM v_labels l WHERE l.id = p.id)")
def extra_ids(v: Views):
    return evaluate.extra_ids(v.labels(), v.predictions())


@query(f"WITH {LABELS}, {PRED} SELECT id FROM v_labels l WHERE NOT EXISTS (SELECT 1 FROM v_pred p WHERE l.id = p.id)")
def uncovered_ids(v: Views):
    return evaluate.uncovered_ids(v.labels(), v.predictions())


@query(f"WITH {PRED} SELECT count(*) AS cases, count(*) FILTER (NOT valid) AS invalid_predictions FROM v_pred")
def ingestion_summary(v: Views):
    return evaluate.ingestion_summary(v.predictions())


@query(f"WITH {PRED} SELECT id, count(*) AS n_rows FROM v_pred GROUP BY id HAVING count(*) > 1")
def duplicate_keys(v: Views):
    return quality.duplicates(v.predictions(), "id")


@query(f"WITH {ROWS} SELECT original_problem, count(DISTINCT robust) AS n_values FROM v_rows GROUP BY 1 HAVING count(DISTINCT robust) > 1")
def text_label_conflicts(v: Views):
    return quality.conflicts(v.rows(), ["original_problem"], ["model_is_robust"])


@query(f"WITH {ROWS} SELECT model_id, count(DISTINCT robust) AS n_values FROM v_rows GROUP BY 1 HAVING count(DISTINCT robust) > 1")
def source_label_conflicts(v: Views):
    return quality.conflicts(v.rows(), ["model_id"], ["model_is_robust"])


@query("WITH c AS (SELECT count(*) FILTER (value IS NULL) a, count(*) FILTER (value NOT BETWEEN 0 AND 1) b, count(*) FILTER (event_type = '') c, count(*) FILTER (props IS NULL) d FROM events) SELECT unnest(['null_value', 'value_out_of_unit', 'empty_type', 'null_props']) AS rule, unnest([a, b, c, d]) AS violations FROM c")
def dq_report(v: Views):
    e = v.table("events")
    return quality.report(e, {"null_value": F.col("value").isNull(), "value_out_of_unit": ~quality.in_unit(F.col("value")), "empty_type": F.col("event_type") == "", "null_props": F.col("props").isNull()})


_J2 = "'[' || to_json(dataset_id)::VARCHAR || ',' || to_json(problem_id)::VARCHAR || ']'"


@query(f"WITH {ROWS} SELECT id, 'case-' || substr(sha256('[' || to_json(model_id)::VARCHAR || ',' || to_json(dataset_id)::VARCHAR || ',' || to_json(problem_id)::VARCHAR || ',[\"plain\"]]'), 1, 24) AS case_id FROM v_rows")
def case_ids(v: Views):
    return v.rows().select("id", K.case_id(F.col("model_id"), F.col("dataset_id"), F.col("problem_id"), F.array(F.lit("plain"))).alias("case_id"))


@query(f"WITH {ROWS} SELECT id, 'f' || substr(sha256({_J2}), 1, 12) AS family_id FROM v_rows")
def family_ids(v: Views):
    return v.rows().select("id", K.family_id(F.col("dataset_id"), F.col("problem_id")).alias("family_id"))


@query(f"WITH {ROWS} SELECT id, sha256(original_problem) AS prompt_key FROM v_rows")
def prompt_keys(v: Views):
    return v.rows().select("id", K.prompt_key(F.col("original_problem")).alias("prompt_key"))


@query("SELECT p_partkey, trim(regexp_replace(p_name || ' / ' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS safe_id FROM part")
def safe_model_ids(v: Views):
    return v.table("part").select("p_partkey", K.safe_model_id(F.concat("p_name", F.lit(" / "), "p_brand")).alias("safe_id"))


@query("SELECT text, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_cases(v: Views):
    return families.keep_first(v.table("documents").select("text", "doc_id", "source"), ["text"], "doc_id")


@query("SELECT text, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1")
def dedup_keep_last(v: Views):
    return families.keep_first(v.table("documents").select("text", "doc_id", "source"), ["text"], "doc_id", last=True)


@query("SELECT count(*) AS source_rows, count(DISTINCT text) AS cases, count(*) - count(DISTINCT text) AS duplicates_removed FROM documents")
def dedup_summary(v: Views):
    return families.dedup_summary(v.table("documents"), ["text"])


_FAM = ROWS.replace("CAST(doc_id AS VARCHAR) AS problem_id", "CAST(doc_id % 97 AS VARCHAR) AS problem_id")


def _family_rows(v: Views) -> DataFrame:
    return v.rows().withColumn("problem_id", (F.col("_pos") % 97).cast("string"))


@query(f"WITH {_FAM} SELECT 'f' || substr(sha256({_J2}), 1, 12) AS family_id, dataset_id, problem_id, min(original_problem) AS original_problem, bool_and(robust) AS historic_label, count(*) AS source_rows, arg_min(model_id, pos) AS model_id FROM v_rows GROUP BY dataset_id, problem_id")
def families_rollup(v: Views):
    return families.families(_family_rows(v))


@query(f"WITH {_FAM} SELECT robust AS label, count(*) AS source_rows, count(DISTINCT (dataset_id, problem_id)) AS families FROM v_rows GROUP BY 1")
def label_counts(v: Views):
    return _family_rows(v).groupBy(F.col("model_is_robust").alias("label")).agg(F.count(F.lit(1)).alias("source_rows"), F.count_distinct(F.struct("dataset_id", "problem_id")).alias("families"))


_SEL = f"WITH {ROWS}, s AS (SELECT id, robust AS label, original_problem, sha256(id) o, row_number() OVER (PARTITION BY robust ORDER BY sha256(id), id) rk FROM v_rows), g AS (SELECT * FROM s WHERE rk <= 25)"


def _selected(v: Views) -> DataFrame:
    rows = v.rows().select("id", F.col("model_is_robust").alias("label"), "original_problem")
    return families.pilot_first(families.stratified(rows, "id", "label", 25), "label")


@query(f"{_SEL} SELECT id, label, rk AS rank, CASE WHEN label THEN rk <= 3 ELSE rk <= 2 END AS pilot FROM g")
def stratified_selection(v: Views):
    return _selected(v).select("id", "label", "rank", "pilot")


@query(f"{_SEL}, b AS (SELECT *, (row_number() OVER (ORDER BY o) - 1) // 5 + 1 batch FROM g) SELECT batch, count(*) AS n_tasks, string_agg(id, ',' ORDER BY id) AS ids, sha256(string_agg(original_problem, '' ORDER BY id)) AS texts FROM b GROUP BY batch")
def request_batches(v: Views):
    s = families.batches(_selected(v).withColumnRenamed("id", "family_id"), families.hash_order(F.col("family_id")))
    p = families.request_payload(s)
    return p.select("batch", F.size("tasks").cast("long").alias("n_tasks"), F.array_join(F.transform("tasks", lambda t: t["family_id"]), ",").alias("ids"), F.sha2(F.array_join(F.transform("tasks", lambda t: t["original_problem"]), ""), 256).alias("texts"))


_SHARD = "a AS (SELECT text, min(doc_id) pos FROM documents GROUP BY text), k AS (SELECT text, pos, row_number() OVER (ORDER BY pos) - 1 AS rank FROM a)"


@query(f"WITH {_SHARD} SELECT sha256(text) AS prompt_key, pos, rank FROM k WHERE rank % 4 = 1")
def prompt_shard(v: Views):
    return families.shard(v.table("documents").select("text", F.col("doc_id").alias("pos")), "text", "pos", 4, 1).select(K.prompt_key(F.col("text")).alias("prompt_key"), "pos", "rank")


@query(f"WITH {_SHARD} SELECT doc_id FROM documents WHERE text IN (SELECT text FROM k WHERE rank % 4 = 1)")
def shard_source_rows(v: Views):
    d = v.table("documents")
    mine = families.shard(d.select("text", F.col("doc_id").alias("pos")), "text", "pos", 4, 1)
    return cache.in_shard(d, mine, "text").select("doc_id")


@query("SELECT DISTINCT sha256(text) AS prompt_key FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 3 = 0 AND c.text = d.text)")
def resume_missing(v: Views):
    d = v.table("documents").select(K.prompt_key(F.col("text")).alias("prompt_key"), "doc_id")
    return cache.missing(d, d.where(F.col("doc_id") % 3 == 0), "prompt_key").select("prompt_key").distinct()


@query("SELECT doc_id, sha256(text) AS prompt_key, length(text) AS n FROM documents")
def feature_join_back(v: Views):
    d = v.table("documents").select("doc_id", K.prompt_key(F.col("text")).alias("prompt_key"), "text")
    f = lambda one: one.select("prompt_key", F.length("text").cast("long").alias("n"))
    return cache.dedup_apply(d, "prompt_key", ["text"], f).select("doc_id", "prompt_key", "n")


_SPLIT = "g AS (SELECT source, row_number() OVER (ORDER BY sha256('7:' || source), source) - 1 r, count(*) OVER () n FROM (SELECT DISTINCT source FROM documents)), sp AS (SELECT source, CASE WHEN r < least(n - 1, greatest(1, round_even(n * 0.2, 0))) THEN 'validation' ELSE 'train' END AS split FROM g)"


@query(f"WITH {_SPLIT} SELECT source, split FROM sp")
def group_split(v: Views):
    return families.group_split(v.table("documents"), "source", 0.2, 7)


@query(f"WITH {_SPLIT}, d AS (SELECT lang, text, split FROM documents JOIN sp USING (source)) SELECT DISTINCT text FROM d WHERE split = 'train' AND text IN (SELECT text FROM d WHERE split = 'validation')")
def split_overlap(v: Views):
    """Texts on both sides of a split by source."""
    d = v.table("documents")
    m = d.join(families.group_split(d, "source", 0.2, 7), "source")
    return quality.overlap(m.where("split = 'train'"), m.where("split = 'validation'"), "text")


_FOLD = "g AS (SELECT user_id, 2 * count(*) FILTER (event_type <> 'error') >= count(*) c FROM events GROUP BY user_id), fa AS (SELECT user_id, c, (row_number() OVER (ORDER BY c, sha256('42:' || user_id::VARCHAR), user_id) - 1) % 5 AS fold FROM g)"


@query(f"WITH {_FOLD} SELECT fold, count(DISTINCT user_id) AS n_groups, count(*) AS n_rows, count(*) FILTER (event_type <> 'error') AS n_true FROM events JOIN fa USING (user_id) GROUP BY fold")
def fold_assignment_counts(v: Views):
    s = v.scores()
    m = s.join(families.fold_assignment(s, "user_id", "label"), "user_id")
    return m.groupBy("fold").agg(F.count_distinct("user_id").alias("n_groups"), F.count(F.lit(1)).alias("n_rows"), F.count_if("label").alias("n_true"))


@query("WITH g AS (SELECT user_id, count(*) n, count(*) FILTER (event_type <> 'error') y FROM events GROUP BY user_id) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(y) AS BIGINT) AS n_true, true AS whole, true AS rows_even, true AS classes_even FROM g")
def balanced_fold_counts(v: Views):
    """Every group in one of five folds, whose rows of either class differ by one largest group at most."""
    s = v.scores()
    a = families.balanced_folds(s, "user_id", "label")
    per = s.join(a, "user_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("y"), F.count_distinct("user_id").alias("g"))
    most = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    even = lambda x: F.max(x) - F.min(x)
    one = per.agg(F.sum("g").alias("n_groups"), F.sum("n").alias("n_rows"), F.sum("y").alias("n_true"), F.count(F.lit(1)).alias("k"), even(F.col("n")).alias("dn"), even(F.col("y")).alias("dy"), even(F.col("n") - F.col("y")).alias("dz"))
    leak = families.fold_leakage(a, "user_id").agg(F.count(F.lit(1)).alias("leaks"))
    return one.crossJoin(most).crossJoin(leak).select("n_groups", "n_rows", "n_true", ((F.col("leaks") == 0) & (F.col("k") == 5)).alias("whole"), (F.col("dn") <= F.col("most")).alias("rows_even"), (F.greatest("dy", "dz") <= F.col("most")).alias("classes_even"))  # a row each


@query(f"WITH {_FOLD}, b AS (SELECT user_id, fold FROM fa UNION ALL SELECT user_id, (fold + 1) % 5 FROM fa WHERE user_id % 50 = 0) SELECT user_id, count(DISTINCT fold) AS n_folds FROM b GROUP BY user_id HAVING count(DISTINCT fold) > 1")
def fold_leakage(v: Views):
    """An assignment broken on purpose, so that something is found."""
    s = v.scores()
    a = families.fold_assignment(s, "user_id", "label")
    broken = a.unionByName(a.where(F.col("user_id") % 50 == 0).withColumn("fold", (F.col("fold") + 1) % 5))
    return families.fold_leakage(broken, "user_id")


@query(f"WITH {STEPS} SELECT resp_id, step, token, round(log_prob, 6) AS log_prob, round(entropy, 6) AS entropy, round(top1_prob, 6) AS top1_prob, top1_id, round(margin, 6) AS margin, top1_id = token AS is_top1 FROM v_step")
def token_step_stats(v: Views):
    s = T.step_stats(v.steps())
    return s.select("resp_id", "step", "token", *[r6(c).alias(c) for c in ("log_prob", "entropy", "top1_prob")], "top1_id", r6("margin").alias("margin"), "is_top1")


_NAN = "coalesce({}, 'nan'::DOUBLE)"
_MET = {  # by the contract's names and order, not by the library's list
    "generation_mean_logprob": "avg(log_prob)", "generation_mean_prob": "avg(exp(log_prob))", "generation_mean_nll": "-avg(log_prob)", "generation_ppl": "exp(-avg(log_prob))",
    "generation_min_logprob": "min(log_prob)", "generation_max_logprob": "max(log_prob)", "generation_std_logprob": "stddev_pop(log_prob)",
    "generation_min_k_logprob": "avg(CASE WHEN rn <= greatest(1, ceil(n * 0.2::DOUBLE)) THEN log_prob END)", "generation_mean_entropy": "avg(entropy)",
    "generation_mean_top1_prob": "avg(top1_prob)", "generation_mean_top2_margin": "avg(margin)", "generation_frac_selected_is_top1": "avg((top1_id = token)::INT)",
    "generation_frac_high_conf_tokens": "avg((exp(log_prob) >= 0.9)::INT)", "generation_frac_low_conf_tokens": "avg((exp(log_prob) <= 0.1)::INT)",
}
_METRIC_SQL = ", ".join(f"round({_NAN.format(x)}, 6) AS {n}" for n, x in _MET.items())


_METRICS_SQL = f"WITH {STEPS}, ok AS (SELECT *, row_number() OVER (PARTITION BY resp_id ORDER BY log_prob, step) rn, count(*) OVER (PARTITION BY resp_id) n FROM v_step WHERE token NOT IN (0, 9)), m AS (SELECT resp_id, count(*) AS generation_num_tokens, {_METRIC_SQL} FROM ok GROUP BY resp_id) SELECT r.resp_id, coalesce(generation_num_tokens, 0) AS generation_num_tokens, " + ", ".join(f"coalesce({n}, 'nan'::DOUBLE) AS {n}" for n in _MET) + " FROM (SELECT DISTINCT resp_id FROM v_step) r LEFT JOIN m USING (resp_id)"


@query(_METRICS_SQL)
def generation_metrics(v: Views):
    s = T.step_stats(v.steps()).withColumn("valid", T.valid_token(F.col("token"), 0, [9]))
    g = T.generation_metrics(s, "resp_id")
    return g.select("resp_id", "generation_num_tokens", *[r6(c).alias(c) for c in T.METRICS])


_ST = "x AS (SELECT vec_id, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) - 1 pos FROM embeddings), st AS (SELECT pos, avg(x) mean, greatest(stddev_pop(x), 1e-6) std FROM x WHERE vec_id % 5 <> 0 GROUP BY pos)"


@query(f"WITH {_ST} SELECT pos::INT AS pos, round(mean, 6) AS mean, round(std, 6) AS std FROM st")
def standardise_stats(v: Views):
    s = L.standardise_stats(v.table("embeddings").where(F.col("vec_id") % 5 != 0), "embedding")
    return s.select("pos", r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"WITH {_ST} SELECT vec_id, round(sum((x - mean) / std), 5) AS z_sum, round(max((x - mean) / std), 6) AS z_max FROM x JOIN st USING (pos) GROUP BY vec_id")
def standardise_apply(v: Views):
    e = v.table("embeddings")
    z = L.standardise(e, "embedding", L.standardise_stats(e.where(F.col("vec_id") % 5 != 0), "embedding"))
    return z.select("vec_id", F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 5).alias("z_sum"), r6(F.array_max("z")).alias("z_max"))


def _probes(v: Views) -> DataFrame:
    """Three probes for layers 0 to 8: cosines of probe, layer and position."""
    w = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i * (F.col("probe") + 1) + F.col("layer")) % 7 - 3).cast("double") / 7)
    p = v.spark.range(27).select((F.col("id") % 9).cast("int").alias("layer"), F.floor(F.col("id") / 9).cast("int").alias("probe"))
    return p.select("layer", "probe", w.alias("weights"), (F.col("probe") / 10.0).alias("bias"), (F.col("layer") / 100.0).alias("threshold"))


@query(
    "WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) - 1 i FROM embeddings), p AS (SELECT l, q FROM range(9) a(l), range(3) b(q)), "
    "m AS (SELECT vec_id, q, sum(x * (((i * (q + 1) + l) % 7 - 3) / 7::DOUBLE)) + any_value(q) / 10 - any_value(l) / 100 m FROM x LEFT JOIN p ON l = label GROUP BY vec_id, q) "
    "SELECT vec_id, round(avg(m), 6) AS margin, coalesce(avg(m) >= 0, false) AS is_robust FROM m GROUP BY vec_id"
)
def probe_margins(v: Views):
    """Label 9 has no probe and so no margin."""
    m = L.ensemble_margins(v.table("embeddings"), "vec_id", "label", "embedding", _probes(v))
    return m.select("vec_id", r6("margin").alias("margin"), "is_robust")


@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) - 1 i FROM embeddings), p AS (SELECT vec_id, 1 / (1 + exp(-(sum(x * ((i % 5 - 2) / 2::DOUBLE)) + 0.1))) p FROM x GROUP BY vec_id) SELECT vec_id, round(p, 6) AS probability, p >= 0.5 AS is_robust FROM p")
def head_probability(v: Views):
    p = v.table("embeddings").withColumn("p", L.head_probability(F.col("embedding"), [(i % 5 - 2) / 2 for i in range(64)], 0.1))
    return p.select("vec_id", r6("p").alias("probability"), (F.col("p") >= 0.5).alias("is_robust"))


@query(f"WITH {ROWS}, c AS (SELECT model_id, robust = (length(original_problem) >= 1000) ok FROM v_rows), f AS (SELECT model_id, avg(ok::INT) a, sum(ok::INT) k, count(*) n FROM c GROUP BY model_id) SELECT round(sum(k) / sum(n), 6) AS row_accuracy, round(avg(a), 6) AS family_accuracy, count(*) AS n_families FROM f")
def family_accuracy(v: Views):
    c = v.rows().withColumn("ok", F.col("model_is_robust") == (F.length("original_problem") >= 1000))
    a = evaluate.family_accuracy(c, "model_id", "ok")
    return a.select(r6("row_accuracy").alias("row_accuracy"), r6("family_accuracy").alias("family_accuracy"), "n_families")


@query(f"WITH {ROWS}, m AS (SELECT 2 * count(*) FILTER (robust) >= count(robust) majority FROM v_rows WHERE pos % 5 <> 0) SELECT any_value(majority) AS majority, round(avg((robust = majority)::INT), 6) AS accuracy FROM v_rows, m WHERE pos % 5 = 0")
def majority_baseline(v: Views):
    r = v.rows()
    m = evaluate.majority_baseline(r.where(F.col("_pos") % 5 != 0), r.where(F.col("_pos") % 5 == 0), "model_is_robust")
    return m.select("majority", r6("accuracy").alias("accuracy"))


_SWEEP = (
    "b AS (SELECT value AS score, count(*) FILTER (event_type <> 'error') p, count(*) FILTER (event_type = 'error') n FROM events GROUP BY value), "
    "w AS (SELECT score, sum(p) OVER o cp, sum(n) OVER o cn, lead(score) OVER o nxt, sum(p) OVER () tp_, sum(n) OVER () tn_ FROM b WINDOW o AS (ORDER BY score)), "
    "s AS (SELECT CASE WHEN nxt IS NULL THEN nextafter(score, 'inf'::DOUBLE) ELSE score + (nxt - score) / 2 END threshold, cp tp, tn_ - cn tn, tp_, tn_ FROM w UNION ALL (SELECT nextafter(score, '-inf'::DOUBLE), 0, tn_, tp_, tn_ FROM w ORDER BY score LIMIT 1)), "
    "t AS (SELECT threshold, (tp / tp_ + tn / tn_) / 2 AS ba, (tp + tn) / (tp_ + tn_) AS ac, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn FROM s)"
)


@query(f"WITH {_SWEEP} SELECT round(threshold, 9) AS threshold, round(ba, 6) AS balanced_accuracy, round(ac, 6) AS accuracy, tp, tn FROM t")
def threshold_sweep(v: Views):
    s = selection.threshold_sweep(v.scores())
    return s.select(F.round("threshold", 9).alias("threshold"), r6("balanced_accuracy").alias("balanced_accuracy"), r6("accuracy").alias("accuracy"), "tp", "tn")


@query(f"WITH {_SWEEP} SELECT round(threshold, 9) AS threshold, round(ba, 6) AS balanced_accuracy, round(ac, 6) AS accuracy FROM t ORDER BY ba DESC, ac DESC, threshold LIMIT 1")
def best_threshold(v: Views):
    s = selection.best_threshold(v.scores())
    return s.select(F.round("threshold", 9).alias("threshold"), r6("balanced_accuracy").alias("balanced_accuracy"), r6("accuracy").alias("accuracy"))


@query("WITH d AS (SELECT l_extendedprice y, l_quantity * 1500 p FROM lineitem) SELECT round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) * (y - p)) / 1e6, 6) AS mse_millions, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM d")
def regression_metrics(v: Views):
    d = v.table("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    m = selection.regression_metrics(d, "y", "p")
    return m.select(F.round("mae", 4).alias("mae"), r6(F.col("mse") / 1e6).alias("mse_millions"), r6("r2").alias("r2"))


@query(
    "WITH c(identifier, t) AS (VALUES ('a-050', 50.0), ('b-100', 100.0), ('c-150', 150.0), ('d-200', 200.0)), m AS (SELECT identifier, "
    "(count(*) FILTER (event_type <> 'error' AND value < t) / count(*) FILTER (event_type <> 'error') + count(*) FILTER (event_type = 'error' AND value >= t) / count(*) FILTER (event_type = 'error')) / 2 ba, "
    "count(*) FILTER ((event_type <> 'error') = (value < t)) / count(*) ac, avg(abs(value - t)) mae FROM events, c GROUP BY identifier) "
    "SELECT identifier, round(ba, 6) AS balanced_accuracy, round(ac, 6) AS accuracy, round(mae, 4) AS mae FROM m ORDER BY ba DESC, ac DESC, mae, identifier LIMIT 1"
)
def candidate_ranking(v: Views):
    """Four constant thresholds as candidates."""
    s = v.scores()
    made = None
    for name, t in (("a-050", 50.0), ("b-100", 100.0), ("c-150", 150.0), ("d-200", 200.0)):
        d = s.withColumns({"pred": F.col("score") < t, "e": F.abs(F.col("score") - t)})
        m = d.agg(((F.count_if(F.col("label") & F.col("pred")) / F.count_if("label") + F.count_if(~F.col("label") & ~F.col("pred")) / F.count_if(~F.col("label"))) / 2).alias("balanced_accuracy"), (F.count_if(F.col("label") == F.col("pred")) / F.count(F.lit(1))).alias("accuracy"), F.avg("e").alias("mae"))
        m = m.withColumn("identifier", F.lit(name))
        made = m if made is None else made.unionByName(m)
    b = selection.rank_candidates(made)
    return b.select("identifier", r6("balanced_accuracy").alias("balanced_accuracy"), r6("accuracy").alias("accuracy"), F.round("mae", 4).alias("mae"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS is_int, coalesce(json_type(props) = 'OBJECT', false) AS is_object FROM events")
def json_props(v: Views):
    e = v.table("events").withColumn("v", F.try_parse_json("props"))
    kind = F.expr("schema_of_variant(try_variant_get(v, '$.k', 'variant'))")
    return e.select("event_id", F.expr("try_variant_get(v, '$.k', 'bigint')").alias("k"), (kind == "BIGINT").alias("is_int"), F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False)).alias("is_object"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def chat_prompts(v: Views):
    c = v.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t")))).alias("ts"))
    return c.select("conv_id", F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("prompt"))


@query("WITH d AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END x FROM events), m AS (SELECT median(x) md FROM d) SELECT event_id, round(coalesce(x, md), 6) AS value FROM d, m")
def median_impute(v: Views):
    d = v.table("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))
    return selection.impute_median(d, "x", "value").select("event_id", r6("value").alias("value"))


@query("WITH d AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END x FROM events), m AS (SELECT median(x) md FROM d WHERE x IS NOT NULL AND NOT isnan(x)) SELECT event_id, round(CASE WHEN x IS NULL OR isnan(x) THEN md ELSE x END, 6) AS value FROM d, m")
def median_impute_nan(v: Views):
    """NaN counts as missing, like null."""
    e = v.table("events")
    d = e.select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("x"))
    return selection.impute_median(d, "x", "value").select("event_id", r6("value").alias("value"))


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL BY NAME SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier")
def shard_union(v: Views):
    a = v.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = v.table("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("WITH d AS (SELECT text, doc_id FROM documents WHERE doc_id < 500) SELECT count(*) AS n_rows, count(DISTINCT text) AS n_prompts, CAST(sum(doc_id) FILTER (rn = 1) AS BIGINT) AS first_ids FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) rn FROM d)")
def first_n_then_dedup(v: Views):
    """The limit is the operator: a prefix of source rows by position, then distinct prompts."""
    d = v.table("documents").where(F.col("doc_id") < 500).groupBy("text").agg(F.min("doc_id").alias("f"), F.count(F.lit(1)).alias("n"))
    return d.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_prompts"), F.sum("f").alias("first_ids"))


_ALIAS = {"src1": "src-one", "src2": "src-two"}


@query("WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN lang END fam, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END i, lang, source, n_chars FROM documents), e AS (SELECT *, coalesce(fam, '[' || to_json(lang)::VARCHAR || ',' || to_json(doc_id::VARCHAR)::VARCHAR || ']') f FROM d) SELECT CASE WHEN i = '' THEN sha256('[' || to_json(f)::VARCHAR || ',' || coalesce(to_json(text)::VARCHAR, 'null') || ',' || doc_id::VARCHAR || ']') ELSE i END AS id, f AS family_id, CASE source WHEN 'src1' THEN 'src-one' WHEN 'src2' THEN 'src-two' ELSE source END AS model_id, n_chars >= 1000 AS is_robust FROM e")
def row_key_coalesce(v: Views):
    d = v.table("documents").select(
        F.col("doc_id").alias("_pos"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("family_id"),
        F.col("lang").alias("dataset_id"), F.col("doc_id").alias("problem_id"), F.col("text").alias("original_problem"), (F.col("n_chars") >= 1000).alias("model_is_robust"), F.col("source").alias("model_id"),
    )
    return readers.normalise_study_rows(d, _ALIAS).select("id", "family_id", "model_id", "is_robust")


@query("WITH d AS (SELECT regexp_replace(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN '  ' || text || chr(9) ELSE text END, '^\\s+', ''), '\\s+$', '') t FROM documents) SELECT sha256(t) AS text_key, count(*) AS n_rows FROM d GROUP BY t HAVING count(*) > 1")
def stripped_text_dups(v: Views):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  "), "text", F.lit("\t"))).otherwise(F.col("text"))
    d = v.table("documents").select(K.stripped(t).alias("t"))
    return quality.duplicates(d, "t").select(F.sha2("t", 256).alias("text_key"), "n_rows")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 0 AND 1, false) AS in_unit FROM events")
def numeric_coercion(v: Views):
    e = v.table("events").select("event_id", F.get_json_object("props", "$.k").alias("s"))
    return e.select("event_id", K.numeric(F.col("s")).alias("k"), F.coalesce(quality.in_unit(F.col("s")), F.lit(False)).alias("in_unit"))


@query("WITH a AS (SELECT DISTINCT o_custkey k FROM orders), b AS (SELECT c_custkey k FROM customer WHERE c_custkey % 10 <> 1) SELECT count(*) FILTER (b.k IS NULL) AS missing, count(*) FILTER (a.k IS NULL) AS unexpected FROM a FULL OUTER JOIN b ON a.k = b.k")
def set_equality(v: Views):
    a = v.table("orders").select(F.col("o_custkey").alias("k"))
    b = v.table("customer").where(F.col("c_custkey") % 10 != 1).select(F.col("c_custkey").alias("k"))
    return quality.set_difference(a, b, "k")


@query(f"WITH {ROWS} SELECT id, model_id, 'train' AS split, 'v1' AS source_revision FROM v_rows WHERE pos % 5 <> 0 UNION ALL SELECT id, model_id, 'validation', 'v1' FROM v_rows WHERE pos % 5 = 0")
def provenance_project(v: Views):
    r = v.rows()
    both = r.where(F.col("_pos") % 5 != 0).withColumn("split", F.lit("train")).unionByName(r.where(F.col("_pos") % 5 == 0).withColumn("split", F.lit("validation")))
    return both.withColumn("source_revision", F.lit("v1")).select("id", "model_id", "split", "source_revision")


@query("SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_turn_per_conversation(v: Views):
    """The last unmasked position: the mask is the assistant's turns."""
    c = v.table("conversations").where(F.col("role") == "assistant")
    return c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def stable_order_positions(v: Views):
    return evaluate.numbered_in_order(v.table("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "pos")


@query("SELECT source, count(*) AS n_rows, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def ordered_digest(v: Views):
    g = v.table("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list("doc_id")).alias("i"))
    return g.select("source", "n_rows", F.sha2(F.array_join(F.col("i").cast("array<string>"), ","), 256).alias("digest"))


_ROW_MD5 = "md5(concat_ws(chr(31), coalesce(CAST(doc_id AS VARCHAR), chr(0)), coalesce(text, chr(0))))"
_FOLDED = "CAST(list_reduce(list(CAST(CAST('0x' || substr(m, {at}, 15) AS BIGINT) AS HUGEINT) ORDER BY n_chars, doc_id, m), lambda a, x: (a * {base} + x) % 2305843009213693951, 0::HUGEINT) AS VARCHAR)"


@query(f"WITH d AS (SELECT source, n_chars, doc_id, {_ROW_MD5} AS m FROM documents) SELECT source, count(*) AS n_rows, {_FOLDED.format(at=1, base=1_000_003_000_019)} AS digest_1, {_FOLDED.format(at=16, base=1_700_000_000_000_029)} AS digest_2 FROM d GROUP BY source")
def sequence_digests(v: Views):
    """What each source's rows are, in the order of their lengths and ids; no source is in one task."""
    return digests.sequence_digest(v.table("documents"), ["n_chars", "doc_id"], ["doc_id", "text"], ["source"])


@query("WITH d AS (SELECT md5(concat_ws(chr(31), coalesce(CAST(doc_id AS VARCHAR), chr(0)), coalesce(text, chr(0)), coalesce(source, chr(0)))) AS m FROM documents) SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(m, 1, 15) AS BIGINT)) AS VARCHAR) AS sum_1, CAST(sum(CAST('0x' || substr(m, 16, 15) AS BIGINT)) AS VARCHAR) AS sum_2 FROM d")
def content_digest(v: Views):
    return cache.content_digest(v.table("documents"), "doc_id", "text", "source")


@query(f"WITH {ROWS} SELECT id, CASE WHEN model_id = 'src3' THEN false ELSE length(original_problem) >= 1000 END AS is_robust, model_id <> 'src3' AS valid FROM v_rows")
def udf_batch_eval(v: Views):
    """An opaque function per model that fails for one of them."""

    def predict(model_id: str, problems: list[str]) -> list[bool]:
        if model_id == "src3":
            raise RuntimeError("broken")
        return [len(p) >= 1000 for p in problems]

    return evaluate.run_batches(v.rows().withColumnRenamed("original_problem", "problem"), predict).select("id", "is_robust", "valid")


@query()
def ml_regressor_oof(v: Views):
    """Grouped out-of-fold predictions of a small forest on length features of documents."""
    from pyspark.ml.feature import VectorAssembler

    d = v.rows().select("id", F.col("model_id").alias("group"), "model_is_robust", F.col("model_is_robust").cast("double").alias("target"), F.length("original_problem").cast("double").alias("n"), F.size(F.split("original_problem", " ")).cast("double").alias("w"))
    x = VectorAssembler(inputCols=["n", "w"], outputCol="features").transform(d)
    got = selection.out_of_fold(x, "group", "model_is_robust", "features", "target", selection.Candidate("forest", 5, 3))
    return got.select("id", "group", "fold", "target", "prediction")


from . import studies  # noqa: E402,F401  registers its queries
