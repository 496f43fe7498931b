import json
import math

import pytest
from pyspark.sql import functions as F

from evalloom.functions import keys as K
from evalloom.functions import linear, tokens
from evalloom.operators import cache, evaluate, families, quality, selection
from evalloom.sources import readers, sinks
from evalloom.streaming import scoring


def test_scoring_worked_example(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    yes = {"is_robust": True, "valid": True}
    lines = [{"id": "a", **yes}, {"id": "b", **yes}, {"id": "b", **yes}, {"id": "c", "is_robust": True, "valid": False}, {"id": "x", **yes}, {"id": "y", **yes}, {"id": "y", **yes}]
    p.write_text("\n".join(map(json.dumps, lines)) + "\n\n{bad\n")
    pred, bad = readers.load_predictions(spark, str(p))
    labels = spark.createDataFrame([(k, True) for k in "abcd"], "id string, is_robust boolean")
    r = evaluate.score(labels, pred, bad).first()
    assert (r.accuracy, r.coverage, r.invalid_predictions) == (0.25, 0.25, 8)
    for odd in ({"id": "a", "is_robust": True}, {"id": "a", "is_robust": True, "valid": 1}, {"id": "a", "is_robust": 1, "valid": True}):
        p.write_text(json.dumps(odd))
        r = evaluate.score(labels, *readers.load_predictions(spark, str(p))).first()
        assert (r.accuracy, r.coverage, r.invalid_predictions) == (0, 0, 4)


def test_strict_readers_reject(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    for body in ('{"id":"a","is_robust":1}', '{"id":"a","is_robust":true}\n{"id":"a","is_robust":true}', "[1]", '{"id":5,"is_robust":true}', ""):
        p.write_text(body)
        with pytest.raises(quality.DataQualityError):
            readers.load_labels(spark, str(p))
    p.write_text('{"id":"a","is_robust":true}\n\n{"id":"b","is_robust":false}')
    assert [tuple(r) for r in readers.load_labels(spark, str(p)).orderBy("_pos").collect()] == [(1, "a", True), (3, "b", False)]
    assert readers.load_predictions(spark, str(tmp_path / "none"))[1] == 0


def test_metrics_by_hand(spark):
    lp = [math.log(x) for x in (0.95, 0.5, 0.05)]
    rows = [("r", l, math.exp(l), e, p1, m, t, True) for l, e, p1, m, t in zip(lp, (0.1, 0.2, 0.3), (0.95, 0.5, 0.6), (0.9, 0.1, 0.3), (True, True, False))] + [("e", -1.0, 0.3, 0.1, 0.5, 0.1, True, False)]
    d = spark.createDataFrame(rows, "k string, log_prob double, prob double, entropy double, top1_prob double, margin double, is_top1 boolean, valid boolean")
    g = {r.k: r for r in tokens.generation_metrics(d, "k").collect()}
    r, mean = g["r"], sum(lp) / 3
    want = [mean, 0.5, -mean, math.exp(-mean), lp[2], lp[0], math.sqrt(sum((x - mean) ** 2 for x in lp) / 3), lp[2], 0.2, 2.05 / 3, 1.3 / 3, 2 / 3, 1 / 3, 1 / 3]
    names = "mean_logprob mean_prob mean_nll ppl min_logprob max_logprob std_logprob min_k_logprob mean_entropy mean_top1_prob mean_top2_margin frac_selected_is_top1 frac_high_conf_tokens frac_low_conf_tokens".split()
    assert tokens.METRICS == [f"generation_{n}" for n in names]
    assert r.generation_num_tokens == 3 and all(math.isclose(r[m], w) for m, w in zip(tokens.METRICS, want))
    assert g["e"].generation_num_tokens == 0 and all(math.isnan(g["e"][m]) for m in tokens.METRICS)


def test_threshold_edges(spark):
    d = spark.createDataFrame([(0.2, True), (0.4, True), (0.6, False), (0.6, False)], "score double, label boolean")
    b = selection.best_threshold(d).first()
    assert (b.threshold, b.balanced_accuracy, b.accuracy) == (0.5, 1.0, 1.0)
    t = sorted(r.threshold for r in selection.threshold_sweep(d).collect())
    assert t[0] == math.nextafter(0.2, -math.inf) and t[-1] == math.nextafter(0.6, math.inf)


def test_splits_are_disjoint_and_ranked(spark):
    d = spark.range(100).select((F.col("id") % 20).cast("string").alias("g"), (F.col("id") % 20 < 8).alias("y"))
    s = families.group_split(d, "g", 0.25, 1)
    assert {r[0]: r[1] for r in s.groupBy("split").count().collect()} == {"train": 15, "validation": 5}
    f = families.fold_assignment(d, "g", "y", 4)
    assert families.fold_leakage(f, "g").isEmpty() and f.count() == 20
    with pytest.raises(quality.DataQualityError):
        families.stratified(d.withColumn("id", F.monotonically_increasing_id()), "id", "y", 90, strict=True)


def test_cache_resumes(spark, tmp_path):
    seen = []

    def f(df):
        seen.append(df.count())
        return df.select("k", F.length("t").alias("n"))

    d = spark.createDataFrame([("a", "x"), ("b", "yy"), ("a", "x")], "k string, t string")
    path = str(tmp_path / "c")
    assert cache.resume(d.limit(1), path, "k", f).count() == 1
    assert {r.k: r.n for r in cache.resume(d, path, "k", f).collect()} == {"a": 1, "b": 2}
    assert seen == [1, 1]


def test_extractor_checks(spark):
    d = spark.createDataFrame([(1, "ab"), (2, "c")], "k long, t string")
    f = lambda texts: [[float(len(t)), 1.0] for t in texts]
    for batch in (1, 8):
        assert {r.k: r.features for r in cache.extract(d, "k", "t", f, batch).collect()} == {1: [2.0, 1.0], 2: [1.0, 1.0]}
    with pytest.raises(Exception, match="non-empty"):
        cache.extract(spark.createDataFrame([(1, " ")], "k long, t string"), "k", "t", f).collect()


def test_responses(spark):
    ok = [("f1", f"v{i:02d}", f"text {i}") for i in range(1, 11)]
    req = spark.createDataFrame([("f1", "orig"), ("f2", "o2")], "family_id string, original_problem string")
    v = spark.createDataFrame(ok[:9] + [("f1", "v11", " orig "), ("f3", "v01", "z")], "family_id string, variant_id string, problem string")
    r = {x.rule: x.violations for x in quality.check_response(v, req).collect()}
    assert r == {"wrong_count": 1, "wrong_ids": 2, "repeated_text": 0, "blank_text": 0, "missing_family": 1, "unexpected_family": 1, "equals_original": 1}
    q = spark.createDataFrame([('{"tasks":[{"family_id":"a","original_problem":"x"},{"family_id":"a","original_problem":" ","label":1}]}',)], "json string")
    assert {x.rule: x.violations for x in quality.check_request(q).collect()} == {"bad_id": 0, "blank_problem": 1, "bad_keys": 1, "duplicate_family": 1, "bad_document": 0}
    assert quality.forbidden_fields(spark.createDataFrame([], "a struct<label:int>, b array<struct<x:int,label:int>>").schema, frozenset({"label"})) == ["a.label", "b[].label"]


def test_string_lists_and_strip(spark):
    d = spark.createDataFrame([('["a","b"]',), ("plain",), ("5",), ("[]",), ("",)], "x string")
    assert [r[0] for r in d.select(readers.string_list(F.col("x"))).collect()] == [["a", "b"], ["plain"], None, None, None]
    s = spark.createDataFrame([(" \t x  \n",)], "x string")
    assert s.select(K.stripped(F.col("x"))).first()[0] == "x"


def test_sinks_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(2, "b", None), (1, "a", True)], "_pos long, id string, is_robust boolean")
    sinks.write_json_lines(d, str(tmp_path / "o"), "_pos")
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ['{"id":"a","is_robust":true}', '{"id":"b","is_robust":null}']
    sinks.write_json(str(tmp_path / "m.json"), {"b": 1, "a": "é"})
    assert (tmp_path / "m.json").read_text() == '{"a": "é", "b": 1}\n'


def test_pages_and_shards(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"rows": [{"row": {"x": i}}], "num_rows_total": 2, "partial": False}))
    paths = [str(tmp_path / f"p{i}.json") for i in range(2)]
    assert sorted(r.x for r in readers.read_pages(spark, paths).collect()) == [0, 1]
    with pytest.raises(quality.DataQualityError):
        readers.read_pages(spark, paths[:1])
    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "s"))
    assert readers.parquet_shards(spark, str(tmp_path / "s")).where("source_feature_file like '%.parquet'").count() == 2


def test_mlp_and_baseline(spark):
    d = spark.createDataFrame([([1.0, -1.0],)], "x array<double>")
    p = d.select(linear.mlp_probability([[1, 0], [0, 1]], [0, 0], [1, 1], 0)("x").alias("p")).first().p
    assert math.isclose(p, 1 / (1 + math.exp(-1)))
    c = spark.createDataFrame([(0, "i", "m", "p")], "_pos long, id string, model_id string, problem string")
    assert evaluate.run_batches(c, evaluate.constant).first().is_robust is True
    assert evaluate.run_batches(c, lambda m, p: [1]).first().valid is False


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"id":"a","is_robust":true,"valid":true,"ts":"2024-01-01T00:01:00"}\n{"id":"b","is_robust":true,"valid":false,"ts":"2024-01-01T00:02:00"}\n{"id":"c","is_robust":true,"valid":true,"ts":"2024-01-01T03:00:00"}')
    scoring.run_available(scoring.windowed_validity(scoring.read_stream(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = [(r.n, r.n_valid) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert (2, 1) in got


def test_artifacts_are_checked(spark, tmp_path):
    from evalloom.operators import artifacts as A

    fine = A.payload("a/b:c", A.GenerationConfig(), {"kind": "linear", "weights": [0.0] * len(tokens.METRICS), "bias": 0.5}, 0.5)
    for key, odd in (("schema_version", True), ("feature_names", fine["feature_names"][::-1]), ("decision_threshold", True), ("decision_threshold", float("nan")), ("model_id", ""), ("cv_results", []), ("estimator", {"kind": "pickle"}), ("generation_config", {"batch_size": 1})):
        with pytest.raises(quality.DataQualityError, match="invalid"):
            A.check(fine | {key: odd})
    root = f"file://{tmp_path}"
    assert A.load(spark, root, "a/b:c") is None
    assert A.export(spark, root, fine).threshold == 0.5 and A.export(spark, root, fine | {"decision_threshold": 0.25}).threshold == 0.25
    assert A.candidates(root, "a/b:c")[0] == f"{root}/a_b_c" and A.load(spark, root, "a/b_c") is None


def test_an_artifact_is_compared_on_one_sample(spark, tmp_path, monkeypatch):
    """The sample's rows are others in each job, as those of a limit over a shuffle may be."""
    import random

    from evalloom.operators import artifacts as A

    d = spark.range(200).select(F.col("id").cast("double").alias("n"), (F.col("id") % 7).cast("double").alias("y"))
    model = selection.pipeline(selection.Candidate("forest", 3, 4), ["n"], "y").fit(d)
    drawn = F.udf(lambda: random.SystemRandom().random() * 200, "double").asNondeterministic()
    sample = spark.range(50).select(drawn().alias("n"), F.lit(0.0).alias("y"))
    manifest, root = A.payload("m", A.GenerationConfig(), {"kind": "spark"}, 0.5), f"file://{tmp_path}"
    assert A.export(spark, root, manifest, model, sample).estimator.predict(d).count() == 200
    assert A.export(spark, root, manifest, model, d.limit(0)) is not None
    other, load = selection.pipeline(selection.Candidate("forest", 1, 1), ["n"], "y").fit(d), A.load
    monkeypatch.setattr(A, "load", lambda *a: A.Artifact("m", A.GenerationConfig(), A.Fitted(other), 0.5, manifest))
    with pytest.raises(quality.DataQualityError, match="otherwise"):
        A.export(spark, root, manifest, model, sample)
    assert load(spark, root, "m").estimator.predict(d).count() == 200  # the old one stays


def test_regressor_refuses_scores_that_are_not_finite(spark, tmp_path):
    from evalloom.operators import artifacts as A
    from evalloom.operators import inference

    root = f"file://{tmp_path}"
    A.export(spark, root, A.payload("m", A.GenerationConfig(), {"kind": "linear", "weights": [1.0] + [0.0] * (len(tokens.METRICS) - 1)}, 0.5))
    cases = spark.createDataFrame([("a", "m"), ("b", None), ("c", "unknown")], "id string, model_id string")
    feats = lambda value: lambda mine, config: mine.select("id", *[F.lit(value).alias(n) for n in tokens.METRICS])
    got = {r.id: r.is_robust for r in inference.regressor_predictions(cases, root, feats(0.25)).collect()}
    assert got == {"a": True, "b": False, "c": False}
    for odd in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite"):
            inference.regressor_predictions(cases, root, feats(odd)).collect()
    with pytest.raises(Exception, match="finite"):
        inference.regressor_predictions(cases, root, lambda mine, config: feats(0.1)(mine, config).limit(0)).collect()
    f = inference.as_function(spark, lambda c: inference.regressor_predictions(c, root, feats(0.25)))
    assert f("m", ["x", "y"]) == [True, True] and f("unknown", ["x"]) == [False] and f("m", []) == []


def test_probes_and_layers(spark):
    from evalloom.operators import inference

    cases = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r.is_robust for r in inference.probe_predictions(cases, None, 3, None).collect()] == [False, False]
    probes = spark.createDataFrame([(2, "a", [1.0, 1.0], 0.0, 0.0)], "layer int, probe string, weights array<double>, bias double, threshold double")
    encode = lambda c, layer: c.withColumn("features", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    with pytest.raises(quality.DataQualityError, match="no probes"):
        inference.probe_predictions(cases, probes, 3, encode)
    with pytest.raises(Exception, match="length"):
        inference.probe_predictions(cases, probes, 2, encode).collect()


def test_states_are_checked(spark):
    d = spark.createDataFrame([(1, "ab")], "k long, t string")
    ok = lambda texts: ([[0, 1, 1]] * len(texts), [[[[9.0], [1.0], [2.0]]] * len(texts)])
    right = lambda texts: ([[1, 1, 0]] * len(texts), [[[[9.0], [1.0], [2.0]]] * len(texts)])
    assert cache.extract_states(d, "k", "t", ok, [0]).first().features == [2.0] and cache.extract_states(d, "k", "t", right, [0]).first().features == [1.0]
    for layers in ([], [0, 0], [-1], [True]):
        with pytest.raises(ValueError, match="layers"):
            cache.extract_states(d, "k", "t", ok, layers)
    for llm, what in ((lambda t: ([[0, 0]], [[[[1.0], [1.0]]]]), "real token"), (lambda t: ([[0, 1]], [[[[1.0]]]]), "shape"), (lambda t: ([[0, 1]], []), "no such layer"), (lambda t: ([[0, 1]], [[[[1.0], [float("nan")]]]]), "finite")):
        with pytest.raises(Exception, match=what):
            cache.extract_states(d, "k", "t", llm, [0]).collect()


def test_study_checks_and_journal(spark, tmp_path):
    from evalloom.operators import study
    from evalloom.sources import files

    rows = spark.createDataFrame([("1", "f", "p", True), ("2", "g", "q", False)], "id string, family_id string, problem string, is_robust boolean")
    other = spark.createDataFrame([("3", "h", "q", False)], rows.schema)
    with pytest.raises(quality.DataQualityError, match="problem"):
        study.check_split(rows, other)
    with pytest.raises(quality.DataQualityError, match="classes"):
        study.check_split(rows.where("id = '1'"), other)
    root = f"file://{tmp_path}"
    with pytest.raises(quality.DataQualityError, match="name"), study.journal(spark, root, "../x", {}):
        pass
    with study.journal(spark, root, "a", {"rows": rows}) as record:
        record["note"] = 1
        with pytest.raises(Exception), study.journal(spark, root, "b", {}):  # the lock is held
            pass
    with pytest.raises(FileExistsError), study.journal(spark, root, "a", {}):
        pass
    got = json.loads(files.read_text(spark, f"{root}/a/result.json"))
    assert got["status"] == "completed" and got["note"] == 1 and not files.exists(spark, f"{root}/run.lock")
    head = study.train_head(rows.withColumn("features", F.when(F.col("is_robust"), F.array(F.lit(1.0))).otherwise(F.array(F.lit(-1.0)))), epochs=5)
    assert head.history[-1] <= head.history[0] and head.mean == [0.0] and head.std == [1.0]


def test_pages_end_early_change_or_are_partial(spark, tmp_path):
    page = lambda rows, total, **more: json.dumps({"rows": [{"row": {"x": i}} for i in rows], "num_rows_total": total} | more)
    for k, (pages, what) in enumerate([([page([0], 2), page([], 2)], "ended|rows"), ([page([0], 2), page([1], 3)], "changed"), ([page([0], 1, partial=True)], "partial"), ([page([0, 1], 1)], "of 1"), (['{"rows": [1], "num_rows_total": 1}'], "rows must be")]):
        paths = []
        for i, text in enumerate(pages):
            (tmp_path / f"{k}-{i}.json").write_text(text)
            paths.append(str(tmp_path / f"{k}-{i}.json"))
        with pytest.raises(quality.DataQualityError, match=what):
            readers.read_pages(spark, paths)
    for i in (2, 10):
        (tmp_path / f"p{i}.json").write_text(page([i], 2))
    assert [r.x for r in readers.read_pages(spark, [str(tmp_path / f"p{i}.json") for i in (2, 10)]).orderBy("_pos").collect()] == [2, 10]


def test_changed_sources_and_lost_keys(spark, tmp_path):
    reads = iter([spark.range(3), spark.range(4)])
    with pytest.raises(quality.DataQualityError, match="changed"):
        readers.verified(lambda: next(reads), "id")
    d = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, t string")
    with pytest.raises(quality.DataQualityError, match="not all keys"):
        cache.resume(d, str(tmp_path / "c"), "k", lambda df: df.where("k = 'a'").select("k"))


def test_participants_file(spark, tmp_path):
    from evalloom.operators import inference

    root = f"file://{tmp_path}"
    with pytest.raises(quality.DataQualityError, match="solution.py"):
        inference.participant(spark, root)
    (tmp_path / "solution.py").write_text("x = 1")
    with pytest.raises(quality.DataQualityError, match="are_robust"):
        inference.participant(spark, root)


def test_candidates_fill_gaps_inside_folds(spark):
    rows = [(str(i), i % 10, i % 10 < 5, float(i % 10 >= 5), None if i % 7 == 0 else float(i % 10)) for i in range(60)]
    d = spark.createDataFrame(rows, "id string, g int, y boolean, target double, n double")
    best, model, results, baseline = selection.select_model(d, ["n"], "g", "y", "target", selection.grid(("forest",), (3,), (1, 2)), folds=2)
    assert len(results) == 2 and best.identifier in [r["identifier"] for r in results] and model.transform(d).count() == 60
    assert max(r["balanced_accuracy"] for r in results) >= baseline["balanced_accuracy"]
    with pytest.raises(quality.DataQualityError, match="classes"):
        selection.select_model(d.where("y"), ["n"], "g", "y", "target", selection.grid(), folds=2)


def test_programs(spark, tmp_path, capsys):
    from evalloom import programs

    ask = {"tasks": [{"family_id": "f", "original_problem": "p"}]}
    good = {"tasks": [{"family_id": "f", "variants": [{"variant_id": f"v{i:02d}", "problem": f"q{i}"} for i in range(1, 11)]}]}
    bad = {"tasks": [{"family_id": "f", "variants": good["tasks"][0]["variants"][:9]}, {"family_id": "g", "variants": []}]}
    for name, x in (("ask", ask), ("good", good), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
    root = f"file://{tmp_path}"
    assert programs.main(["respond", f"{root}/ask.json", f"{root}/good.json"]) == 0
    assert programs.main(["respond", f"{root}/ask.json", f"{root}/bad.json"]) == 1
    assert {r["rule"] for r in json.loads(capsys.readouterr().out.strip().splitlines()[-1])} >= {"wrong_count", "wrong_ids", "unexpected_family"}
    with pytest.raises(quality.DataQualityError, match="fraction"):
        programs.split(spark, f"{root}/x.jsonl", f"{root}/out", 1.0, 0)
    spark.createDataFrame([("a", "f", "p", True), ("b", "f", "q", True)], "id string, family_id string, problem string, is_robust boolean").write.json(f"{root}/one.jsonl")
    with pytest.raises(quality.DataQualityError, match="two families"):
        programs.split(spark, f"{root}/one.jsonl", f"{root}/out", 0.5, 0)


def test_id_sets():
    assert K.id_set(None) == [] and K.id_set(3) == [3] and K.id_set([2, 1, 2]) == [1, 2]
    with pytest.raises(TypeError):
        K.id_set(True)
