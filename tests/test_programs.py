"""Programs over folders: importing and preparing source rows, fitting and exporting, judging a submission."""

import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from evalloom import preparation, programs, training
from evalloom.functions.tokens import METRICS
from evalloom.operators import artifacts, evaluate, inference, networks, quality, selection, study
from evalloom.sources import files, readers

canonical = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def row(i, permutation=("plain",), **change):
    return {"model_id": f"m{i % 2}", "dataset_id": "d|é", "problem_id": str(i // 2), "original_problem": f"p {i // 2}", "model_is_robust": i % 3 == 0, "permutation_type": permutation} | change


def lines(folder, name="cases.jsonl"):
    return [json.loads(x) for f in sorted((folder / name).glob("part-*")) for x in f.read_text().splitlines()]


def test_import_makes_a_dataset_of_rows(spark, tmp_path):
    rows = [row(i, p) for i in range(9) for p in (["a", "b"], '["a", "b"]', "plain")]
    random.Random(1).shuffle(rows)
    (tmp_path / "rows.json").write_text(json.dumps({"rows": [{"row": r} for r in rows]}))
    root = f"file://{tmp_path}"
    assert programs.main(["import", f"{root}/rows.json", f"{root}/out", "--dataset", "some/set"]) == 0
    keys = sorted({(r["model_id"], r["dataset_id"], r["problem_id"], tuple(["a", "b"] if r["permutation_type"] in (["a", "b"], '["a", "b"]') else [r["permutation_type"]])) for r in rows})
    cases, labels = lines(tmp_path / "out" / "input"), lines(tmp_path / "out" / "reference", "labels.jsonl")
    told = json.loads((tmp_path / "out" / "metadata.json").read_text())
    assert [(c["model_id"], c["problem"]["permutation_type"]) for c in cases] == [(k[0], list(k[3])) for k in keys]
    assert [c["id"] for c in cases] == ["case-" + hashlib.sha256(canonical([k[0], k[1], k[2], list(k[3])]).encode()).hexdigest()[:24] for k in keys] == [y["id"] for y in labels]
    assert (told["source_rows"], told["cases"], told["duplicate_rows_removed"], told["dataset"]) == (len(rows), len(keys), len(rows) - len(keys), "some/set")
    assert told["label_counts"]["true"] == sum(y["is_robust"] for y in labels)


@pytest.mark.parametrize(("change", "said"), [
    ({"model_id": ""}, "model_id"), ({"problem_id": 5}, "problem_id"), ({"original_problem": None}, "original_problem"), ({"model_is_robust": 1}, "model_is_robust"),
    ({"permutation_type": []}, "permutation_type"), ({"permutation_type": ["a", ""]}, "permutation_type"), ({"permutation_type": ["a", 1]}, "permutation_type"), ({"permutation_type": "5"}, "permutation_type"), ({"permutation_type": '"5"'}, "permutation_type"), ({"permutation_type": None}, "permutation_type"),
    ({"original_problem": "other"}, "two problem"), ({"model_is_robust": False}, "two labels"),
])
def test_import_refuses_rows(spark, tmp_path, change, said):
    (tmp_path / "rows.jsonl").write_text("\n".join(map(json.dumps, [row(0), row(1), row(0) | change])))
    with pytest.raises(quality.DataQualityError, match=said):
        preparation.import_rows(spark, f"file://{tmp_path}/rows.jsonl", f"file://{tmp_path}/out")
    assert not (tmp_path / "out" / "metadata.json").exists()


def test_prepare_asks_for_variants_without_labels(spark, tmp_path):
    rows = [row(2 * i, model_id="m", model_is_robust=i % 2 == 0, problem_id=str(i), original_problem=f"p {i}") for i in range(80)] * 2
    (tmp_path / "rows.jsonl").write_text("\n".join(map(json.dumps, rows)))
    root = f"file://{tmp_path}"
    made = preparation.prepare(spark, f"{root}/rows.jsonl", f"{root}/out", dataset="some/set")
    family = {"f" + hashlib.sha256(canonical(["d|é", str(i)]).encode()).hexdigest()[:12]: i for i in range(80)}
    by_hash = lambda fs: sorted(fs, key=lambda f: hashlib.sha256(f.encode()).hexdigest())
    sides = {y: by_hash([f for f, i in family.items() if (i % 2 == 0) is y])[:25] for y in (True, False)}
    pilot = by_hash(sides[True][:3] + sides[False][:2])
    order = pilot + by_hash(sides[True][3:] + sides[False][2:])
    whole = json.loads((tmp_path / "out/requests/study50.json").read_text())
    assert [t["family_id"] for t in whole["tasks"]] == order and set(whole["tasks"][0]) == {"family_id", "original_problem"}
    assert len(list((tmp_path / "out/requests/batches").glob("batch-*.json"))) == 10
    assert [t["family_id"] for t in json.loads((tmp_path / "out/requests/batches/batch-01.json").read_text())["tasks"]] == pilot
    assert [t["family_id"] for t in lines(tmp_path / "out/source", "all_original_tasks.jsonl")] == by_hash(family)
    assert made["input_sha256"]["study50"] == hashlib.sha256(canonical(whole).encode()).hexdigest() and made["study_historic_label_counts"] == {"false": 25, "true": 25}
    assert {t["source_rows"] for t in lines(tmp_path / "out", ".source-mapping.jsonl")} == {2}
    assert made["source_rows"] == 160 and made["families"] == 80 and made["family_historic_label_counts"] == {"false": 40, "true": 40}
    for change, said in (({"model_id": "n"}, "one model"), ({"original_problem": "x"}, "two texts"), ({"model_is_robust": False}, "two labels")):
        (tmp_path / "bad.jsonl").write_text("\n".join(map(json.dumps, [*rows, rows[0] | change])))
        with pytest.raises(quality.DataQualityError, match=said):
            preparation.prepare(spark, f"{root}/bad.jsonl", f"{root}/bad")
    (tmp_path / "few.jsonl").write_text("\n".join(map(json.dumps, rows[:40])))
    with pytest.raises(quality.DataQualityError, match="fewer than 25"):
        preparation.prepare(spark, f"{root}/few.jsonl", f"{root}/bad")


def features(spark, n=60, **change):
    rng = random.Random(2)
    rows = [tuple(rng.random() + (i % 2) for _ in METRICS) + (min(1.0, max(0.0, 0.1 + 0.7 * (i % 2) + rng.random() / 10)), i % 2 == 0, f"t{i // 2 * 2 + i % 2}", "fm/x", json.dumps(artifacts.asdict(artifacts.GenerationConfig())), "ds", "rev", f"m{i % 3}") for i in range(n)]
    kinds = ", ".join(f"{m} double" for m in METRICS) + ", absolute_accuracy_decay double, model_is_robust boolean, original_problem string, feature_model_id string, generation_config_json string, source_dataset string, source_revision string, model_id string"
    d = spark.createDataFrame(rows, kinds)
    return d.withColumns({k: F.expr(v) for k, v in change.items()})


def test_fit_selects_exports_and_reports(spark, tmp_path):
    root = f"file://{tmp_path}"
    d = features(spark)
    d.where("model_id = 'm0'").coalesce(1).write.parquet(f"{root}/shards/a.parquet")
    d.where("model_id <> 'm0'").coalesce(1).write.parquet(f"{root}/shards/b.parquet")
    d.limit(3).coalesce(1).write.parquet(f"{root}/shards/c.partial.parquet")
    grid = selection.grid(("boosted", "extra", "forest"), (2,), (2,))
    flat = tmp_path / "flat"
    flat.mkdir()
    for n in "ab":
        next((tmp_path / f"shards/{n}.parquet").glob("part-*")).rename(flat / f"{n}.parquet")
    next((tmp_path / "shards/c.partial.parquet").glob("part-*")).rename(flat / "c.partial.parquet")
    made = training.fit(spark, f"{root}/flat", f"{root}/artifacts", f"{root}/results.json", 2, 42, grid)
    assert json.loads((tmp_path / "results.json").read_text()) == json.loads(json.dumps(made))
    assert made["training_provenance"]["row_count"] == 60 and made["training_provenance"]["source_model_ids"] == ["m0", "m1", "m2"] and len(made["cv_results"]["candidates"]) == 3
    back = artifacts.load(spark, f"{root}/artifacts", "fm/x")
    right = back.estimator.predict(d).where((F.col("score") < back.threshold) == F.col("model_is_robust")).count()
    assert right > 50 and made["artifact_sha256"]


@pytest.mark.parametrize(("change", "said"), [
    ({"absolute_accuracy_decay": "if(original_problem = 't3', 1.5D, absolute_accuracy_decay)"}, "finite number"), ({"absolute_accuracy_decay": "double('nan')"}, "finite number"), ({"model_is_robust": "if(original_problem = 't3', null, model_is_robust)"}, "without value"),
    ({"original_problem": "if(original_problem = 't3', null, original_problem)"}, "without value"), ({"original_problem": "'one'"}, "two labels"), ({"model_is_robust": "true"}, "classes"), ({"source_revision": "model_id"}, "source_revision"), ({"model_is_robust": "1"}, "booleans"),
])
def test_fit_refuses_rows(spark, change, said):
    with pytest.raises(quality.DataQualityError, match=said):
        training.check_features(features(spark, **change), 2)


def test_a_runs_head_goes_out_as_a_submission(spark, tmp_path):
    root = f"file://{tmp_path}"
    d = spark.createDataFrame([(i, [float(i), float(i % 5)], i > 20) for i in range(40)], "k long, features array<double>, is_robust boolean")
    with study.journal(spark, root, "run", {"train": d}, {"model": "qwen3-8b:low"}, {"head.json": f"{root}/run/head.json"}) as record:
        head = networks.train(d, "k", width=3, epochs=2, batch=20, rate=0.1)
        record["train_loss"] = head.history
        files.write_text(spark, f"{root}/run/head.json", json.dumps(head.record()))
    (tmp_path / "extractor.py").write_text("def features(problems):\n    return [[float(len(p)), float(len(p) % 5)] for p in problems]\n")
    assert programs.main(["export", root, "run", f"{root}/extractor.py", f"{root}/out.zip"]) == 0
    cases = spark.createDataFrame([(i, f"c{i}", m, "x" * (i + 1)) for i, m in enumerate(["qwen3-8b:low", "deepseek-ai/DeepSeek-R1-0528-Qwen3-8B", "other"] * 10)], "_pos long, id string, model_id string, problem string")
    got = {r.id: (r.is_robust, r.valid) for r in evaluate.run_batches(cases, inference.participant(spark, f"{root}/out.zip")).collect()}
    x = cases.select("id", "model_id", F.array(F.length("problem").cast("double"), (F.length("problem") % 5).cast("double")).alias("features"))
    want = {r.id: (r.is_robust, True) if r.model_id != "other" else (False, False) for r in head.predict(x).collect()}
    assert got == want and len({v for v, _ in want.values()}) == 2
    with pytest.raises(Exception):
        training.export_run(spark, root, "run", "x = 1", f"{root}/out.zip")  # it exists
    with pytest.raises(SyntaxError):
        training.export_run(spark, root, "run", "def", f"{root}/two.zip")
    files.write_text(spark, f"{root}/run/head.json", "{}")
    with pytest.raises(quality.DataQualityError, match="recorded"):
        training.export_run(spark, root, "run", "x = 1", f"{root}/two.zip")
    with pytest.raises(ZeroDivisionError), study.journal(spark, root, "broken", {}, {"model": "m"}):
        1 / 0
    with pytest.raises(quality.DataQualityError, match="failed"):
        training.export_run(spark, root, "broken", "x = 1", f"{root}/two.zip")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../solution.py", "x = 1")
    with pytest.raises(quality.DataQualityError, match="in its folder"):
        inference.participant(spark, f"{root}/bad.zip")


def test_judge_runs_and_scores_a_submission(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "solution.py").write_text("def are_robust(m, ps):\n    return [len(p) > 3 for p in ps] if m == 'a' else [1] * len(ps)\n")
    (tmp_path / "cases.jsonl").write_text("\n".join(json.dumps({"id": str(i), "model_id": "a" if i < 6 else "b", "problem": "x" * (i + 1)}) for i in range(8)))
    (tmp_path / "labels.jsonl").write_text("\n".join(json.dumps({"id": str(i), "is_robust": i > 3}) for i in range(8)))
    root = f"file://{tmp_path}"
    got = programs.judge(spark, f"{root}/cases.jsonl", f"{root}/labels.jsonl", f"{root}/s", f"{root}/out")
    assert got == {"cases": 8, "invalid_predictions": 2, "accuracy": 5 / 8, "coverage": 6 / 8} and json.loads((tmp_path / "out/scores.json").read_text())["accuracy"] == 5 / 8


def test_a_submission_is_called_once_a_model(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "calls").mkdir()
    (tmp_path / "s" / "solution.py").write_text(f"import uuid\ndef are_robust(m, ps):\n    open({str(tmp_path / 'calls')!r} + '/' + m + uuid.uuid4().hex, 'w').close()\n    return [True] * len(ps)\n")
    (tmp_path / "cases.jsonl").write_text("\n".join(json.dumps({"id": str(i), "model_id": f"m{i % 3}", "problem": "p"}) for i in range(30)))
    root = f"file://{tmp_path}"
    programs.ingest(spark, root, f"{root}/out", f"{root}/s")
    assert sorted(p.name[:2] for p in (tmp_path / "calls").iterdir()) == ["m0", "m1", "m2"]
    assert [x["id"] for x in lines(tmp_path / "out", "predictions.jsonl")] == [str(i) for i in range(30)]


@pytest.fixture
def two_labels(spark, tmp_path):
    """Tables in which one text has two labels and another is a line end; DuckDB with them as views."""
    import duckdb

    texts = [f"text {i}" for i in range(20)] + ["text 3", "\n", "text 7", "text 7", None, "  "]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0 or i == 20), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return str(tmp_path), duck


@pytest.mark.parametrize("name", ["study_rows", "split_study"])
def test_studies_keep_texts_with_two_labels(spark, two_labels, name):
    from evalloom.plans import catalog

    folder, duck = two_labels
    got = catalog.queries()[name](spark, folder)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) and got.count() == 24


def test_texts_with_two_labels_stay_if_asked_for(spark, tmp_path):
    one = lambda i, label, family="f": json.dumps({"id": i, "problem": "p", "is_robust": label, "family_id": family})
    (tmp_path / "a.jsonl").write_text("\n".join([one("a", True), one("b", False)]))
    (tmp_path / "b.jsonl").write_text("\n".join([one("a", True), one("b", True, "g")]))
    with pytest.raises(quality.DataQualityError, match="two families or labels"):
        readers.read_study(spark, f"{tmp_path}/a.jsonl")
    assert sorted((r.id, r.is_robust) for r in readers.read_study(spark, f"{tmp_path}/a.jsonl", mixed=True).collect()) == [("a", True), ("b", False)]
    with pytest.raises(quality.DataQualityError, match="two families"):
        readers.read_study(spark, f"{tmp_path}/b.jsonl", mixed=True)
