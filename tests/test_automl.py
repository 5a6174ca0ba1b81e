"""A, E, F, G, H, I: sources, preparation, split, models, metrics, pipeline, store, service, streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tabloom.operators import metrics, models, prepare
from tabloom.operators.models import Options
from tabloom.plans import automl
from tabloom.plans.service import Service, ServiceError
from tabloom.sources import store, tabular

SMALL = Options(trees=3, depth=4, forest_depth=3, iterations=50)


def csv(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder / name)


def test_csv_types_t10_and_encodings(spark, tmp_path):
    df = tabular.load(spark, csv(tmp_path, "a.csv", "a,b,c,d,e\n1,1,x,True,\n2,NA,é,False,\n3,2,\"y,z\",True,\n"))
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "boolean"), ("e", "double")]
    latin = tabular.load(spark, csv(tmp_path, "l.csv", "a,b\né,1\n", "latin-1"))
    assert latin.first()["a"] == "é"
    with pytest.raises(ValueError, match="Unsupported file format"):
        tabular.load(spark, "x.txt")


def test_xlsx(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>n</t></is></c><c r="B1" t="inlineStr"><is><t>s</t></is></c><c r="C1" t="inlineStr"><is><t>g</t></is></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2" t="inlineStr"><is><t>x</t></is></c></row><row r="3"><c r="A3"><v>2</v></c><c r="B3" t="inlineStr"><is><t>y</t></is></c><c r="C3"><v>2.5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    df = tabular.load(spark, str(tmp_path / "b.xlsx"))
    assert df.dtypes == [("n", "bigint"), ("s", "string"), ("g", "double")]
    assert [tuple(r) for r in df.collect()] == [(1, "x", None), (2, "y", 2.5)]


def test_files(spark, tmp_path):
    from tabloom.plans.service import analyze_file, validate_file

    path = csv(tmp_path, "f.csv", "a,b\n1,x\n1,x\n")
    assert validate_file(spark, path)["valid"] and not validate_file(spark, "f.doc")["valid"]
    assert analyze_file(spark, path)["quality"]["duplicate_rows"] == 1
    with pytest.raises(AttributeError):
        metrics.predicted(object(), None)


def test_legacy_fill_and_store(spark, tmp_path):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "x double, c string")
    assert [tuple(r) for r in prepare.fill_all(df).collect()] == [(1.0, "<missing>"), (2.0, "<missing>"), (3.0, "<missing>")]
    rows = models.assembled(spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "x double, _label double"), ["x"])
    model = models.legacy_suite("Regression")[0][1].fit(rows)
    assert store.save_legacy(model, "sales.csv", tmp_path).endswith("sales") and store.save_legacy(model, "sales.csv", tmp_path)
    assert prepare.stratifies(df.select(F.lit("a").alias("t")), "t") and not prepare.stratifies(df, "x", "Regression")


def test_safe_paths(tmp_path):
    assert tabular.safe_path(tmp_path, "a.csv").parent == tmp_path.resolve()
    for bad in ("../a.csv", "a/b.csv", "", ".."):
        with pytest.raises(ValueError):
            tabular.safe_path(tmp_path, bad)


def test_encoders_and_order_t20(spark):
    data = [("r" if i % 2 else "g", f"v{i % 12:02d}", float(i % 5), i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "color string, kind string, x double, y long")
    prep = prepare.fit(df, "y")
    assert prep.features == ["kind", "x", "color_g", "color_r"]
    new = spark.createDataFrame([("blue", "zz", 1.0)], "color string, kind string, x double")
    assert list(prepare.apply(new, prep).first()) == [-1.0, 1.0, 0.0, 0.0]


def test_fills_and_classes(spark):
    df = spark.createDataFrame([(1.0, "a", "n"), (None, None, "y"), (3.0, "a", "n"), (3.0, "a", None), (None, "b", "n")], "x double, c string, t string")
    prep = prepare.fit(df, "t")
    assert prep.numeric_fills == {"x": 2.0} and prep.text_fills == {"c": "a"} and prep.classes == ["n", "y"]
    with pytest.raises(ValueError):
        prepare.fit(df, "none")


def test_split_sizes_and_determinism(spark):
    df = spark.range(100).select(F.col("id").alias("_rid"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    train, test = prepare.split(df, "y", 0.25, 7)
    ids = lambda x: {r["_rid"] for r in x.collect()}
    assert len(ids(test)) == 25 and len(ids(train)) == 75 and not ids(train) & ids(test)
    assert ids(test) == ids(prepare.split(df, "y", 0.25, 7)[1]) and test.where("y = 1").count() in (2, 3)
    single = df.withColumn("y", F.when(F.col("_rid") == 5, 9).otherwise(0))
    assert prepare.split(single, "y", 0.2)[1].count() == 20  # E14: a class of one row


def test_first_seen(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string").coalesce(1)
    assert [r["k"] for r in prepare.first_seen_codes(df, "c", "k")[0].orderBy("_rid").collect()] == [0, 1, 2, 0]
    assert prepare.first_seen_one_hot(df, "c").columns == ["c_b", "c_a", "c_<missing>"]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (2.0, 2.0)], "label double, prediction double")
    w, m = metrics.classification(df).first(), metrics.macro(df).first()
    assert w["accuracy"] == 0.75 and abs(w["precision"] - (0.5 * 1 + 2 * 1 + 1 * 1) / 4) < 1e-9
    assert abs(m["precision"] - (0.5 + 1 + 1) / 3) < 1e-9 and abs(m["recall"] - (1 + 0.5 + 1) / 3) < 1e-9
    r = metrics.regression(df).first()
    assert abs(r["mae"] - 0.25) < 1e-9 and abs(r["rmse"] - 0.5) < 1e-9
    flat = spark.createDataFrame([(1.0, 1.0)], "label double, prediction double")
    assert metrics.regression(flat).first()["r2"] == 1.0


def test_selection():
    r = [{"model_name": "a", "metrics": {"rmse": 2.0}}, {"model_name": "b", "metrics": {"rmse": 1.0}}, {"model_name": "c", "metrics": {"rmse": 1.0}}]
    assert metrics.select_best(r, "Regression")["best_model_name"] == "b"
    assert metrics.select_best([], "Regression")["status"] == "Failed"
    assert metrics.select_best(r, "Classification")["status"] == "Failed"
    assert metrics.select_best_legacy([{"model_name": "a", "metrics": {"f1_score": 0.5}}], "Classification")["best_model_name"] == "a"
    with pytest.raises(ValueError):
        metrics.select_best(r, "Clustering")


def test_suites_tolerate_failures(spark):
    df = models.assembled(spark.createDataFrame([(float(i), float(i % 2)) for i in range(40)], "x double, _label double"), ["x"])

    class Broken:
        def fit(self, rows):
            raise RuntimeError("no")

    out = models.train(df, "Regression", [("Broken", Broken()), *models.suite("Regression", 40, SMALL)])
    assert out["status"] == "Completed with errors" and len(out["trained_models"]) == 3
    legacy = models.train(df, "Binary Classification", models.legacy_suite("Binary Classification"))
    assert legacy["model_names"] == ["Logistic Regression", "Decision Tree", "Random Forest"]
    assert metrics.evaluate(legacy["trained_models"], df, "Classification", legacy=True)["results"][0]["metrics"]["f1_score"] <= 1
    assert models.train(df, "Clustering")["status"] == "Failed"


def test_task_names_t25(spark):
    df = spark.createDataFrame([(1,)], "t long")
    assert automl.normalized_task("binary classification", df, "t") == "Binary Classification"
    assert automl.normalized_task("classification", df, "t") == "Multi-class Classification"
    with pytest.raises(ValueError):
        automl.normalized_task("clustering", df, "t")


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("svc")
    return Service(spark, root / "uploads", root / "models", SMALL)


def test_train_predict_and_serve(spark, service, tmp_path):
    text = "feature_1,feature_2,feature_3,color,target\n" + "\n".join(f"{i % 7},{3 * i % 5},{i / 2},{'red' if i % 2 else 'blue'},{int(i % 2 == 0)}" for i in range(120))
    up = service.upload(csv(tmp_path, "binary.csv", text))
    assert up["message"] == "stored" and up["automl_recommendation"]["recommended_target"] == "target"
    r = service.train({"filename": "binary.csv", "target_column": "target"})
    assert list(r) == ["status", "filename", "target_column", "problem_type", "data", "preprocessing", "models", "evaluation", "best_model", "model"]
    assert r["status"] == "success" and r["data"]["test_rows"] == 24 and "feature_3" in r["preprocessing"]["removed_columns"] and "encoders" not in r["preprocessing"]
    ask = {"feature_1": 1, "feature_2": 2, "color": "blue", "extra": 9}
    p = service.predict({"model_id": r["model"]["model_id"], "data": [ask, ask | {"color": "never seen"}]})
    assert p["predictions"][0] == 1 and p["prediction_count"] == 2 and abs(sum(p["probabilities"][0]) - 1) < 1e-9
    for bad, status in (([], 400), ([{"color": "red"}], 400), ([ask | {"target": 1}], 400), ([ask | {"feature_1": None}], 400)):
        with pytest.raises(ServiceError) as e:
            service.predict({"model_id": r["model"]["model_id"], "data": bad})
        assert e.value.status == status


def test_fallback_serves_t3_t4(spark, service, tmp_path):
    text = "feature_1,feature_2,target\n" + "\n".join(f"{1.5 * i},{2.0 * i},{3.0 * i}" for i in range(80))
    service.upload(csv(tmp_path, "reg.csv", text))
    r = service.train({"filename": "reg.csv", "target_column": "target"})
    assert r["problem_type"] == "Regression" and r["preprocessing"]["fallback_used"] and r["best_model"]["selection_metric"] == "rmse"
    p = service.predict({"model_id": r["model"]["model_id"], "data": [{"feature_1": 15.0, "feature_2": 20.0}]})
    assert abs(p["predictions"][0] - 30.0) < 6


def test_text_target_gives_labels_t18(spark, tmp_path):
    df = spark.createDataFrame([(i % 4, "yes" if i % 4 > 1 else "no") for i in range(60)], "x long, outcome string")
    r = automl.run(df, "outcome", options=SMALL, folder=tmp_path)
    p = automl.predict(spark, store.load(r["model"]["model_id"], tmp_path), [{"x": 3}, {"x": 0}])
    assert p["predictions"] == [1, 0] and p["predicted_labels"] == ["yes", "no"]


def test_all_models_failing_is_a_result(spark, tmp_path):
    class Broken:
        def fit(self, rows):
            raise RuntimeError("no")

    df = spark.createDataFrame([(i % 5, i % 2) for i in range(40)], "x long, y long")
    r = automl.run(df, "y", suite=[("Broken", Broken())], folder=tmp_path)
    assert r["status"] == "failed" and r["best_model"]["name"] is None and r["models"]["failed"][0]["model_name"] == "Broken"


def test_guards(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    for target in (None, " ", "zz"):
        with pytest.raises(ValueError):
            automl.run(df, target)
    with pytest.raises(ValueError):
        automl.run(df.limit(0), "a")


def test_store_guards(tmp_path):
    for bad in ("", "../x", "a b"):
        with pytest.raises(ValueError):
            store.load(bad, tmp_path)
    with pytest.raises(FileNotFoundError):
        store.load("automl_1", tmp_path)
    assert store.new_id() != store.new_id() and store.json_safe({1: (float("nan"), {2})}) == {"1": [None, [2]]}


def test_service_statuses(service):
    cases = [({"filename": "none.csv", "target_column": "t"}, 404), ({"filename": "../x.csv", "target_column": "t"}, 422), ({"filename": "a.csv", "target_column": "t", "test_size": 1.0}, 422)]
    for request, status in cases:
        with pytest.raises(ServiceError) as e:
            service.train(request)
        assert e.value.status == status
    with pytest.raises(ServiceError) as e:
        service.predict({"model_id": "missing_model_id", "data": [{"a": 1}]})
    assert e.value.status == 404 and "message" in Service.health()
    with pytest.raises(ServiceError):
        service.upload("x.txt")


def test_scoring_a_stream(spark, tmp_path):
    from tabloom.streaming.scoring import start

    df = spark.createDataFrame([(i % 4, "yes" if i % 4 > 1 else "no") for i in range(60)], "x long, outcome string")
    package = store.load(automl.run(df, "outcome", options=SMALL, folder=tmp_path)["model"]["model_id"], tmp_path)
    df.select("x").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x long").parquet(str(tmp_path / "in"))
    start(stream, package, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
