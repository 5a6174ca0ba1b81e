"""Model suites on MLlib. A suite is names and ways to make an estimator; sizes are options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    """Sizes of trees and forests. Depth 30 is the deepest that MLlib grows."""

    trees: int = 200
    depth: int = 30
    forest_depth: int = 12
    bins: int = 64
    seed: int = 42
    iterations: int = 500


def task_of(problem_type: str) -> str:
    plain = (problem_type or "").strip().lower()
    found = next((k for k in ("regression", "classification") if k in plain), None)
    if not found:
        raise ValueError(f"Unsupported problem type for training: {problem_type}")
    return found


def _columns(estimator):
    return estimator.setFeaturesCol("features").setLabelCol("label").setPredictionCol("prediction")


def suite(problem_type: str, rows: int, o: Options = Options()) -> list[tuple[str, object]]:
    """The three models of a task. Least squares without penalty; logistic with the penalty that C = 1 is."""
    if task_of(problem_type) == "regression":
        made = [
            ("LinearRegression", R.LinearRegression(regParam=0.0, solver="normal")),
            ("DecisionTreeRegressor", R.DecisionTreeRegressor(maxDepth=o.depth, maxBins=o.bins, seed=o.seed)),
            ("RandomForestRegressor", R.RandomForestRegressor(numTrees=o.trees, maxDepth=o.forest_depth, maxBins=o.bins, featureSubsetStrategy="all", seed=o.seed)),
        ]
    else:
        made = [
            ("LogisticRegression", C.LogisticRegression(maxIter=o.iterations, regParam=1.0 / max(1, rows), elasticNetParam=0.0, standardization=False)),
            ("DecisionTreeClassifier", C.DecisionTreeClassifier(maxDepth=o.depth, maxBins=o.bins, impurity="gini", seed=o.seed)),
            ("RandomForestClassifier", C.RandomForestClassifier(numTrees=o.trees, maxDepth=o.forest_depth, maxBins=o.bins, featureSubsetStrategy="sqrt", seed=o.seed)),
        ]
    return [(name, _columns(e)) for name, e in made]


def legacy_suite(problem_type: str, seed: int = 42) -> list[tuple[str, object]]:
    """Smaller models: ridge-steadied least squares or one-vs-rest logistic, trees of depth 5, forests of 5 trees."""
    small = {"maxDepth": 5, "minInstancesPerNode": 5, "maxBins": 21, "seed": seed}
    if task_of(problem_type) == "regression":
        made = [
            ("Linear Regression", R.LinearRegression(regParam=1e-8, elasticNetParam=0.0, standardization=False)),
            ("Decision Tree", R.DecisionTreeRegressor(**small)),
            ("Random Forest", R.RandomForestRegressor(numTrees=5, featureSubsetStrategy="sqrt", **small)),
        ]
    else:
        one = C.LogisticRegression(maxIter=200)
        made = [
            ("Logistic Regression", C.OneVsRest(classifier=one)),
            ("Decision Tree", C.DecisionTreeClassifier(impurity="gini", **small)),
            ("Random Forest", C.RandomForestClassifier(numTrees=5, featureSubsetStrategy="sqrt", **small)),
        ]
    return [(name, _columns(e)) for name, e in made]


def assembled(df: DataFrame, features: list[str], label: str | None = "_label") -> DataFrame:
    """features as one vector; label as a double. Names with dots or other marks are taken by place."""
    plain = {f: f"_f{k}" for k, f in enumerate(features)}
    kept = [c for c in df.columns if c not in plain]
    named = df.select(*(F.col("`" + c.replace("`", "``") + "`") for c in kept), *(F.col("`" + f.replace("`", "``") + "`").cast("double").alias(p) for f, p in plain.items()))
    out = VectorAssembler(inputCols=[*plain.values()], outputCol="features", handleInvalid="error").transform(named).drop(*plain.values())
    return out.withColumn("label", F.col(label).cast("double")) if label in df.columns else out


def train(rows: DataFrame, problem_type: str, models: list[tuple[str, object]] | None = None, options: Options = Options(), on_model: Callable[[str], None] | None = None) -> dict:
    """Fits every model of the suite on rows (features, label); a failure is told of and the others go on."""
    trained, errors = {}, []
    rows = rows.select("features", "label").persist()
    try:
        if models is None:
            models = suite(problem_type, rows.count(), options)
        for name, estimator in models:
            try:
                trained[name] = estimator.fit(rows)
                if on_model:
                    on_model(name)
            except Exception as e:  # tolerated, as one model must not stop the others
                errors.append({"model_name": name, "error": str(e)})
    except ValueError as e:
        errors.append({"model_name": None, "error": str(e)})
    finally:
        rows.unpersist()
    return {"trained_models": trained, "model_names": [*trained], "status": "Failed" if not trained else "Completed with errors" if errors else "Completed", "training_errors": errors}
