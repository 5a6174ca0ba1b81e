"""Metrics and selection. Each metric set is one aggregate over (label, prediction) rows, or over their confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """One row: mae, rmse, r2 (1 or 0 where the labels do not vary)."""
    e = F.col(y) - F.col(p)
    sums = df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"))
    return sums.select("mae", "rmse", F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide("sse", "sst")).alias("r2"))


def confusion(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """(label, prediction, n): as many rows as there are pairs of classes."""
    return df.groupBy(F.col(y).cast("double").alias("label"), F.col(p).cast("double").alias("prediction")).agg(F.count("*").alias("n"))


def by_class(counts: DataFrame) -> DataFrame:
    """(class, tp, support, predicted, precision, recall, f1) for every class of either side; 0 for what has no rows."""
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )))
    sums = sides.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "support", "predicted")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = sums.withColumn("precision", zero(F.try_divide("tp", "predicted"))).withColumn("recall", zero(F.try_divide("tp", "support")))
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def classification(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """One row: accuracy, and precision, recall, f1_score weighted by the classes' rows."""
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    return by_class(confusion(df, y, p)).agg(F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"), weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1_score"))


def macro(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """One row: accuracy, macro precision and recall over all classes of either side, and the harmonic mean of these two as f1_score."""
    out = by_class(confusion(df, y, p)).agg(F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    return out.withColumn("f1_score", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def predicted(model, rows: DataFrame) -> DataFrame:
    """rows with the model's prediction; what cannot predict is refused."""
    if not hasattr(model, "transform"):
        raise AttributeError(f"{type(model).__name__} cannot predict.")
    return model.transform(rows)


def _task(task: str) -> str:
    plain = (task or "").strip().lower()
    found = next((k for k in ("regression", "classification") if k in plain), None)
    if not found:
        raise ValueError(f"Unsupported problem type for model selection: {task}")
    return found


def evaluate(models: dict, rows: DataFrame, task: str, legacy: bool = False) -> dict:
    """Metrics of every model on rows with features and label; a model that fails is told of and passed over."""
    results, errors = [], []
    kind = _task(task)
    for name, model in models.items():
        try:
            made = predicted(model, rows)
            if kind == "regression":
                found = regression(made).first().asDict()
                metrics = {"mae": found["mae"], "rmse": found["rmse"], "r2_score" if legacy else "r2": found["r2"]}
            else:
                metrics = (macro if legacy else classification)(made).first().asDict()
            results.append({"model_name": name, "model": model, "metrics": {k: float(v) for k, v in metrics.items()}, "status": "Completed"})
        except Exception as e:  # tolerated, as one model must not stop the others
            errors.append({"model_name": name, "error": str(e)})
    if legacy:
        results.sort(key=lambda r: -r["metrics"]["r2_score" if kind == "regression" else "f1_score"])
    status = "Failed" if not results else "Completed with errors" if errors else "Completed"
    return {"status": status, "results": results, "errors": errors}


def select_best(results: list[dict] | dict, task: str) -> dict:
    """Lowest rmse or highest f1_score; the first wins ties."""
    found = results.get("results", []) if isinstance(results, dict) else results
    failed = {"status": "Failed", "best_model_name": None, "best_model": None, "best_metrics": {}}
    if not found:
        return failed | {"selection_metric": None, "selection_reason": "No valid models were available for selection."}
    metric, sign, said = ("rmse", 1, "lowest rmse") if _task(task) == "regression" else ("f1_score", -1, "highest f1_score")
    valid = [r for r in found if metric in r.get("metrics", {})]
    if not valid:
        return failed | {"selection_metric": metric, "selection_reason": f"No results had a valid {metric} metric."}
    best = min(valid, key=lambda r: sign * float(r["metrics"][metric]))
    return {"status": "Selected", "best_model_name": best["model_name"], "best_model": best.get("model"), "best_metrics": best["metrics"], "selection_metric": metric, "selection_reason": f"Selected {best['model_name']} because it has the {said}."}


def select_best_legacy(results: list[dict], task: str) -> dict:
    """Highest r2_score or f1_score."""
    if not results:
        raise ValueError("No evaluation results were provided.")
    metric = "r2_score" if _task(task) == "regression" else "f1_score"
    best = max(results, key=lambda r: r["metrics"][metric])
    return {"best_model_name": best["model_name"], "best_model": best.get("model"), "best_metrics": best["metrics"], "selection_metric": metric}


def as_list(models: dict | list) -> list:
    """Models as (name, model) pairs."""
    return [*models.items()] if isinstance(models, dict) else list(models)


def best_of(metrics: DataFrame, task: str) -> DataFrame:
    """The selection as a query over (model_name, ordinal, metric columns) rows: the best row."""
    order = [F.asc("rmse")] if _task(task) == "regression" else [F.desc("f1_score")]
    return metrics.orderBy(*order, "ordinal").limit(1)
