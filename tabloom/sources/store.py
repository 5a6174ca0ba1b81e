"""Model packages: an MLlib model and a JSON file beside it, written last as the mark of a whole package."""

from __future__ import annotations

import datetime
import json
import math
import re
import secrets
from pathlib import Path
from typing import Any

SAFE_ID = re.compile(r"^[A-Za-z0-9_]+$")
DEFAULT = Path("storage") / "models"


def new_id() -> str:
    now = datetime.datetime.now(datetime.UTC)
    return f"automl_{now:%Y%m%d_%H%M%S}_{secrets.token_hex(3)}"


def json_safe(x: Any) -> Any:
    """x of plain values: rows and containers opened, numbers native, anything else as text."""
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if hasattr(x, "asDict"):
        return json_safe(x.asDict(True))
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [json_safe(v) for v in x]
    if hasattr(x, "tolist"):
        return json_safe(x.tolist())
    return str(x)


def save(model, prep, problem_type: str, name: str, metric: str, metrics: dict, folder: str | Path | None = None, feature_names: list[str] | None = None) -> dict:
    """Writes a package; returns what it says of itself, without the model."""
    root = Path(folder or DEFAULT).resolve()
    root.mkdir(parents=True, exist_ok=True)
    model_id = new_id()
    path = root / model_id
    kind = f"{type(model).__module__}.{type(model).__name__}"
    model.write().save(f"file://{path}/model")
    made = {
        "model_id": model_id, "model_class": kind, "preparation": prep.to_dict(), "feature_names": feature_names or prep.features, "target_column": prep.target, "problem_type": problem_type,
        "model_name": name, "selection_metric": metric, "metrics": json_safe(metrics), "created_at": f"{datetime.datetime.now(datetime.UTC):%Y-%m-%dT%H:%M:%S}Z",
    }
    (path / "package.json.part").write_text(json.dumps(made, ensure_ascii=False))
    (path / "package.json.part").rename(path / "package.json")
    shown = {k: v for k, v in made.items() if k not in ("preparation", "model_class", "feature_names")}
    return shown | {"model_path": model_id, "feature_count": len(made["feature_names"])}


def load(model_id: str, folder: str | Path | None = None) -> dict:
    """The package of an id, with the model under "model"."""
    import importlib

    from tabloom.operators.prepare import Preparation

    plain = str(model_id or "").strip()
    if not plain:
        raise ValueError("no model id given")
    if not SAFE_ID.match(plain):
        raise ValueError("unsafe model id")
    root = Path(folder or DEFAULT).resolve()
    path = (root / plain).resolve()
    if not path.is_relative_to(root):
        raise ValueError("unsafe model id")
    if not (path / "package.json").exists():
        raise FileNotFoundError(f"Model package '{plain}' does not exist")
    made = json.loads((path / "package.json").read_text())
    if not isinstance(made, dict):
        raise ValueError("not a model package")
    module, _, name = made["model_class"].rpartition(".")
    if not module.startswith("pyspark.ml."):
        raise ValueError("not a model package")
    model = getattr(importlib.import_module(module), name).load(f"file://{path}/model")
    return made | {"model": model, "preparation": Preparation(**made["preparation"])}


def save_legacy(model, stem: str, folder: str | Path | None = None) -> str:
    """Writes a bare model by name, over one that is there."""
    path = Path(folder or DEFAULT).resolve() / Path(stem).stem
    model.write().overwrite().save(f"file://{path}")
    return str(path)
