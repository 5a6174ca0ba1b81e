"""Feature preparation: what goes out, what is filled, encoders, label codes, and the train/test split.

`fit` looks at the data once for each kind of question and returns a `Preparation`: plain values that JSON can hold.
Applying it is column expressions alone, the same ones in training and serving.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.clean import fill_values, filled
from tabloom.operators.profile import Profile
from tabloom.types import RID, col, columns, is_boolean, is_categorical, is_number, value, with_rid

#: Distinct values up to which a text column becomes one column for each value.
ONE_HOT = 10
MISSING = "<missing>"


@dataclass
class Preparation:
    """What training found out and serving needs."""

    target: str
    target_dtype: str
    features: list[str] = field(default_factory=list)  # of the model, in order
    raw_features: list[str] = field(default_factory=list)  # of a request
    removed: list[str] = field(default_factory=list)
    numeric_fills: dict[str, float] = field(default_factory=dict)
    text_fills: dict[str, str] = field(default_factory=dict)
    encoders: dict[str, dict] = field(default_factory=dict)  # {type, categories, features}
    classes: list[str] = field(default_factory=list)  # of an encoded target
    fallback_used: bool = False
    kinds: dict[str, str] = field(default_factory=dict)  # of raw features: number, categorical, boolean

    def to_dict(self) -> dict:
        return asdict(self)

    def report(self) -> dict:
        """The preparation as training reports show it."""
        return {
            "removed_columns": self.removed,
            "imputed_columns": {"numeric": [c for c, k in self.kinds.items() if k == "number"], "categorical": [c for c, k in self.kinds.items() if k == "categorical"]},
            "raw_feature_names": self.raw_features,
            "imputation_values": {"numeric": self.numeric_fills, "categorical": self.text_fills},
            "target_column": self.target, "target_dtype": self.target_dtype, "target_encoded": bool(self.classes), "target_classes": self.classes,
            "feature_names": self.features, "encoders": self.encoders, "fallback_used": self.fallback_used,
        }


def labelled(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' does not exist in the dataset.")
    return df.where(value(df, target).isNotNull())


def one_hot_names(name: str, categories: list[str]) -> list[str]:
    return [f"{name}_{x}" for x in categories]


def one_hot(c: Column, categories: list[str]) -> list[Column]:
    """A 0/1 column for each category; all zero for any other value."""
    return [F.coalesce((c == x).cast("double"), F.lit(0.0)) for x in categories]


def ordinal(c: Column, categories: list[str]) -> Column:
    """The place of the value among its sorted categories, -1 for any other value."""
    at = F.array_position(F.array(*(F.lit(x) for x in categories)), c) if len(categories) <= 64 else F.try_element_at(F.create_map(*(y for n, x in enumerate(categories, 1) for y in (F.lit(x), F.lit(n).cast("bigint")))), c)
    return (F.coalesce(at, F.lit(0)) - 1).cast("double")


def distinct_text(df: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values of text columns, in one job. They are the encoders' content and so have to be known here."""
    if not names:
        return {}
    cells = F.array(*(F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in names))
    found: dict[str, list[str]] = {c: [] for c in names}
    for r in df.select(F.inline(cells)).where("v is not null").distinct().collect():
        found[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in found.items()}


def fit(df: DataFrame, target: str, profile: Profile | None = None) -> Preparation:
    """Drops identifiers and constants, fills, encodes. Without any feature left, the numeric columns serve as they are."""
    rows = labelled(df, target)
    p = profile or Profile(rows)
    out = Preparation(target=target, target_dtype=p.rows_of[target]["dtype"])
    kind = p.rows_of[target]["kind"]
    if kind in ("categorical", "boolean"):
        shown = value(rows, target)
        shown = F.when(shown, "True").otherwise("False") if kind == "boolean" else shown
        out.classes = sorted(r[0] for r in rows.select(shown).distinct().collect())
    drop = [c for c in p.columns if c != target and (p.identifier(c)["is_identifier"] or p.rows_of[c]["distinct"] <= 1)]
    keep = [c for c in p.columns if c != target and c not in drop and p.rows_of[c]["kind"] in ("number", "categorical", "boolean")]
    if not keep:
        keep = [c for c in p.columns if c != target and p.rows_of[c]["kind"] in ("number", "boolean") and p.rows_of[c]["distinct"]]
        out.fallback_used = True
    out.removed = [c for c in p.columns if c != target and c not in keep]
    out.raw_features = keep
    out.kinds = {c: p.rows_of[c]["kind"] for c in keep}
    gaps = [c for c in keep if p.rows_of[c]["missing"]]
    fills = fill_values(rows, gaps) if gaps else {}
    for c in gaps:
        if out.kinds[c] == "number":
            out.numeric_fills[c] = fills[c]["fill"]
        elif out.kinds[c] == "categorical":
            out.text_fills[c] = fills[c]["fill"] if fills[c]["fill"] is not None else MISSING
    values = distinct_text(rows, [c for c in keep if out.kinds[c] == "categorical"])
    for c, found in values.items():
        if c in out.text_fills and out.text_fills[c] not in found:
            found = sorted([*found, out.text_fills[c]])
        if not found:
            out.encoders[c] = {"type": "empty", "categories": [], "features": []}
        elif len(found) <= ONE_HOT:
            out.encoders[c] = {"type": "onehot", "categories": found, "features": one_hot_names(c, found)}
        else:
            out.encoders[c] = {"type": "ordinal", "categories": found, "features": [c]}
    blocks = [x for c in keep if out.encoders.get(c, {}).get("type") == "onehot" for x in out.encoders[c]["features"]]
    out.features = [c for c in keep if out.encoders.get(c, {}).get("type") != "onehot"] + blocks
    return out


def apply(df: DataFrame, prep: Preparation, keep: list[str] = ()) -> DataFrame:
    """The features as doubles, in their order, and the columns in `keep`."""
    made: dict[str, Column] = {}
    for c in prep.raw_features:
        raw = value(df, c)
        if prep.kinds[c] == "categorical":
            raw = F.coalesce(raw.cast("string"), F.lit(prep.text_fills[c])) if c in prep.text_fills else raw.cast("string")
            e = prep.encoders[c]
            if e["type"] == "onehot":
                made |= dict(zip(e["features"], one_hot(raw, e["categories"]), strict=True))
            else:
                made[c] = ordinal(raw, e["categories"])
        else:
            number = raw.cast("double")
            made[c] = F.coalesce(number, F.lit(prep.numeric_fills[c])) if c in prep.numeric_fills else number
    return df.select(*(col(c) for c in keep), *(made[f].alias(f) for f in prep.features))


def label(df: DataFrame, prep: Preparation) -> Column:
    """The target as a number: its class code if it is encoded."""
    v = value(df, prep.target)
    if prep.classes:
        v = F.when(v, "True").otherwise("False") if is_boolean(df.schema[prep.target].dataType) else v
        return ordinal(v, prep.classes)
    return v.cast("double")


def training_frame(df: DataFrame, prep: Preparation) -> DataFrame:
    """_rid, features and _label of all rows with a target."""
    rows = with_rid(labelled(df, prep.target)).withColumn("_label", label(df, prep))
    return apply(rows, prep, [RID, "_label"])


def stratifies(df: DataFrame, target: str, task: str | None = None) -> bool:
    """Whether a split keeps the classes' shares: for a classification, or, without a task, for text and few distinct values."""
    if task is not None:
        return "class" in task.lower()
    kind = df.schema[target].dataType
    if is_categorical(kind) or is_boolean(kind):
        return True
    r = df.agg(F.count_distinct(col(target)).alias("d"), F.count("*").alias("n")).first()
    return is_number(kind) and 0 < r["d"] <= max(2, min(20, int(r["n"] * 0.05)))


def quotas(counts: DataFrame, wanted: int, key: str) -> DataFrame:
    """(key, n, quota): `wanted` rows shared out by largest remainders; ties go to the smaller key."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    share = F.col("n") * wanted / total
    out = counts.withColumn("whole", F.floor(share).cast("bigint")).withColumn("rest", share - F.floor(share))
    left = wanted - F.sum("whole").over(Window.partitionBy(F.lit(1)))
    more = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), key)) <= left
    return out.withColumn("quota", F.col("whole") + more.cast("bigint")).select(key, "n", "quota")


def split(df: DataFrame, stratify: str | None = None, test_size: float = 0.2, seed: int = 42, buckets: int = 256) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint, ceil(test_size * n) rows in test, the same for a seed; by class if stratified.

    The rows of a class are ordered by a hash of row number and seed. The hash's first bits are buckets, counted first,
    so only rows of the one bucket that holds the quota's end are ranked: no class is sorted as a whole.
    """
    rows = with_rid(df)
    n = rows.count()
    wanted = math.ceil(test_size * n)
    key = F.coalesce(col(stratify).cast("string"), F.lit("")) if stratify else F.lit("")
    rows = rows.withColumn("_k", key).withColumn("_h", F.xxhash64(F.col(RID), F.lit(seed))).withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 32), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("_k", "_b").agg(F.count("*").alias("n"))
    classes = counts.groupBy("_k").agg(F.sum("n").alias("n"))
    if stratify:
        r = classes.agg(F.min("n").alias("least"), F.count("*").alias("many")).first()
        if n and (r["least"] < 2 or wanted < r["many"] or n - wanted < r["many"]):
            return split(df, None, test_size, seed, buckets)
    share = quotas(classes, wanted, "_k").select("_k", "quota")
    up = Window.partitionBy("_k").orderBy("_b")
    edges = counts.withColumn("before", F.sum("n").over(up) - F.col("n")).join(share, "_k").select("_k", "_b", (F.col("quota") - F.col("before")).alias("_left"), F.col("n").alias("_n"))
    marked = rows.join(F.broadcast(edges) if stratify is None else edges, ["_k", "_b"])  # without classes: a row for each bucket
    whole = (F.col("_left") >= F.col("_n")) | (F.col("_left") <= 0)
    inside = F.row_number().over(Window.partitionBy("_k", "_b").orderBy("_h", RID))
    own = [RID, *columns(df)] if RID in df.columns else columns(df)
    ranked = marked.where(~whole).withColumn("_test", inside <= F.col("_left"))
    both = marked.where(whole).withColumn("_test", F.col("_left") > 0).unionByName(ranked)
    return tuple(both.where(F.col("_test") == t).select(*(col(c) for c in own)) for t in (False, True))


def first_seen_codes(df: DataFrame, name: str, made: str) -> tuple[DataFrame, DataFrame]:
    """(df with codes by first appearance, the code table); nulls are '<missing>', values beyond the table are null."""
    rows = with_rid(df).withColumn("_v", F.coalesce(col(name).cast("string"), F.lit(MISSING)))
    seen = rows.groupBy("_v").agg(F.min(RID).alias("first"))
    codes = seen.withColumn(made, F.row_number().over(Window.orderBy("first")).cast("bigint") - 1).select("_v", made)
    return rows.join(codes, "_v", "left").drop("_v"), codes


def first_seen_one_hot(df: DataFrame, name: str) -> DataFrame:
    """A whole-number 0/1 column for each value, in order of first appearance."""
    rows = with_rid(df).withColumn("_v", F.coalesce(col(name).cast("string"), F.lit(MISSING)))
    order = [r["_v"] for r in rows.groupBy("_v").agg(F.min(RID).alias("first")).orderBy("first").collect()]
    return rows.select(*(col(c) for c in df.columns if c != name), *((F.col("_v") == x).cast("bigint").alias(f"{name}_{x}") for x in order))


def fill_all(df: DataFrame) -> DataFrame:
    """Means and modes in place of missing values, '<missing>' for text without any value."""
    found = fill_values(df)
    fills = {c: x["fill"] if x["fill"] is not None else MISSING for c, x in found.items() if x["missing"] and x["kind"] in ("number", "categorical") and (x["fill"] is not None or x["kind"] == "categorical")}
    return filled(df, fills)
