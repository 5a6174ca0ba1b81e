"""Cleaning: duplicate rows, missing-value markers, imputation. Each step is a lazy frame and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.profile import duplicate_rows
from tabloom.types import RID, col, columns, is_categorical, is_number, kind_of, value, with_rid

#: Text that means missing, trimmed and in lower case; and the list that reports name.
MARKERS = ["", "na", "n/a", "null", "none", "unknown", "?"]
MARKERS_REPORTED = ["", " ", "?", "NA", "N/A", "na", "null", "unknown"]


def done(**details) -> dict:
    return {"status": "Completed", "details": details}


def skipped(reason: str) -> dict:
    return {"status": "Skipped", "reason": reason}


def distinct_rows(df: DataFrame, keep_first: bool = False) -> DataFrame:
    """One of each group of equal rows. keep_first keeps that of the lowest row number, else Spark may take any."""
    own = columns(df)
    if not keep_first:
        return df.dropDuplicates(own)
    rows = with_rid(df)
    plain = [F.to_json(F.struct(col(c).alias("v"))) if kind_of(df.schema[c].dataType) == "other" else value(df, c) for c in own]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*plain).orderBy(RID))).where("_n = 1").drop("_n")


def remove_duplicates(df: DataFrame, keep_first: bool = False) -> tuple[DataFrame, dict]:
    r = duplicate_rows(df).first()
    report = done(rows_before=r["rows"], rows_after=r["distinct_rows"], duplicates_removed=r["duplicate_rows"])
    return distinct_rows(df, keep_first), report


def is_marker(c: Column) -> Column:
    """Trimmed of all white space, not only of spaces, and in any case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")).isin(MARKERS)


def without_markers(df: DataFrame) -> DataFrame:
    """Text columns with markers as nulls; types stay as they are."""
    return df.withColumns({c: F.when(~is_marker(col(c)), col(c)) for c in columns(df) if is_categorical(df.schema[c].dataType)})


def marker_count(df: DataFrame) -> Column:
    """An aggregate: the values that without_markers makes null."""
    text = [c for c in columns(df) if is_categorical(df.schema[c].dataType)]
    return sum((F.coalesce(F.sum(is_marker(col(c)).cast("bigint")), F.lit(0)) for c in text), F.lit(0).cast("bigint"))


def normalize_markers(df: DataFrame) -> tuple[DataFrame, dict]:
    n = df.agg(marker_count(df).alias("n")).first()["n"]
    return without_markers(df), done(values_normalized=n, markers_used=MARKERS_REPORTED)


def fill_values(df: DataFrame, only: list[str] | None = None) -> dict[str, dict]:
    """By column: its kind, missing and rows, and the fill (mean of numbers, most frequent text with ties to the smallest). One job."""
    own = [c for c in columns(df) if only is None or c in only]
    aggs = [F.count("*").alias("rows")]
    for k, c in enumerate(own):
        t = df.schema[c].dataType
        aggs.append(F.count(value(df, c)).alias(f"n{k}"))
        if is_number(t):
            aggs.append(F.avg(value(df, c).cast("double")).alias(f"f{k}"))
    r = df.agg(*aggs).first()
    out = {c: {"kind": kind_of(df.schema[c].dataType), "rows": r["rows"], "missing": r["rows"] - r[f"n{k}"], "fill": r.asDict().get(f"f{k}")} for k, c in enumerate(own)}
    text = [c for c in own if out[c]["kind"] == "categorical" and 0 < out[c]["missing"] < out[c]["rows"]]
    if text:  # most frequent values from counts, so the state of no task grows with the distinct values
        cells = F.array(*(F.struct(F.lit(c).alias("c"), col(c).alias("v")) for c in text))
        counts = df.select(F.inline(cells)).where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
        for x in counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias("v")).collect():
            out[x["c"]]["fill"] = x["v"]
    return out


def filled(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """df with the fills in place of missing values. A filled whole number becomes a double, as its mean is one."""
    return df.withColumns({c: F.coalesce(value(df, c).cast("double") if isinstance(v, float) else col(c), F.lit(v)) for c, v in fills.items() if v is not None})


def handle_missing(df: DataFrame) -> tuple[DataFrame, dict]:
    """Means for numbers, modes for text; dates, booleans and columns without any value stay."""
    found = fill_values(df)
    fills = {c: x["fill"] for c, x in found.items() if x["missing"] and x["fill"] is not None}
    before = sum(x["missing"] for x in found.values())
    after = sum(x["missing"] for c, x in found.items() if c not in fills)
    nan = {c: value(df, c) for c, x in found.items() if x["missing"] and c not in fills and x["kind"] == "number"}
    return filled(df.withColumns(nan), fills), done(missing_before=before, missing_after=after, missing_values_filled=before - after)
