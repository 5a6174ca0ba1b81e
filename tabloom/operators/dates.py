"""Date columns: finding them in text, converting, taking apart, and days between two of them.

One format is taken for a column: the first of a ladder that reads the first value that reads at all. Month-first ladders come
first, day-first ones second.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.clean import done, skipped
from tabloom.types import RID, col, columns, is_categorical, is_datetime, with_rid

#: Values that detection looks at, and the share that must read as dates.
LOOKED_AT, SHARE = 100, 0.8
#: (pattern that a value must match, Spark format), in order.
_ISO = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}$", "yyyy-M-d[' ']['T']H:mm"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d[' ']['T']H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}\.\d{1,9}$", "yyyy-M-d[' ']['T']H:mm:ss[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
]
_WORDS = [
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", "MMM d[,] yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2},? \d{4}$", "MMMM d[,] yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^\d{4}$", "yyyy"),
]
_MONTH = [(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy")]
_DAY = [(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy")]
#: A ladder falls through to the other order where the first value allows only that, as 13/8/2016.
LADDERS = {"default": [*_ISO, *_MONTH, *_DAY, *_WORDS], "dayfirst": [*_ISO, *_DAY, *_MONTH, *_WORDS]}


def read(c: Column, pattern: str, fmt: str) -> Column:
    """The timestamp of a value in the format, else null."""
    trimmed = F.trim(c)
    return F.when(trimmed.rlike(pattern), F.try_to_timestamp(trimmed, F.lit(fmt)).cast("timestamp_ntz"))


def _formats(df: DataFrame, names: list[str]) -> dict[str, dict[str, tuple]]:
    """By column and ladder: (step, share of the first values that it reads), for the step that reads first.

    One small job for each column of text: the first values in row order, each tried with every step.
    """
    steps = list(dict.fromkeys(x for ladder in LADDERS.values() for x in ladder))
    out: dict[str, dict[str, tuple]] = {}
    rows = with_rid(df)
    for name in names:
        first = rows.where(col(name).isNotNull()).select(RID, col(name).alias("v")).orderBy(RID).limit(LOOKED_AT)
        r = first.agg(F.count("*").alias("n"), *(F.count(read(F.col("v"), *s)).alias(f"k{i}") for i, s in enumerate(steps)), *(F.min(F.when(read(F.col("v"), *s).isNotNull(), F.col(RID))).alias(f"f{i}") for i, s in enumerate(steps))).first()
        out[name] = {}
        for ladder, own in LADDERS.items():
            reads = [steps.index(s) for s in own if r[f"f{steps.index(s)}"] is not None]
            if reads:
                k = min(reads, key=lambda k: r[f"f{k}"])  # of equals, the first in the ladder
                out[name][ladder] = (steps[k], r[f"k{k}"] / r["n"])
    return out


def _found(df: DataFrame) -> dict[str, dict[str, tuple]]:
    text = _formats(df, [c for c in columns(df) if is_categorical(df.schema[c].dataType)])
    return {c: text.get(c, {}) for c in columns(df) if is_datetime(df.schema[c].dataType) or max([s for _, s in text.get(c, {}).values()], default=0) >= SHARE}


def date_columns(df: DataFrame) -> list[str]:
    """Columns of dates, and of text of which most of the first values read as dates."""
    return [*_found(df)]


def _parsed(df: DataFrame, name: str, formats: dict[str, tuple], order: str = "default") -> Column:
    if is_datetime(df.schema[name].dataType):
        return col(name).cast("timestamp_ntz") if df.schema[name].dataType.typeName() == "date" else col(name)
    step = formats.get(order) or next(iter(formats.values()))
    return read(col(name), *step[0])


def convert_dates(df: DataFrame) -> tuple[DataFrame, dict]:
    """Date columns as timestamps, the month first where both orders read; what does not read becomes null."""
    found = _found(df)
    if not found:
        return df, skipped("No date columns found.")
    out = df.withColumns({c: _parsed(df, c, f) for c, f in found.items()})
    r = out.agg(*(F.count("*").alias("n") if k < 0 else F.count(col(c)).alias(f"n{k}") for k, c in enumerate(["", *found], -1))).first()
    missing = {c: r["n"] - r[f"n{k}"] for k, c in enumerate(found)}
    failed = [c for c in found if r["n"] and missing[c] == r["n"]]
    details = {"date_columns_detected": [*found], "date_columns_converted": [c for c in found if c not in failed], "date_columns_nat_count": sum(missing.values())}
    if failed:
        out = df.withColumns({c: _parsed(df, c, f) for c, f in found.items() if c not in failed})
        details |= {"date_columns_failed": [{"column": c, "reason": "no value reads as a date"} for c in failed], "date_columns_failed_count": len(failed)}
    return out, {"status": "Completed", "details": details}


def base_name(name: str) -> str:
    """The column's name without the word date."""
    return re.sub(r"\bdate\b", "", name, flags=re.IGNORECASE).strip() or name


def date_parts(df: DataFrame, names: list[str], formats: dict[str, dict[str, tuple]] | None = None) -> DataFrame:
    """Year, Month, Day and Weekday (Monday 0) of each date column, behind the other columns."""
    made = {}
    for c in names:
        at, base = _parsed(df, c, (formats or {}).get(c, {})), base_name(c)
        made |= {f"{base} Year": F.year(at), f"{base} Month": F.month(at), f"{base} Day": F.dayofmonth(at), f"{base} Weekday": F.weekday(at)}
    return df.withColumns(made)


def extract_date_parts(df: DataFrame) -> tuple[DataFrame, dict]:
    found = _found(df)
    if not found:
        return df, skipped("No datetime columns found.")
    made = [f"{base_name(c)} {part}" for c in found for part in ("Year", "Month", "Day", "Weekday")]
    return date_parts(df, [*found], found), done(datetime_columns=[*found], generated_columns=made, generated_column_count=len(made))


def whole_days(start: Column, end: Column) -> Column:
    """Days from start to end, rounded down (also below zero)."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000)).cast("bigint")


def delivery_time(df: DataFrame, start: str = "Order Date", end: str = "Ship Date", made: str = "Delivery Time (Days)") -> tuple[DataFrame, dict]:
    """Days between two date columns; text is read with the day first."""
    found = _found(df.select(*(col(c) for c in (start, end)), *([RID] if RID in df.columns else []))) if {start, end} <= set(df.columns) else {}
    if not {start, end} <= found.keys():
        return df, skipped(f"{start} and {end} must both be present and datetime columns.")
    out = df.withColumn(made, whole_days(_parsed(df, start, found[start], "dayfirst"), _parsed(df, end, found[end], "dayfirst")))
    negative = out.agg(F.count_if(col(made) < 0).alias("n")).first()["n"]
    return out, done(order_column=start, ship_column=end, generated_column=made, negative_delivery_days=negative)


def generated(report: dict) -> list[str]:
    """Names of the columns that the two steps have made."""
    parts = report.get("date_features", {}).get("details", {}).get("generated_columns", [])
    made = report.get("delivery_time", {}).get("details", {}).get("generated_column")
    return [*parts, *([made] if made else [])]
