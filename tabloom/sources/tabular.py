"""Tabular files: CSV, Excel workbooks, Parquet.

CSV columns are read as text, the usual tokens for missing values become nulls, and each column gets the narrowest
type that all its values read as, so a number column with an NA stays a number column.
"""

from __future__ import annotations

import codecs
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.types import col, with_rid

# CSV tokens that mean missing.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
INTEGER, NUMBER = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"
EXTENSIONS = (".csv", ".xlsx")


def is_utf8(path: str, step: int = 1 << 20) -> bool:
    """Whether a local file's bytes are UTF-8; read in steps. Files that only Spark reads count as UTF-8."""
    if not os.path.exists(path):
        return True
    decoder = codecs.getincrementaldecoder("utf-8")()
    with open(path, "rb") as f:
        try:
            while data := f.read(step):
                decoder.decode(data)
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            return False
    return True


def typed(df: DataFrame) -> DataFrame:
    """Text columns with missing tokens as nulls and the narrowest of bigint, double, boolean and string. One job."""
    text = df.select(*(F.when(~col(c).isin(NULL_TOKENS), col(c)).alias(c) for c in df.columns))
    tests = {"integer": INTEGER, "number": NUMBER, "boolean": "^(True|False|TRUE|FALSE|true|false)$"}
    aggs = [F.count_if(col(c).rlike(p)).alias(f"{k}{n}") for n, c in enumerate(df.columns) for k, p in tests.items()]
    r = text.agg(F.count("*").alias("rows"), *(F.count(col(c)).alias(f"n{n}") for n, c in enumerate(df.columns)), *aggs).first()
    out = []
    for n, c in enumerate(df.columns):
        full = r[f"n{n}"]
        if full == 0 or r[f"number{n}"] == full and (r[f"integer{n}"] < full or full < r["rows"]):
            out.append(F.trim(col(c)).try_cast("double").alias(c))
        elif r[f"integer{n}"] == full:
            out.append(F.trim(col(c)).try_cast("bigint").alias(c))
        elif r[f"boolean{n}"] == full and full == r["rows"]:
            out.append(col(c).try_cast("boolean").alias(c))
        else:
            out.append(col(c))
    return text.select(*out)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    encoding = "UTF-8" if is_utf8(path) else "ISO-8859-1"
    where = f"file://{os.path.abspath(path)}" if os.path.exists(path) else path
    raw = spark.read.csv(where, header=True, inferSchema=False, multiLine=True, escape='"', encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return typed(raw)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook."""
    from tabloom.sources.xlsx import WorkbookSource

    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(os.path.abspath(path) if os.path.exists(path) else path)


def load(spark: SparkSession, path: str, rid: bool = False) -> DataFrame:
    """A table by its file's extension. rid: with a row number in file order."""
    kind = Path(path).suffix.lower()
    readers = {".csv": read_csv, ".xlsx": read_xlsx, ".parquet": lambda s, p: s.read.parquet(p)}
    if kind not in readers:
        raise ValueError("Unsupported file format.")
    df = readers[kind](spark, path)
    return with_rid(df) if rid else df


def safe_path(folder: str | Path, name: str) -> Path:
    """The file `name` of a folder; names that lead out of it are refused."""
    plain = str(name).strip()
    if not plain or plain in (".", "..") or "/" in plain or "\\" in plain or "\x00" in plain:
        raise ValueError("Invalid filename.")
    root = Path(folder).resolve()
    path = (root / plain).resolve()
    if not path.is_relative_to(root):
        raise ValueError("Invalid filename.")
    return path


def allowed(name: str) -> bool:
    return Path(name).suffix.lower() in EXTENSIONS
