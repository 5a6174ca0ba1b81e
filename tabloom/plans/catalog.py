"""Queries over the test tables for the operators of this package, and the SQL that says the same.

The tables have no gaps or markers, so queries on cleaning put them in by rule, in both languages alike.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import names
from tabloom.operators import clean, dates, detect, metrics, models, prepare, profile
from tabloom.plans import automl, service
from tabloom.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _cells(columns: dict[str, str], source: str) -> str:
    """SQL for (ordinal, col, kind, value) rows of a table's columns."""
    return "\n    UNION ALL ".join(f"SELECT {n} AS ordinal, '{c}' AS col, '{k}' AS kind, CAST({c} AS VARCHAR) AS v FROM {source}" for n, (c, k) in enumerate(columns.items()))


def _profile_sql(columns: dict[str, str], source: str) -> str:
    return f"""cells AS ({_cells(columns, source)}),
prof AS (SELECT ordinal, col, kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(v) AS BIGINT) AS missing, CAST(count(DISTINCT v) AS BIGINT) AS d FROM cells GROUP BY ordinal, col, kind)"""


ORDERS = {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "categorical", "o_totalprice": "number", "o_orderdate": "datetime", "o_orderpriority": "categorical"}
CUSTOMER = {"c_custkey": "number", "c_name": "categorical", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "categorical"}
PART = {"p_partkey": "number", "p_name": "categorical", "p_brand": "categorical", "p_type": "categorical", "p_size": "number", "p_retailprice": "number"}
EVENTS = {"event_id": "number", "ts": "datetime", "user_id": "number", "event_type": "categorical", "value": "number", "props": "categorical"}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORDS = "trim(regexp_replace(lower(col), '[^a-z0-9]+', ' ', 'g'))"
_ESCAPES = f"regexp_matches({_WORDS}, {_q(names._any(names.MEASUREMENT + names.EXEMPT))})"
_NAMED = f"(NOT {_ESCAPES} AND regexp_matches({_WORDS}, {_q(names.IDENTIFIER_NAME)}))"
_NEAR = f"(NOT {_ESCAPES} AND d >= 10 AND d >= 0.8 * n)"
_IDENTIFIER = f"(kind <> 'datetime' AND d > 0 AND ({_NAMED} OR {_NEAR}) AND (d >= 0.8 * n OR d >= 10))"
_TARGET = f"regexp_matches(replace(lower(col), ' ', '_'), {_q(names.TARGET_NAME)})"
_KEY = f"regexp_matches(lower(col), {_q(names._any(names.IDENTIFIER_LIKE))})"
_STRENGTH = "CASE " + " ".join(f"WHEN regexp_matches(replace(lower(col), ' ', '_'), {_q(names._between(w))}) THEN {n}" for n, w in names.STRENGTHS) + " ELSE 0 END"


@query(f"""WITH {_profile_sql(ORDERS, 'orders')}
SELECT CAST(ordinal AS INTEGER) AS ordinal, col AS "column", kind, n AS rows, missing, d AS "distinct", round(d / n, 4) AS distinct_ratio, d <= 1 AS is_constant, kind <> 'datetime' AND d > 0 AND {_NEAR} AS near_unique,
    {_IDENTIFIER} AS is_identifier, CAST(greatest(20, ceil(n * 0.5)) AS BIGINT) AS threshold_count, kind = 'categorical' AND d > 0 AND (d >= greatest(20, ceil(n * 0.5)) OR d >= 0.5 * n) AS high_cardinality FROM prof""")
def column_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.flagged(profile.profile(table(spark, sf_dir, "orders")))
    return out.select("ordinal", "column", "kind", "rows", "missing", "distinct", F.round("distinct_ratio", 4).alias("distinct_ratio"), "is_constant", "near_unique", "is_identifier", "threshold_count", "high_cardinality")


@query("""SELECT 'nation' AS name, count(*) = 0 AS is_empty, FALSE AS too_few_columns, count(*) < 50 AS few_rows, CAST(0 AS BIGINT) AS empty_columns FROM nation
UNION ALL SELECT 'region', count(*) = 0, FALSE, count(*) < 50, CAST(1 AS BIGINT) FROM region""")
def validation_rules_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rules(name: str, df: DataFrame) -> DataFrame:
        p = profile.profile(df)
        return p.agg(F.max("rows").alias("n"), F.count_if(F.col("distinct") == 0).alias("empty_columns"), F.count("*").alias("k")).select(F.lit(name).alias("name"), (F.col("n") == 0).alias("is_empty"), (F.col("k") < 2).alias("too_few_columns"), (F.col("n") < 50).alias("few_rows"), "empty_columns")

    # region gets a column without any value
    return rules("nation", table(spark, sf_dir, "nation")).unionByName(rules("region", table(spark, sf_dir, "region").withColumn("blank", F.lit(None).cast("string"))))


_GAPS = "(SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity, l_discount, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus FROM lineitem)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), "l_discount", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus")


@query(f"""SELECT CAST(count(*) - count(l_quantity) AS BIGINT) AS l_quantity, CAST(0 AS BIGINT) AS l_discount, CAST(count(*) - count(l_returnflag) AS BIGINT) AS l_returnflag, CAST(0 AS BIGINT) AS l_linestatus FROM {_GAPS}""")
def missing_cells_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_cells(_gaps(spark, sf_dir))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST((SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS BIGINT) AS distinct_rows, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS BIGINT) AS duplicate_rows FROM documents")
def duplicate_rows_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_rows(table(spark, sf_dir, "documents").select("text", "lang"))


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def deduplicated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.distinct_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"))


@query("""WITH m AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN ' N/A ' WHEN 1 THEN '' WHEN 2 THEN chr(9) || 'Unknown' WHEN 3 THEN 'nan' ELSE o_orderpriority END AS v FROM orders)
SELECT o_orderkey, CASE WHEN lower(regexp_replace(v, '^\\s+|\\s+$', '', 'g')) IN ('', 'na', 'n/a', 'null', 'none', 'unknown', '?') THEN NULL ELSE v END AS v FROM m""")
def marker_normalize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    return clean.without_markers(table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, " N/A ").when(k == 1, "").when(k == 2, "\tUnknown").when(k == 3, "nan").otherwise(F.col("o_orderpriority")).alias("v")))


@query(f"SELECT round(avg(l_quantity), 6) AS fill, CAST(count(*) AS BIGINT) AS rows, round(sum(coalesce(l_quantity, (SELECT avg(l_quantity) FROM {_GAPS}))), 2) AS total FROM {_GAPS}")
def mean_impute_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _gaps(spark, sf_dir).select("l_quantity")
    fill = clean.fill_values(df)["l_quantity"]["fill"]
    return clean.filled(df, {"l_quantity": fill}).agg(F.round(F.lit(fill), 6).alias("fill"), F.count("*").alias("rows"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("""WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer),
m AS (SELECT s FROM g WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
SELECT c_custkey, coalesce(s, (SELECT s FROM m)) AS s FROM g""")
def mode_impute_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("s"))
    return clean.filled(df, {"s": clean.fill_values(df, ["s"])["s"]["fill"]})


_DATED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS d FROM orders)"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("d"))


@query(f"WITH f AS (SELECT * FROM {_DATED} ORDER BY o_orderkey LIMIT 100) SELECT CAST(count(*) AS BIGINT) AS looked_at, round(avg(CASE WHEN try_strptime(d, '%m/%d/%Y') IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS share FROM f")
def date_detect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _dated(spark, sf_dir).orderBy("o_orderkey").limit(dates.LOOKED_AT)
    step = next(x for x in dates.LADDERS["default"] if x[1] == "M/d/yyyy")
    return first.agg(F.count("*").alias("looked_at"), F.round(F.avg(dates.read(F.col("d"), *step).isNotNull().cast("double")), 4).alias("share"))


@query(f"SELECT o_orderkey, CAST(try_strptime(d, '%m/%d/%Y') AS TIMESTAMP) AS d FROM {_DATED}")
def date_convert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.convert_dates(_dated(spark, sf_dir))[0]


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS "o_orderdate Year", CAST(month(o_orderdate) AS INTEGER) AS "o_orderdate Month", CAST(day(o_orderdate) AS INTEGER) AS "o_orderdate Day", CAST(isodow(o_orderdate) - 1 AS INTEGER) AS "o_orderdate Weekday" FROM orders""")
def date_parts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.date_parts(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"]).drop("o_orderdate")


@query("""SELECT l_orderkey, l_linenumber, CAST(floor(date_diff('microsecond', o_orderdate, l_shipdate - INTERVAL 1 HOUR) / 86400000000) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def delivery_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = dates.delivery_time(joined.select("l_orderkey", "l_linenumber", F.col("o_orderdate").alias("Order Date"), (F.col("l_shipdate") - F.expr("INTERVAL 1 HOUR")).alias("Ship Date")))[0]
    return out.select("l_orderkey", "l_linenumber", F.col("Delivery Time (Days)").alias("days"))


@query(f"""WITH {_profile_sql(CUSTOMER, 'customer')}
SELECT col AS "column", d AS unique_count, round(d / n, 4) AS unique_ratio, {_NAMED} AS name_pattern, {_NEAR} AS near_unique FROM prof WHERE {_IDENTIFIER}""")
def identifier_columns_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.flagged(profile.profile(table(spark, sf_dir, "customer"))).where("is_identifier")
    return out.select("column", F.col("distinct").alias("unique_count"), F.round("distinct_ratio", 4).alias("unique_ratio"), "name_pattern", "near_unique")


_LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate fixed".split()


@query("WITH t AS (SELECT *, 'x' AS fixed FROM lineitem) SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct" FROM t""" for c in _LINEITEM) + """) WHERE "distinct" <= 1""")
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("fixed", F.lit("x"))
    return profile.flagged(profile.profile(df)).where("is_constant").select("column", "distinct")


@query(f"""WITH {_profile_sql(PART, 'part')}
SELECT col AS "column", d AS unique_count, CAST(greatest(20, ceil(n * 0.5)) AS BIGINT) AS threshold_count FROM prof WHERE kind = 'categorical' AND (d >= greatest(20, ceil(n * 0.5)) OR d >= 0.5 * n)
UNION ALL SELECT 'text', CAST(count(DISTINCT text) AS BIGINT), CAST(greatest(20, ceil(count(*) * 0.5)) AS BIGINT) FROM documents HAVING count(DISTINCT text) >= greatest(20, ceil(count(*) * 0.5)) OR count(DISTINCT text) >= 0.5 * count(*)""")
def high_cardinality_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.flagged(profile.profile(table(spark, sf_dir, "part"))).unionByName(profile.flagged(profile.profile(table(spark, sf_dir, "documents").select("text", "lang")))).where("high_cardinality").select("column", F.col("distinct").alias("unique_count"), "threshold_count")


@query("SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority")
def target_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""SELECT 'labels.quality' AS target, CASE WHEN count(DISTINCT quality) = 2 THEN 'Binary Classification' ELSE 'Regression' END AS problem_type FROM labels
UNION ALL SELECT 'orders.o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) <= 2 THEN 'Binary Classification' ELSE 'Multi-class Classification' END FROM orders
UNION ALL SELECT 'orders.o_totalprice', CASE WHEN count(DISTINCT o_totalprice) = 2 THEN 'Binary Classification' ELSE 'Regression' END FROM orders""")
def problem_type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [("labels", "quality"), ("orders", "o_orderstatus"), ("orders", "o_totalprice")]
    return spark.createDataFrame([(f"{t}.{c}", detect.problem_type(table(spark, sf_dir, t), c)["problem_type"]) for t, c in asked], "target string, problem_type string")


@query(f"""WITH {_profile_sql(EVENTS, 'events')},
s AS (SELECT ordinal, col, kind, n, d, CAST(d AS DOUBLE) / n AS r, CAST(missing AS DOUBLE) / n AS m, {_STRENGTH} AS s, {_TARGET} AS t, {_KEY} AS k FROM prof WHERE kind <> 'datetime' AND d > 1 AND NOT {_IDENTIFIER}),
p AS (SELECT *, CASE WHEN k THEN -6.0 ELSE 0 END + CASE WHEN s > 0 THEN 0.75 + least(s, 2) * 0.75 ELSE 0 END
    + CASE WHEN kind = 'number' THEN 1.5 + CASE WHEN d = 2 THEN 6.0 WHEN d <= 10 THEN 2.0 ELSE 0 END + CASE WHEN d > 10 THEN 1.5 + r * 1.5 ELSE 0 END + CASE WHEN d > 20 AND NOT t THEN -2.5 ELSE 0 END + r * 2.0 + CASE WHEN d > 10 AND NOT t THEN -2.0 ELSE 0 END
      ELSE 1.0 + CASE WHEN d <= 2 THEN 3.5 WHEN d <= 20 THEN 2.5 ELSE 0 END + CASE WHEN d > 2 AND s <= 1 THEN -2.5 ELSE 0 END + CASE WHEN NOT t THEN -2.5 ELSE 0 END + CASE WHEN d > 10 THEN -1.5 ELSE 0 END + r * 1.5 + CASE WHEN d <= 20 AND NOT k THEN 0.75 ELSE 0 END END
    + CASE WHEN m < 0.1 THEN 1.0 ELSE -2.0 * m END + CASE WHEN kind = 'number' AND d > 20 AND d < 0.9 * n AND NOT t THEN -1.0 ELSE 0 END AS raw FROM s)
SELECT CAST(row_number() OVER (ORDER BY round(raw, 4) DESC, ordinal) AS INTEGER) AS rank, col AS "column", CASE WHEN kind = 'number' THEN 'numeric' ELSE 'categorical' END AS datatype, round(raw, 4) AS score, round(least(greatest(0.4 + raw / 10, 0.15), 0.98), 4) AS confidence,
    CASE WHEN kind = 'number' THEN 'Regression' WHEN d <= 2 THEN 'Binary Classification' ELSE 'Multi-class Classification' END AS inferred_problem_type FROM p WHERE raw > 0""")
def target_candidates_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scored(profile.flagged(profile.profile(table(spark, sf_dir, "events")))).drop("reasons")


@query("SELECT * FROM (VALUES " + ", ".join(f"({_q(t)}, {n}, {_q(m)})" for t, key in (("Regression", "regression"), ("Binary Classification", "classification"), ("Multi-class Classification", "classification"), ("Clustering", "clustering")) for n, m in enumerate(detect.MODELS[key])) + ") AS v(task, place, model)")
def model_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, n, m) for t in ("Regression", "Binary Classification", "Multi-class Classification", "Clustering") for n, m in enumerate(detect.recommend_models(t)["recommended_models"])]
    return spark.createDataFrame(rows, "task string, place int, model string")


@query("""SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS DOUBLE) AS "l_returnflag_A", CAST(l_returnflag = 'N' AS DOUBLE) AS "l_returnflag_N", CAST(l_returnflag = 'R' AS DOUBLE) AS "l_returnflag_R" FROM lineitem""")
def onehot_returnflag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    found = prepare.distinct_text(df, ["l_returnflag"])["l_returnflag"]
    made = zip(prepare.one_hot_names("l_returnflag", found), prepare.one_hot(F.col("l_returnflag"), found), strict=True)
    return df.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in made))


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS code FROM part")
def ordinal_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", prepare.ordinal(F.col("p_brand"), prepare.distinct_text(df, ["p_brand"])["p_brand"]).alias("code"))


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS label FROM customer")
def label_encode_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    prep = prepare.Preparation(target="c_mktsegment", target_dtype="string", classes=prepare.distinct_text(df, ["c_mktsegment"])["c_mktsegment"])
    return df.select("c_custkey", prepare.label(df, prep).alias("label"))


@query("WITH f AS (SELECT o_orderstatus, min(o_orderkey) AS first FROM orders GROUP BY o_orderstatus), c AS (SELECT o_orderstatus, CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS code FROM f) SELECT o_orderkey, code FROM orders JOIN c USING (o_orderstatus)")
def first_seen_codes_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("_rid", F.col("o_orderkey"))
    return prepare.first_seen_codes(df, "o_orderstatus", "code")[0].select("o_orderkey", "code")


@query("SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def drop_null_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").drop("text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return prepare.labelled(docs.join(labels, "doc_id", "left"), "quality")


@query("""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), w AS (SELECT *, ceil(0.2 * sum(n) OVER ()) AS wanted, sum(n) OVER () AS total FROM c),
q AS (SELECT *, floor(n * wanted / total) AS whole, n * wanted / total - floor(n * wanted / total) AS rest FROM w),
r AS (SELECT *, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, quality) <= wanted - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM q)
SELECT quality, CAST(n - quota AS BIGINT) AS train, CAST(quota AS BIGINT) AS test FROM r""")
def split_sizes_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = prepare.split(table(spark, sf_dir, "labels").select("quality").withColumn("_rid", F.monotonically_increasing_id()), "quality")
    both = train.withColumn("t", F.lit(0)).unionByName(test.withColumn("t", F.lit(1)))
    return both.groupBy("quality").agg(F.count_if(F.col("t") == 0).alias("train"), F.count_if(F.col("t") == 1).alias("test"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def ols_single_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.assembled(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice")
    fit = models.suite("Regression", 1)[0][1].fit(rows.select("features", "label"))
    return spark.createDataFrame([(float(fit.coefficients[0]), float(fit.intercept))], "slope double, intercept double").select(F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("""WITH a AS (SELECT avg(l_extendedprice / l_quantity) AS unit FROM lineitem), f AS (SELECT l_extendedprice AS y, l_quantity * unit AS p FROM lineitem, a)
SELECT round(avg(abs(y - p)), 3) AS mae, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2 FROM f""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    unit = df.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    rows = df.crossJoin(F.broadcast(unit)).select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * F.col("unit")).alias("prediction"))  # one row
    return metrics.regression(rows).select(F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("r2", 4).alias("r2"))


_CLASSES = """k AS (SELECT quality AS y, toxic AS p FROM labels), c AS (SELECT y AS k FROM k UNION SELECT p FROM k),
m AS (SELECT c.k, count(*) FILTER (WHERE y = c.k AND p = c.k) AS tp, count(*) FILTER (WHERE y = c.k) AS s, count(*) FILTER (WHERE p = c.k) AS q FROM c, k GROUP BY c.k),
e AS (SELECT *, coalesce(tp / nullif(q, 0), 0) AS pr, coalesce(tp / nullif(s, 0), 0) AS re FROM m), f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM e)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")))


@query(f"WITH {_CLASSES} SELECT round(sum(tp) / sum(s), 4) AS accuracy, round(sum(pr * s) / sum(s), 4) AS precision, round(sum(re * s) / sum(s), 4) AS recall, round(sum(f1 * s) / sum(s), 4) AS f1_score FROM f")
def weighted_classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.classification(_labels(spark, sf_dir)))


@query(f"WITH {_CLASSES} SELECT round(sum(tp) / sum(s), 4) AS accuracy, round(avg(pr), 4) AS precision, round(avg(re), 4) AS recall, round(2 * avg(pr) * avg(re) / (avg(pr) + avg(re)), 4) AS f1_score FROM f")
def macro_classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.macro(_labels(spark, sf_dir)))


@query("SELECT model_name, rmse FROM (VALUES (0, 'a', 2.0), (1, 'b', 1.5), (2, 'c', 1.5)) AS v(ordinal, model_name, rmse) ORDER BY rmse, ordinal LIMIT 1".replace("2.0)", "CAST(2.0 AS DOUBLE))").replace("1.5)", "CAST(1.5 AS DOUBLE))"))
def best_model_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0, "a", 2.0), (1, "b", 1.5), (2, "c", 1.5)], "ordinal int, model_name string, rmse double")
    return metrics.best_of(rows, "Regression").select("model_name", "rmse")


#: Trees of the registered model queries: fewer and less deep than `models.Options()` has by default, on all rows.
SMALL = models.Options(trees=10, depth=6, forest_depth=5)


def _suite_rows(df: DataFrame, target: str, task: str) -> DataFrame:
    prep = prepare.fit(df, target)
    rows = models.assembled(prepare.training_frame(df, prep), prep.features).select("features", "label")
    train, test = prepare.split(rows, "label" if task != "Regression" else None, 0.2, 42)
    made = models.train(train, task, options=SMALL)
    found = metrics.evaluate(made["trained_models"], test, task)
    flat = [(r["model_name"], k, v) for r in found["results"] for k, v in r["metrics"].items()]
    return df.sparkSession.createDataFrame(flat, "model_name string, metric string, value double")


@query()
def regression_suite_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suite_rows(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("price")), "price", "Regression")


@query()
def classification_suite_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 97).alias("length_mod"))
    return _suite_rows(docs.join(table(spark, sf_dir, "labels"), "doc_id").drop("doc_id"), "quality", "Binary Classification")


@query()
def train_save_predict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains on customers, saves, loads and predicts all of them. The folder is the driver's own: MLlib models are a test's size here."""
    df = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    with tempfile.TemporaryDirectory() as folder:
        found = automl.run(df, "c_mktsegment", options=SMALL, folder=folder)
        package = store.load(found["model"]["model_id"], folder)
        # the model is in memory now
        return automl.score(df.drop("c_mktsegment"), package).select("c_nationkey", "c_acctbal", "prediction", "predicted_label")


# Reports as rows. Their SQL states the rules by itself, without this package's constants.
@query(f"""SELECT CAST(2 * count(*) - count(l_quantity) - count(l_returnflag) + count(*) AS BIGINT) AS missing_before, CAST(count(*) AS BIGINT) AS missing_after,
    CAST(2 * count(*) - count(l_quantity) - count(l_returnflag) AS BIGINT) AS missing_values_filled FROM {_GAPS}""")
def missing_report_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What imputation fills; a column without any value stays as it is."""
    d = clean.handle_missing(_gaps(spark, sf_dir).withColumn("blank", F.lit(None).cast("string")))[1]["details"]
    return spark.createDataFrame([(d["missing_before"], d["missing_after"], d["missing_values_filled"])], "missing_before long, missing_after long, missing_values_filled long")


@query(f"""WITH f AS (SELECT avg(CASE WHEN try_strptime(d, '%m/%d/%Y') IS NOT NULL THEN 1.0 ELSE 0.0 END) AS read FROM (SELECT * FROM {_DATED} ORDER BY o_orderkey LIMIT 100)),
p AS (SELECT avg(CASE WHEN try_cast(o_orderpriority AS DATE) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS read FROM orders)
SELECT 'd' AS "column" FROM f WHERE read >= 0.8 UNION ALL SELECT 'o_orderpriority' FROM p WHERE read >= 0.8
UNION ALL SELECT column_name FROM (DESCRIBE orders) WHERE column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE'""")
def date_columns_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are dates or text that reads as dates."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    found = dates.date_columns(_dated(spark, sf_dir).join(orders, "o_orderkey").orderBy("o_orderkey"))
    return spark.createDataFrame([(c,) for c in found], "column string")


@query("""SELECT 'Delivery Time (Days)' AS generated_column, CAST(count(*) FILTER (WHERE l_shipdate - INTERVAL 30 DAY < o_orderdate) AS BIGINT) AS negative_delivery_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def negative_delivery_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = dates.delivery_time(joined.select(F.col("o_orderdate").alias("Order Date"), (F.col("l_shipdate") - F.expr("INTERVAL 30 DAY")).alias("Ship Date")))[1]["details"]
    return spark.createDataFrame([(d["generated_column"], d["negative_delivery_days"])], "generated_column string, negative_delivery_days long")


@query(f"""WITH a AS (SELECT 'o_orderpriority' AS target, o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'l_returnflag', l_returnflag, count(*) FROM {_GAPS} GROUP BY l_returnflag
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY l_linestatus),
s AS (SELECT target, CAST(count(value) AS BIGINT) AS unique_values, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS missing FROM a GROUP BY target)
SELECT target, unique_values, missing, CASE WHEN missing > 0 THEN 'unknown' ELSE 'classification' END AS problem_type, value, n FROM a JOIN s USING (target)""")
def target_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of three text targets, one of them with gaps: a row for each value."""
    rows = []
    for df, c in ((table(spark, sf_dir, "orders"), "o_orderpriority"), (_gaps(spark, sf_dir), "l_returnflag"), (_gaps(spark, sf_dir), "l_linestatus")):
        r = profile.analyze_target(df, c)
        rows += [(c, r["unique_value_count"], r["missing_values"], r["problem_type"], v, n) for v, n in r["distribution"].items()]
    return spark.createDataFrame(rows, "target string, unique_values long, missing long, problem_type string, value string, n long")


_KIND_COUNTS = " UNION ALL ".join(f"""SELECT '{t}' AS "table", (SELECT CAST(count(*) AS BIGINT) FROM {t}) AS rows, CAST(count(*) AS BIGINT) AS columns, CAST(0 AS BIGINT) AS missing,
    CAST(count(*) FILTER (WHERE column_type IN ('INTEGER', 'BIGINT', 'DOUBLE', 'FLOAT')) AS BIGINT) AS numeric, CAST(count(*) FILTER (WHERE column_type = 'VARCHAR') AS BIGINT) AS categorical,
    CAST(count(*) FILTER (WHERE column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE') AS BIGINT) AS datetime FROM (DESCRIBE {t})""" for t in ("orders", "part", "customer"))


@query(_KIND_COUNTS)
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and feature analysis of three tables."""
    rows = []
    for t in ("orders", "part", "customer"):
        p = profile.Profile(table(spark, sf_dir, t))
        s, f = profile.summarize(p), profile.analyze_features(p)
        rows.append((t, s["rows"], s["columns"], s["missing_values"], f["numeric_column_count"], f["categorical_column_count"], s["datetime_column_count"]))
    return spark.createDataFrame(rows, "table string, rows long, columns long, missing long, numeric long, categorical long, datetime long")


@query("""WITH n AS (SELECT count(*) AS n FROM part), c AS (SELECT 'p_partkey' AS "column", count(DISTINCT p_partkey) AS d FROM part
    UNION ALL SELECT 'row_id', count(DISTINCT p_partkey) FROM part WHERE p_partkey % 100 <> 0)
SELECT "column", CAST(d AS BIGINT) AS unique_count, round(d / n, 4) AS unique_ratio, round((n - d) / n, 4) AS null_ratio FROM c, n WHERE d >= 10 OR d >= 0.8 * n""")
def identifier_report_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of part with a second key that has gaps."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 100 != 0, F.col("p_partkey")).alias("row_id"))
    found = profile.identifier_report(df)["details"]
    return spark.createDataFrame([(c, d["unique_count"], d["unique_ratio"], d["null_ratio"]) for c, d in found.items()], "column string, unique_count long, unique_ratio double, null_ratio double")


@query("""WITH e AS (SELECT event_type, user_id % 2 AS sample_weight, event_id % 2 AS label FROM events),
c AS (SELECT 0 AS ordinal, 'event_type' AS col, FALSE AS num, FALSE AS weight, 0 AS s, count(DISTINCT event_type) AS d, count(*) AS n FROM e
    UNION ALL SELECT 1, 'sample_weight', TRUE, TRUE, 0, count(DISTINCT sample_weight), count(*) FROM e UNION ALL SELECT 2, 'label', TRUE, FALSE, 4, count(DISTINCT label), count(*) FROM e),
p AS (SELECT *, CASE WHEN weight THEN -5.0 ELSE 0 END + CASE WHEN s > 0 THEN 0.75 + 0.75 * least(s, 2) ELSE 0 END + 1.0
    + CASE WHEN num THEN 1.5 + CASE WHEN d = 2 THEN 6.0 ELSE 2.0 END + 2.0 * d / n
      ELSE 1.0 + CASE WHEN d <= 2 THEN 3.5 WHEN d <= 20 THEN 2.5 - 2.5 ELSE -2.5 END - 2.5 + CASE WHEN d > 10 THEN -1.5 ELSE 0 END + 1.5 * d / n + CASE WHEN d <= 20 THEN 0.75 ELSE 0 END END AS raw,
    concat_ws('|', CASE WHEN weight THEN 'weight_like_metadata' END, CASE WHEN s > 0 THEN 'target_like_name' END, CASE WHEN num THEN 'numeric_dtype' END, CASE WHEN num AND d = 2 THEN 'binary_numeric_target_like' END,
      CASE WHEN num AND d <> 2 THEN 'low_cardinality_numeric' END, CASE WHEN NOT num THEN 'categorical_dtype' END, CASE WHEN NOT num AND d <= 2 THEN 'binary_categorical_target_like' END, CASE WHEN NOT num AND d > 2 AND d <= 20 THEN 'multi_class_target_like' END,
      CASE WHEN NOT num AND d > 2 THEN 'ordinary_multiclass_feature_penalty' END, CASE WHEN NOT num THEN 'generic_feature_penalty' END, CASE WHEN NOT num AND d > 10 THEN 'high_cardinality_feature_penalty' END,
      CASE WHEN NOT num AND d <= 20 THEN 'plausible_class_target' END, 'complete_column') AS reasons FROM c WHERE d > 1),
r AS (SELECT *, row_number() OVER (ORDER BY raw DESC, ordinal) AS place FROM p WHERE raw > 0),
t AS (SELECT max(raw) FILTER (WHERE place = 1) - max(raw) FILTER (WHERE place = 2) < 2.0 OR 0.4 + max(raw) / 10 < 0.7 AS unsure FROM r)
SELECT CAST(place AS INTEGER) AS rank, col AS "column", round(raw, 4) AS score, reasons, coalesce(unsure, FALSE) AS requires_user_confirmation FROM r, t""")
def target_reasons_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked targets with their reasons, a weight column among them, and whether to ask."""
    df = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 2).alias("sample_weight"), (F.col("event_id") % 2).alias("label"))
    r = detect.target_candidates(df)
    rows = [(k, x["column"], x["score"], "|".join(x["reasons"]), r["requires_user_confirmation"]) for k, x in enumerate(r["target_candidates"], 1)]
    return spark.createDataFrame(rows, "rank int, column string, score double, reasons string, requires_user_confirmation boolean")


@query(f"""WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders),
m AS (SELECT p FROM g WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1),
t AS (SELECT o_orderkey, coalesce(p, (SELECT p FROM m)) AS p, CAST(try_strptime(d, '%m/%d/%Y') AS TIMESTAMP) AS d FROM g JOIN {_DATED} USING (o_orderkey))
SELECT *, CAST(year(d) AS INTEGER) AS "d Year", CAST(month(d) AS INTEGER) AS "d Month", CAST(day(d) AS INTEGER) AS "d Day", CAST(isodow(d) - 1 AS INTEGER) AS "d Weekday" FROM t""")
def cleaning_chain_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: repeated rows, markers, gaps and text dates."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, " N/A ").otherwise(F.col("o_orderpriority")).alias("p")).join(_dated(spark, sf_dir), "o_orderkey")
    return service.preprocess(rows.unionByName(rows.where(F.col("o_orderkey") % 10 == 0)))[0]


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q, CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice END AS y FROM lineitem),
m AS (SELECT avg(q) AS fill FROM t WHERE y IS NOT NULL), f AS (SELECT l_orderkey, l_linenumber, coalesce(q, fill) AS q, y FROM t, m),
w AS (SELECT regr_slope(y, q) AS a, regr_intercept(y, q) AS b FROM f)
SELECT l_orderkey, l_linenumber, round(a * q + b, 3) AS prediction FROM f, w""")
def linear_predictions_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a target are left out of training, gaps filled by training's mean, and every row is predicted."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"), F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice")).alias("y"))
    known = df.select("q", "y")
    prep = prepare.fit(known, "y")
    rows = models.assembled(prepare.training_frame(known, prep), prep.features)
    fit = models.suite("Regression", 1)[0][1].fit(rows.select("features", "label"))
    out = automl.score(df.drop("y"), {"preparation": prep, "model": fit})
    return out.select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))
