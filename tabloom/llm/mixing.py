"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions alone.

The documents of a source, in id order, are cut into pieces of half a block, about `block` / 2 characters (a document counts
its characters and one more, and belongs to the half-block its start lies in). Weights become whole numbers v_i of a
total W (in units of 2**-24, `LEAST` units at least). The run is cut into periods of P slots. By the end of period q,
source i has had A_i(q) = floor(q P V_i / W) - floor(q P V_(i-1) / W) half-blocks, V being running sums of v: less than one
away from its exact due, in all periods, so nothing is carried away by rounding. Within a period the source has p_i of the P
slots, and its k-th half-block there may not go before its release floor((k - 1) P / p_i) and must go before its
deadline ceil(k P / p_i). The earliest deadline among the released goes first, which meets every deadline. So a
source is less than one half-block from the line between two period ends, and that less than one from its exact due:
anywhere in a run of any length, less than one block away from its target weight.

A source that has run out leaves its slots empty, and the others keep their shares among themselves; the last
one goes on alone in its order. No document is dropped or repeated.

Sizes: P is `period`, or as many slots as give each source two (`2 W / min v`, at most 2**16). Periods are worked out
independently, each from one row with the sources' weights (8 bytes a source, broadcast); everything that grows
with the documents is in range buckets: places in a source come from prefix sums over buckets of ids, places in
the mix from prefix sums over buckets of slots.

Defined results: a null source is a source of its own, other than ''; a null text has no characters; rows with equal
ids stand beside each other in the order of their length; null ids come first; ids must be whole numbers (TypeError); a
weight of a source without documents is passed over, one that is null, not above 0 or not a number counts as the least; an
empty table gives an empty table; other columns are not read by `schedule`, and `mixed` returns all of them, whatever their
names, and rows as many times as they are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import range_of, whole_number_id, with_before, written
from tabloom.llm.rules import let

#: Characters of a block, least slots of a period, and the power of a source's size that its weight is by default.
BLOCK, PERIOD, POWER = 32_768, 1024, 0.7
#: Units of the whole weight, and the least that a source counts as: a share of 2**-15.
UNITS, LEAST = 1 << 24, 1 << 9
#: Slots whose blocks are summed together, and slots that are worked out before they join the rest of a period.
SLOTS, CHUNK = 4096, 256


def _key(source: Column) -> Column:
    """A source's name that is not null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def quotas(sources: DataFrame, period: int = PERIOD) -> DataFrame:
    """One row: names, cums (running sums of v), total (their last) and slots of a period, from rows (source, weight); none without sources."""
    good = F.coalesce(F.when(F.isnan("weight") | (F.col("weight") <= 0), 0.0).otherwise(F.col("weight")), F.lit(0.0))
    one = sources.agg(F.array_sort(F.collect_list(F.struct("source", good.alias("weight")))).alias("s")).where(F.size("s") > 0)
    all_ = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["weight"])
    one = one.select(F.transform("s", lambda x: x["source"]).alias("names"), F.col("s"), F.greatest(all_, F.lit(1e-300)).alias("all"))
    one = one.select("names", F.transform("s", lambda x: F.greatest(F.lit(LEAST), F.round(x["weight"] / F.col("all") * UNITS)).cast("bigint")).alias("v"))
    cums = F.aggregate("v", F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    one = one.select("names", "v", cums.alias("cums")).withColumn("total", F.element_at("cums", -1))
    return one.select("names", "cums", "total", F.greatest(F.lit(period), F.expr("(2 * total + array_min(v) - 1) div array_min(v)")).cast("bigint").alias("slots"))


def _due(x: Column, slots: Column) -> Column:
    """Deadline of the next half-block of a source: ceil((k + 1) P / p)."""
    return F.ceil((x["k"] + 1) * slots / x["p"])


def _turn(near: Column, slots: Column, slot: Column) -> Column:
    """(d, i, k) of the source to go in a slot: of released next half-blocks, that of the earliest deadline."""
    return F.array_min(F.transform(near, lambda x: F.when((x["k"] < x["p"]) & (x["k"] * slots < (slot + 1) * x["p"]), F.struct(_due(x, slots).alias("d"), x["i"].alias("i"), x["k"].alias("k")))))


def _chunk(state: Column, slots: Column, at: Column) -> Column:
    """The state (s: i, p, k by source; out) after the slots from `at` to the chunk's end.

    In CHUNK slots only these can go: of the half-blocks that are released already, the CHUNK of the earliest deadlines, and
    those that are released meanwhile.
    """
    end = F.least(at + CHUNK, slots)
    kind = "array<struct<i:int,k:bigint>>"

    def step(own: Column, slot: Column) -> Column:
        return let(_turn(own["s"], slots, slot), lambda c: F.struct(
            F.transform(own["s"], lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"), (x["k"] + (x["i"] == c["i"]).cast("bigint")).alias("k"))).alias("s"),
            F.concat(own["out"], F.array(F.struct(c["i"].alias("i"), c["k"].alias("k")))).alias("out"),
        ))

    def of(s: Column) -> Column:
        there = F.filter(s, lambda x: (x["k"] < x["p"]) & (x["k"] * slots < (at + 1) * x["p"]))
        last = F.get(F.array_sort(F.transform(there, lambda x: F.struct(_due(x, slots).alias("d"), x["i"].alias("i")))), F.lit(CHUNK - 1))

        def split(bound: Column) -> Column:
            early = lambda x: F.coalesce(F.struct(_due(x, slots).alias("d"), x["i"].alias("i")) <= bound, F.lit(True))
            can = lambda x: (x["k"] < x["p"]) & (x["k"] * slots < end * x["p"]) & ((x["k"] * slots >= (at + 1) * x["p"]) | early(x))
            own = F.aggregate(F.sequence(at, end - 1), F.struct(F.filter(s, can).alias("s"), F.array().cast(kind).alias("out")), step)
            return let(own, lambda o: F.struct(F.array_sort(F.concat(o["s"], F.filter(s, lambda x: ~can(x)))).alias("s"), F.concat(state["out"], o["out"]).alias("out")))

        return let(last, split)

    return let(state["s"], of)


def periods(one: DataFrame, many: int) -> DataFrame:
    """Rows (source, block, release, deadline, slot) of the first `many` periods, from the row of quotas.

    A period's slots are worked out by one task, in chunks; periods are independent of each other.
    """
    spark = one.sparkSession
    q = spark.range(many).withColumnRenamed("id", "q").repartition(max(1, min(many, int(spark.conf.get("spark.sql.shuffle.partitions")))), "q")
    # one row is broadcast
    rows = q.join(F.broadcast(one)).withColumn("a", F.expr("transform(cums, c -> (q * slots * c) div total)")).withColumn("b", F.expr("transform(cums, c -> ((q + 1) * slots * c) div total)"))
    had = F.expr("transform(names, (x, i) -> get(a, i + 1) - get(a, i))")
    p = F.expr("transform(names, (x, i) -> get(b, i + 1) - get(b, i) - get(a, i + 1) + get(a, i))")
    rows = written(rows.select("q", "names", "slots", had.alias("had"), p.alias("p")), "mix-periods")  # else each use would work them out again
    slots = F.col("slots")
    own = F.transform("p", lambda x, i: F.struct(i.alias("i"), x.alias("p"), F.lit(0).cast("bigint").alias("k")))
    start = F.struct(own.alias("s"), F.array().cast("array<struct<i:int,k:bigint>>").alias("out"))
    turns = F.aggregate(F.sequence(F.lit(0).cast("bigint"), slots - 1, F.lit(CHUNK).cast("bigint")), start, lambda state, at: _chunk(state, slots, at), lambda state: state["out"])
    made = rows.select("q", "names", "slots", "had", "p", turns.alias("out"))
    x = made.select("q", "names", "slots", "had", "p", F.posexplode("out").alias("slot", "x"))
    own, k, base = F.get("p", F.col("x.i")), F.col("x.k"), F.col("q") * slots
    return x.select(F.get("names", F.col("x.i")).alias("source"), (F.get("had", F.col("x.i")) + k).alias("block"), (base + F.floor(k * slots / own)).alias("release"), (base + F.ceil((k + 1) * slots / own)).alias("deadline"), (base + F.col("slot")).alias("slot"))


def _blocks_and_places(docs: DataFrame, block: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, source key, n_chars, block, rank in the source), written; and the characters of each source."""
    spark = docs.sparkSession
    whole_number_id(docs, id_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _key(F.col(f"`{source_col}`").cast("string")).alias("source"), F.coalesce(F.length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("bigint").alias("n_chars"))
    rows = written(rows.withColumn("key", F.coalesce(F.col("id").cast("bigint"), F.lit(-(1 << 63)))), "mix-rows")
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx("key", [k / many for k in range(1, many)], 10_000)).first()[0] if many > 1 else []
    rows = rows.withColumn("bucket", range_of(sorted(set(found or [])), "key"))
    # places in the source: sums over buckets of ids, then inside a bucket
    sums = rows.groupBy("source", "bucket").agg(F.sum(F.col("n_chars") + 1).alias("c"), F.count("*").alias("n"))
    before = with_before(sums, ["source"], "bucket", {"c": "c0", "n": "n0"}).drop("c", "n")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "n_chars").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("c1", F.sum(F.col("n_chars") + 1).over(inside)).withColumn("n1", F.count("*").over(inside)).join(before, ["source", "bucket"])
    placed = placed.select("id", "source", "n_chars", F.expr(f"(c0 + c1 - n_chars - 1) div {max(1, block // 2)}").alias("block"), (F.col("n0") + F.col("n1") - 1).alias("rank"))
    return written(placed, "mix-places"), sums.groupBy("source").agg(F.sum("c").alias("c"))


def schedule(docs: DataFrame, weights: DataFrame | dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Of each row: source, n_chars, its half-block there with release, deadline and slot, and position (0, 1, ... without a gap).

    weights: target weights by source, as a dict or (source, weight) rows; sources that it leaves out, and all if it is
    None, get their size to the power POWER.
    """
    spark = docs.sparkSession
    placed, sizes = _blocks_and_places(docs, block, id_col, text_col, source_col)
    sizes = sizes.select("source", F.pow(F.col("c").cast("double"), F.lit(POWER)).alias("weight"))
    if weights is not None:
        given = spark.createDataFrame([*weights.items()], "source string, weight double") if isinstance(weights, dict) else weights
        given = given.groupBy(_key(F.col("source").cast("string")).alias("source")).agg(F.coalesce(F.max(F.col("weight").cast("double")), F.lit(0.0)).alias("given"))
        sizes = sizes.join(given, "source", "left").select("source", F.coalesce("given", "weight").alias("weight"))
    one = written(quotas(sizes, period), "mix-quotas")
    blocks = placed.groupBy("source", "block").agg(F.min("rank").alias("first"), F.count("*").alias("n"))

    # periods until all sources but one have run out; (source, blocks, v) has a row for each source
    of = one.select(F.explode(F.expr("transform(names, (x, i) -> struct(x as source, get(cums, i + 1) - get(cums, i) as v))")).alias("x"), "total", "slots").select("x.source", "x.v", "total", "slots")
    ends = blocks.groupBy("source").agg((F.max("block") + 1).alias("blocks")).join(of, "source").select((F.col("blocks") * F.col("total") / F.col("v") / F.col("slots")).alias("x"))
    two = [r["x"] for r in ends.orderBy(F.desc("x")).limit(2).collect()]
    many = int(two[1]) + 2 if len(two) > 1 else 0
    plan = periods(one, many) if many else spark.createDataFrame([], "source string, block bigint, release bigint, deadline bigint, slot bigint")
    # `of` has a row for each source; only the last source has blocks beyond the plan
    blocks = blocks.join(plan, ["source", "block"], "left").join(of, "source")
    due = F.expr("((block + 1) * total + v - 1) div v")
    blocks = blocks.select("source", "block", "first", "n", F.coalesce("release", F.expr("(block * total) div v")).alias("release"), F.coalesce("deadline", due).alias("deadline"), F.coalesce("slot", due - 1).alias("slot"))
    blocks = written(blocks, "mix-blocks")

    # places in the mix: sums over buckets of slots, then inside a bucket
    blocks = blocks.withColumn("part", F.expr(f"slot div {SLOTS}"))
    parts = with_before(blocks.groupBy("part").agg(F.sum("n").alias("n")), [], "part", {"n": "n0"}).drop("n")
    inner = Window.partitionBy("part").orderBy("slot")
    blocks = blocks.withColumn("n1", F.sum("n").over(inner) - F.col("n")).join(parts, "part").select("source", "block", "release", "deadline", "slot", (F.col("n0") + F.col("n1") - F.col("first")).alias("shift"))
    name = F.when(F.col("source") != "", F.expr("substring(source, 2)"))
    return placed.join(blocks, ["source", "block"]).select(F.col("id").alias(id_col), name.alias("source"), "n_chars", "block", "release", "deadline", "slot", (F.col("shift") + F.col("rank")).alias("position"))


def mixed(docs: DataFrame, weights: DataFrame | dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows and columns of docs in the order of the mix: partition after partition, row after row."""
    own = schedule(docs, weights, block, period, id_col, text_col, source_col)
    places = written(own.select(F.col(f"`{id_col}`").alias("id"), _key(F.col("source")).alias("source"), F.col("n_chars").alias("chars"), "position"), "mix-order")
    total = places.count()
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = places.groupBy("id").count().where("count > 1").limit(1).count()
    chars = F.coalesce(F.length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("bigint")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("own"), _key(F.col(f"`{source_col}`").cast("string")).alias("of"), chars.alias("long"))
    on = F.col("own").eqNullSafe(F.col("id"))
    if repeated:  # number rows of the same id, source and length, on both sides
        alike = Window.partitionBy("own", "of", "long").orderBy(F.xxhash64("row"))
        rows = rows.withColumn("n", F.row_number().over(alike))
        places = places.withColumn("m", F.row_number().over(Window.partitionBy("id", "source", "chars").orderBy("position")))
        on = on & (F.col("of") == F.col("source")) & (F.col("long") == F.col("chars")) & (F.col("n") == F.col("m"))
    joined = rows.join(places, on).select("row", "position")
    part = F.floor(F.col("position") * many / max(1, total)).cast("int")
    return joined.withColumn("part", part).repartitionById(many, F.col("part")).sortWithinPartitions("position").select("row.*")


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce('=' || source, '') AS key, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars FROM documents),
w AS (SELECT key, pow(CAST(sum(n_chars + 1) AS DOUBLE), {POWER}) AS weight FROM d GROUP BY key),
v AS (SELECT key, CAST(greatest({LEAST}, round(weight / (SELECT sum(weight) FROM w) * {UNITS})) AS BIGINT) AS v FROM w),
c AS (SELECT key, v, CAST(sum(v) OVER (ORDER BY key) AS BIGINT) AS cum, (SELECT CAST(sum(v) AS BIGINT) FROM v) AS total, (SELECT greatest({PERIOD}, (2 * CAST(sum(v) AS BIGINT) + min(v) - 1) // min(v)) FROM v) AS slots FROM v),
b AS (SELECT *, (sum(n_chars + 1) OVER m - n_chars - 1) // {BLOCK // 2} AS block, row_number() OVER m AS rank
      FROM d WINDOW m AS (PARTITION BY key ORDER BY doc_id NULLS FIRST, n_chars ROWS UNBOUNDED PRECEDING)),
x AS (SELECT coalesce((SELECT CAST(floor(y) AS BIGINT) + 2 FROM (SELECT max((block + 1) * total / v / slots) AS y FROM b JOIN c USING (key) GROUP BY key) ORDER BY y DESC LIMIT 1 OFFSET 1), 0) AS many),
a AS (SELECT q, key, slots, (q * slots * cum) // total - (q * slots * (cum - v)) // total AS had, ((q + 1) * slots * cum) // total - ((q + 1) * slots * (cum - v)) // total - (q * slots * cum) // total + (q * slots * (cum - v)) // total AS p
      FROM c, (SELECT unnest(range(many)) AS q FROM x)),
one AS (SELECT q, list(key ORDER BY key) AS names, list(CAST(had AS BIGINT) ORDER BY key) AS had, list(CAST(p AS BIGINT) ORDER BY key) AS p, any_value(slots) AS slots FROM a GROUP BY q),
e(q, slot, done, c) AS (
    SELECT q, CAST(-1 AS BIGINT), list_transform(p, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM one
    UNION ALL
    SELECT q, slot, list_transform(done, lambda x, i: x + CASE WHEN i = c THEN 1 ELSE 0 END), c FROM (
        SELECT e.q, e.slot + 1 AS slot, e.done, list_min(list_transform(list_filter(range(1, len(p) + 1), lambda i: done[i] < p[i] AND done[i] * slots < (e.slot + 2) * p[i]), lambda i: {{'d': CAST(ceil((done[i] + 1) * slots / p[i]) AS BIGINT), 'i': i}})).i AS c
        FROM e JOIN one ON e.q = one.q WHERE e.slot + 1 < slots)),
s AS (SELECT names[c] AS key, had[c] + done[c] - 1 AS block, e.q * slots + CAST(floor((done[c] - 1) * slots / p[c]) AS BIGINT) AS release, e.q * slots + CAST(ceil(done[c] * slots / p[c]) AS BIGINT) AS deadline, e.q * slots + slot AS slot
      FROM e JOIN one ON e.q = one.q WHERE slot >= 0)
SELECT doc_id, source, n_chars, CAST(b.block AS BIGINT) AS block, CAST(coalesce(release, b.block * total // v) AS BIGINT) AS release, CAST(coalesce(deadline, ((b.block + 1) * total + v - 1) // v) AS BIGINT) AS deadline,
    CAST(coalesce(slot, ((b.block + 1) * total + v - 1) // v - 1) AS BIGINT) AS slot, row_number() OVER (ORDER BY coalesce(slot, ((b.block + 1) * total + v - 1) // v - 1), rank) - 1 AS position
FROM b JOIN c ON b.key = c.key LEFT JOIN s ON b.key = s.key AND b.block = s.block
"""
