"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. Two fingerprints at most `radius` bits apart agree on some
segment up to a few bits (pigeonhole: with radius = a * segments + b, within a bits on one of the first
b + 1 segments or within a - 1 bits on one of the others). Every fingerprint therefore looks up a small
Hamming ball around each of its segment values in a table of all segment values, and the whole distance
is verified inside the join. Copies share one fingerprint and so one table row. In a table bucket, links
between two fingerprints that both lie within the radius of the bucket's smallest one are implied by
their links to it and are not made: a crowded bucket gives a star, not all pairs. Components come from
alternating large and small stars, checkpointed, on the cluster. Every table here grows with the documents,
so no join may broadcast one.

Defined results: a null or wordless text has fingerprint zero and links like any other; equal rows
each get a row; a null id is never a component id unless all ids of the component are null; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import as_schema, checkpointed, dealt, rows_of, written

#: Shingles whose bits are counted at a time.
_STEP = 1 << 15


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """A-Z lower-cased, words at ASCII white space; a bit is 1 if set in over half of the shingles' XXH64."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        to = min(n, at + _STEP)
        h = np.fromiter((digest(b" ".join(words[i : i + shingle]), seed) for i in range(at, to)), "<u8", to - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (bigint with the fingerprint's bits) of every row; narrow."""
    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint"
    schema = as_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = np.array([fingerprint(x, shingle, seed) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], schema=schema)

    return docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).mapInArrow(run, ddl)


def layout(segments: int, radius: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(first bit, width, radius of the ball) of each segment; a segment that needs no look-up is left out."""
    base, more = divmod(bits, segments)
    a, b = divmod(radius, segments)
    out, at = [], 0
    for k in range(segments):
        width = base + (k < more)
        ball = a if k <= b else a - 1
        if ball >= 0:
            out.append((at, width, ball))
        at += width
    return out


def ball(width: int, radius: int) -> list[int]:
    """All masks of `width` bits with at most `radius` ones."""
    return [sum(1 << i for i in x) for r in range(radius + 1) for x in itertools.combinations(range(width), r)]


def near_links(fps: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """Links (a, b) between nodes of different fingerprints of `fps` (columns fp, node; distinct rows) at most `radius` bits apart, enough to connect all that are.

    `segments` weighs tables against look-ups, and any gives the same links: 3 (the default) looks up 46 keys a fingerprint in
    buckets of n / 2**21, and 2, for more than some 10**8 different fingerprints, 562 keys in buckets of n / 2**32.
    """
    parts = layout(segments, radius)

    def value(at: int, width: int):
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))

    own = F.array(*(F.struct(F.lit(k).alias("k"), value(at, width).alias("v")) for k, (at, width, _) in enumerate(parts)))

    def around(k: int, at: int, width: int, r: int):
        return F.transform(F.array(*(F.lit(m).cast("bigint") for m in ball(width, r))), lambda m: F.struct(F.lit(k).alias("k"), value(at, width).bitwiseXOR(m).alias("v")))

    near = F.concat(*(around(k, *part) for k, part in enumerate(parts)))
    keys = fps.select("fp", "node", F.inline(own))
    # the smallest of a bucket, summed up before the shuffle: a crowded bucket is no task's own
    stars = keys.groupBy("k", "v").agg(F.min("fp").alias("star"))
    probes = fps.select(F.col("fp").alias("a"), F.col("node").alias("own"), F.inline(near))
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    p, t = probes.alias("p"), dealt(keys.join(dealt(stars), ["k", "v"])).alias("t")
    on = (F.col("p.k") == F.col("t.k")) & (F.col("p.v") == F.col("t.v")) & (F.col("a") != F.col("fp")) & (apart("a", "fp") <= radius) & ((F.col("fp") == F.col("star")) | (apart("a", "star") > radius) | (apart("fp", "star") > radius))
    return p.join(t, on).select(F.col("own").alias("a"), F.col("node").alias("b"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and its component's smallest node, for every node of links (a, b); alternating large and small stars.

    Each round is checkpointed; the rounds needed grow with the logarithm of a component's size, and running
    out of `rounds` raises instead of returning a wrong answer.
    """
    edges = checkpointed(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: all larger neighbours to the smallest of the neighbourhood
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(dealt(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: a node and its smaller neighbours to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(dealt(low), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def rooted(prints: DataFrame, radius: int = 4, segments: int = 3, id_col: str = "doc_id") -> DataFrame:
    """fp and root: the node of the fingerprint that stands for the whole component, which is that of the least id.

    A node is (no id, least id of the fingerprint's rows, fp): the root names its component, and nothing is gathered by it.
    """
    least = F.min(f"`{id_col}`")
    fps = written(prints.groupBy("fp").agg(least.alias("least")).select("fp", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("fp")).alias("node")), "fps")
    roots = components(near_links(fps, radius, segments)).select(F.col("node.fp").alias("of"), "root")
    # a root is a node of its component but not of `roots`
    return fps.join(dealt(roots), fps.fp == roots.of, "left").select("fp", F.coalesce("root", "node").alias("root"))


def grouped(prints: DataFrame, radius: int = 4, segments: int = 3, id_col: str = "doc_id") -> DataFrame:
    """prints (id, fp) with component_id. `prints` is read several times: pass a written table."""
    return prints.join(dealt(rooted(prints, radius, segments, id_col).select("fp", F.col("root.id").alias("component_id"))), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, radius: int = 4, segments: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (smallest id reachable by links) of every row."""
    prints = written(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    return grouped(prints, radius, segments, id_col).select(f"`{id_col}`", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a shingle for similarity, and the MinHash bands and values of a band: a pair of similarity 0.8 has none in common with probability (1 - 0.8 ** 4) ** 20 = 3e-5.
WORDS, BANDS, IN_BAND = 5, 20, 4
_MULT, _ADD = (np.random.default_rng(7).integers(0, 1 << 64, (2, BANDS * IN_BAND, 1), np.uint64) | np.array([1, 0], np.uint64)[:, None, None])


def shingles(text: str) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of WORDS words; a shorter text is one shingle, a wordless one has none."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - WORDS + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + WORDS])) for i in range(n)), np.uint64, n))


def bands(found: np.ndarray) -> list[int]:
    """A signed 64-bit key for each MinHash band of a set of shingles that is not empty."""
    least = np.full(BANDS * IN_BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (_MULT * found[None, at : at + 4096] + _ADD).min(1))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, IN_BAND))]


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id and key (a hash of the whole row), fp, and of its shingles: node (a hash of them and fp), their number n, and bands; narrow."""
    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, key bigint, fp bigint, node bigint, n int, bands array<bigint>"
    schema = as_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            fps, nodes, sizes, keys = [], [], [], []
            for x in batch.column(2).to_pylist():
                fp, own = fingerprint(x), shingles(x)
                fps.append(fp)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), fp) - (1 << 63))
                sizes.append(len(own))
                keys.append(bands(own) if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, schema.field(5).type)], schema=schema)

    return docs.select(F.col(f"`{id_col}`"), row_key(docs).alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).mapInArrow(run, ddl)


def row_key(docs: DataFrame):
    """A hash of all columns of a row, with which of them are null."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*own, *(c.isNull() for c in own))


#: Longs of a bitmap of shingles, and members of a bucket that one task holds against the others.
BITMAP, BLOCK = 32, 128


def bitmap(found: np.ndarray) -> np.ndarray:
    """BITMAP longs with the bits set that shingles fall on. Two sets differ in at least as many shingles as their bitmaps in bits."""
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[(found % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, its shingles and their bitmap, from rows (node, text)."""
    ddl = "node bigint, shingles array<bigint>, bits array<bigint>"
    schema = as_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [shingles(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in found], schema.field(1).type), pa.array([bitmap(x) for x in found], schema.field(2).type)], schema=schema)

    return texts.mapInArrow(run, ddl)


def similar_links(docs: DataFrame, prints: DataFrame, roots: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) between roots of which two texts have an exact Jaccard similarity of 0.8 or more, enough to connect all that have (and share a band).

    Copies share a node. Each member of a bucket is held first against the bucket's centre: the member that meets the most
    others over all its bands, which in a crowd of near copies is what they are copies of. What that connects needs no
    further link, so only buckets that still hold several components are looked at again, across components alone. There
    the join itself drops pairs whose bitmaps differ in over a ninth of both sizes: a similarity of 0.8 leaves room for no
    more different shingles, so no link is lost, and hardly any pair that is not alike has its shingles fetched.
    """
    nodes = prints.where("n > 0").groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("bands").alias("bands"))
    keys = written(nodes.join(dealt(roots), "fp").select("node", "n", "root", F.explode("bands").alias("v")), "bands")
    crowds = keys.groupBy("v").agg(F.count("*").alias("many"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("v", "many")
    keys = written(keys.join(dealt(crowds), "v"), "band-members")  # of buckets with several roots
    met = keys.groupBy("node").agg(F.sum("many").alias("met"))
    stars = keys.join(dealt(met), "node").groupBy("v").agg(F.max(F.struct("met", "node", "root", "n")).alias("s"))

    wanted = keys.select("node").distinct()
    one = prints.join(dealt(wanted), "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col(f"`{id_col}`").alias("id"), "key")).alias("x")).select("node", "x.id", "x.key")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), row_key(docs).alias("_key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = texts.join(dealt(one), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")))
    sets = written(shingle_sets(found.select("node", "text")).dropDuplicates(["node"]), "shingles")

    def alike(x: str, y: str):
        return (5 * F.col(x) >= 4 * F.col(y)) & (5 * F.col(y) >= 4 * F.col(x))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(dealt(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))), "a").join(dealt(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))), "b")
        both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
        return written(both.where(9 * F.col("common") >= 4 * (F.size("sa") + F.size("sb"))).select(F.col("ra").alias("a"), F.col("rb").alias("b")), name)

    keys = written(keys.join(dealt(stars), "v").select("v", "node", "n", "root", F.col("s.node").alias("star"), F.col("s.root").alias("star_root"), F.col("s.n").alias("star_n")), "band-stars")
    first = keys.where((F.col("root") != F.col("star_root")) & alike("n", "star_n")).select(F.col("star").alias("a"), F.col("node").alias("b"), F.col("star_root").alias("ra"), F.col("root").alias("rb")).distinct()
    first = verified(first, "similar-to-star")
    tops = components(first)

    def top_of(rows: DataFrame, root: str, name: str) -> DataFrame:
        own = tops.select(F.col("node").alias("_of"), F.col("root").alias("_top"))
        return rows.join(dealt(own), F.col(root) == F.col("_of"), "left").withColumn(name, F.coalesce("_top", root)).drop("_of", "_top")

    left = top_of(keys, "root", "top")
    mixed = left.groupBy("v").agg(F.min("top").alias("lo"), F.max("top").alias("hi")).where("lo < hi").select("v")
    left = top_of(left.join(dealt(mixed), "v"), "star_root", "star_top").join(dealt(sets.select("node", "bits")), "node")
    left = written(left, "band-rest")

    def side(rows: DataFrame, name: str, *more: Column) -> DataFrame:
        # the bitmap as columns without nulls: the join's generated code stays small enough to be compiled
        bits = (F.coalesce(F.col("bits")[i], F.lit(0).cast("bigint")).alias(f"{name}_{i}") for i in range(BITMAP))
        return rows.select("v", *more, *(F.col(c).alias(f"{name}_{c}") for c in ("node", "n", "root", "top")), *bits)

    # a crowded bucket is dealt in blocks of about BLOCK members, each held against all others
    sizes = left.where("top <> star_top").groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    left = left.join(dealt(sizes), "v")
    x = side(left.where("top <> star_top"), "x", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    y = side(left.where("node <> star"), "y", (F.col("top") == F.col("star_top")).alias("linked"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    differ = sum((F.bit_count(F.col(f"x_{i}").bitwiseXOR(F.col(f"y_{i}"))) for i in range(BITMAP)), F.lit(0))
    may_be = alike("x_n", "y_n") & (9 * differ <= F.col("x_n") + F.col("y_n"))
    rest = x.join(dealt(y), ["v", "block"]).where((F.col("x_top") != F.col("y_top")) & (F.col("linked") | (F.col("x_node") < F.col("y_node"))) & may_be)
    low = F.col("x_node") < F.col("y_node")
    rest = rest.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"), F.when(low, F.col("x_root")).otherwise(F.col("y_root")).alias("ra"), F.when(low, F.col("y_root")).otherwise(F.col("x_root")).alias("rb")).distinct()
    return first.unionByName(verified(rest, "similar"))


def without_copies(docs: DataFrame, radius: int = 4, segments: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of docs: that of its smallest id, null last. All columns stay.

    Texts are linked if their fingerprints are at most `radius` bits apart, or if the Jaccard similarity of their
    shingles of five words is 0.8 or more. Rows of equal or null ids are told apart by a hash of the whole row.
    """
    prints = written(prepared(docs, id_col, text_col), "fingerprints")
    roots = written(rooted(prints, radius, segments, id_col).select("fp", F.col("root.fp").alias("root")), "roots")
    above = components(similar_links(docs, prints, roots, id_col, text_col)).withColumnRenamed("root", "top")
    tops = roots.join(dealt(above), roots.root == above.node, "left").select("fp", F.coalesce("top", "root").alias("root"))
    own = F.col(f"`{id_col}`")
    best = prints.join(dealt(tops), "fp").groupBy("root").agg(F.min(F.struct(own.isNull().alias("none"), own.alias("id"), F.col("key"))).alias("x"))
    kept = written(best.select(F.col("x.id").alias("id"), F.col("x.key").alias("key")), "kept")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), own.alias("own"), row_key(docs).alias("hash"))
    out = rows.join(dealt(kept), F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("key")), "left_semi")
    repeated = prints.groupBy(own, "key").count().where("count > 1").limit(1).count()
    return (out.dropDuplicates(["own", "hash"]) if repeated else out).select("row.*")
