"""Best-two-fit packing of tokenised documents into sequences.

Documents are cut into pieces of at most `size` tokens (only the first piece of a document may be
shorter than `size` when there are several). What decides a packing is only how many pieces there
are of each length, so the plan is made from that histogram (at most `size` rows, however many
documents there are): a sequence is filled greedily with the longest length that still fits, then its
smallest piece is replaced with two unpacked pieces that fit the gap more tightly, as long as there are
such. The same sequence is repeated while the counts last. The pieces then get exact ranks within
their length (salted, so that a frequent length is spread over many tasks) and ranks map to places.

With positions of the documents (those of a mix), pieces are ranked within their length by position instead, in
ranges of positions, and the sequences are numbered by the position of their first piece, which is their longest:
read by number, they follow the mix. The plan, and so the number of sequences, is the same.

Defined results: a null text is empty, and a document without tokens is its end id alone; equal
rows are packed as pieces of their own; an empty table gives an empty table; ties go by id, then piece.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import as_schema, give_back, rows_of, spread, with_before, written
from tabloom.llm.encoding import SLICE, encoder

#: Rows of one length that are ranked together.
RANKED = 100
#: Positions whose pieces, or sequences, are ranked together.
RANGE = 1000


def crc_of(ids: bytes, dtype: np.dtype) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if dtype.itemsize == 4 else np.frombuffer(ids, dtype).astype("<u4").tobytes())


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema = as_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end, width = np.array([end_id], encode.dtype).tobytes(), encode.dtype.itemsize
        for batch in rows_of(batches, SLICE):
            row, piece, start, length, crc = [], [], [], [], []
            for n, ids in enumerate(encode.ids_of(batch.column(1))):
                ids += end
                total = len(ids) // width
                first = total % size or size
                for k, at in enumerate([0, *range(first, total, size)]):
                    to = at + (size if k else min(first, total))
                    row.append(n)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(crc_of(ids[at * width : to * width], encode.dtype))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], schema=schema)
        # the worker outlives this stage, and its store would stand beside what others need
        encode.forget()
        give_back()

    return docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).mapInArrow(run, ddl)


class _Left:
    """Lengths that are still unpacked; the longest at or below a bound is found in a bit set."""

    def __init__(self, counts: dict[int, int]):
        self.counts = Counter(counts)
        self.bits = sum(1 << x for x, n in counts.items() if n)

    def at_most(self, bound: int) -> int:
        """The longest length left that is at most bound; 0 if there is none."""
        return (self.bits & ((1 << (bound + 1)) - 1)).bit_length() - 1 if bound > 0 and self.bits & ((1 << (bound + 1)) - 1) else 0

    def take(self, length: int, n: int = 1) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            self.bits &= ~(1 << length)

    def give(self, length: int) -> None:
        self.counts[length] += 1
        self.bits |= 1 << length


def _two(left: _Left, gap: int, smallest: int) -> tuple[int, int] | None:
    """Two lengths left whose sum is at most gap, over `smallest`, and as large as can be."""
    best, found = smallest, None
    a = left.at_most(gap - 1)
    while a and 2 * a > best:
        b = left.at_most(min(a, gap - a))
        if b == a and left.counts[a] < 2:
            b = left.at_most(a - 1)
        if b and a + b > best:
            best, found = a + b, (a, b)
            if best == gap:
                break
        a = left.at_most(a - 1)
    return found


def plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Sequences as (lengths in order of place, number of such sequences), together holding all pieces."""
    left, out = _Left(counts), []
    while left.bits:
        fill, room = [], size
        while x := left.at_most(room):
            left.take(x)
            fill.append(x)
            room -= x
        while room and fill and (pair := _two(left, room + fill[-1], fill[-1])):
            last = fill.pop()
            left.give(last)
            for x in pair:
                left.take(x)
            room += last - sum(pair)
            fill = sorted([*fill, *pair], reverse=True)
        need = Counter(fill)
        # Whole repeats of this fill, but never below what its choices took from; one is taken already.
        more = min(left.counts[x] // n for x, n in need.items())
        for x, n in need.items():
            if more:
                left.take(x, n * more)
        out.append((fill, 1 + more))
    return out


def _places(made: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """By length: first rank, first sequence and number in each fill, and the offsets there, of each planned fill."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    first = 0
    for fill, times in made:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in fill:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, o in offsets.items():
            out.setdefault(x, []).append((used[x], first, len(o), np.array(o, np.int64)))
            used[x] += len(o) * times
        first += times
    return {x: (*(np.array(c, np.int64) for c in list(zip(*v, strict=True))[:3]), [y[3] for y in v]) for x, v in out.items()}


def ranked(pieces: DataFrame, counts: dict[int, int], id_col: str) -> DataFrame:
    """pieces with `rank`: 0, 1, ... within each length, without a gap; the rows of a length are spread over many tasks.

    If pieces have a column position, ranks go by it.
    """
    spark = pieces.sparkSession
    many = spark.createDataFrame([(x, -(-n // RANKED)) for x, n in counts.items()] or [(0, 1)], "length bigint, buckets bigint")
    # `many` has a row for each length, 2048 at most
    dealt = pieces.join(F.broadcast(many), "length").withColumn("bucket", spread(F.struct(f"`{id_col}`", "piece"), F.col("buckets"))).drop("buckets")
    order = [F.col(f"`{id_col}`"), "piece", "ids_crc32"]
    if "position" in pieces.columns:
        dealt, order = pieces.withColumn("bucket", F.floor(F.col("position") / RANGE)), ["position", *order]
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = with_before(sums, ["length"], "bucket", {"n": "before"}).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))
    return dealt.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("inside") - 1 + F.col("before")).drop("bucket", "inside", "before")


def packed(pieces: DataFrame, size: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """pieces with sequence_id and offset. `pieces` is read three times: pass a written table.

    If pieces have a column position, ranks and sequence numbers go by it, and it is not returned.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length
    place = _places(plan(counts, size))
    kind = pieces.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    mixed = ["position"] if "position" in pieces.columns else []
    ddl += ", position bigint" if mixed else ""
    schema = as_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                starts, firsts, each, offsets = place[int(x)]
                k = np.searchsorted(starts, rank[at], side="right") - 1
                own = rank[at] - starts[k]
                sequence[at] = firsts[k] + own // each[k]
                offset[at] = [offsets[a][b] for a, b in zip(k, own % each[k], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]], schema=schema)

    out = ranked(pieces, counts, id_col).select(f"`{id_col}`", "piece", "start", "length", "ids_crc32", F.col("rank").cast("bigint"), *mixed).mapInArrow(run, ddl)
    return _renumbered(written(out, "packed")) if mixed else out


def _renumbered(out: DataFrame) -> DataFrame:
    """Sequences numbered by the position of their piece at offset 0: sums over ranges of positions, then inside a range."""
    first = out.where("offset = 0").select("sequence_id", "position", F.floor(F.col("position") / RANGE).alias("range"))
    sums = first.groupBy("range").agg(F.count("*").alias("n"))
    before = with_before(sums, [], "range", {"n": "before"}).drop("n")
    inside = F.row_number().over(Window.partitionBy("range").orderBy("position", "sequence_id"))
    numbers = first.withColumn("inside", inside).join(before, "range").select("sequence_id", (F.col("before") + F.col("inside") - 1).alias("number"))
    columns = [F.col("number").alias(c) if c == "sequence_id" else F.col(f"`{c}`") for c in out.columns if c != "position"]
    return out.join(numbers, "sequence_id").select(*columns)


def best_two_fit(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", positions: DataFrame | None = None) -> DataFrame:
    """Tokenises once (the pieces, without ids, are written to the shared folder), plans and places.

    positions: rows (id, position) of all ids, for sequences in their order; of several rows of an id, the first counts.
    """
    pieces = written(token_pieces(docs, tokenizer, end_id, size, id_col, text_col), "pieces")
    if positions is not None:
        own = positions.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.min("position").alias("position"))
        pieces = written(pieces.join(own, F.col(f"`{id_col}`").eqNullSafe(F.col("_id"))).drop("_id"), "placed-pieces")
    return packed(pieces, size, id_col)
