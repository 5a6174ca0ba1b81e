"""Token ids in Arrow IPC files of equal-length sequences.

All ids of all documents, each document followed by an end id, make one stream in ascending id order.
The stream is stored in shards, one range of ids each. A shard is an Arrow file (random access by record
batch, uncompressed, so a memory map gives arrays without a copy):

    shard-00000.arrow    ids: fixed_size_list<uint16 or uint32>[length], mask: fixed_size_list<bool>[length]
    shard-00000.docs.arrow    document index: id, start (within the shard), n_tokens

The ids of a shard fill its sequences without a gap; the last sequence is filled up with zeros, and its mask
says which places hold ids. Files are written beside their name and renamed when whole, and a shard's
content follows from its rows alone, so a task that runs again writes the same file.

Defined results: a null text is empty (its end id alone); rows with equal ids follow each other by text;
null ids come first; an empty table gives no shard and an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import as_schema, rows_of, scratch_path
from tabloom.llm.encoding import SLICE, encoder

#: Sequences in one record batch: the unit of random access.
BATCH = 256


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class ShardWriter:
    """Writes one shard. Holds at most a batch of sequences, and the document index of the shard (24 bytes a document)."""

    def __init__(self, path: str, shard: int, length: int, dtype: np.dtype, id_type: pa.DataType):
        self.fs, root = _filesystem(path)
        self.name, self.tail = f"{root}/shard-{shard:05d}", uuid.uuid4().hex
        self.fs.create_dir(root, recursive=True)
        self.length, self.dtype, self.id_type = length, dtype, id_type
        self.kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(f"{self.name}.arrow.{self.tail}")
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held: list[bytes] = []
        self.size = self.total = 0
        self.docs: list = []
        self.counts: list[int] = []

    def add(self, doc, ids: bytes) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids) // self.dtype.itemsize)
        self.total += self.counts[-1]
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BATCH * self.length * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        whole = -(-len(ids) // self.length) if last else len(ids) // self.length
        cut = min(len(ids), whole * self.length)
        self.held = [ids[cut:].tobytes()]
        self.size = len(self.held[0])
        flat = np.zeros(whole * self.length, self.dtype)
        flat[:cut] = ids[:cut]
        for at in range(0, whole, BATCH):
            part = flat[at * self.length : (at + BATCH) * self.length]
            used = np.arange(at * self.length, at * self.length + len(part)) < cut
            self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(part), self.length), pa.FixedSizeListArray.from_arrays(pa.array(used), self.length)], schema=self.schema))

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the shard, whose files now have their names."""
        self._flush(True)
        self.file.close()
        self.out.close()
        counts = np.array(self.counts, np.int64)
        index = pa.table([pa.array(self.docs, self.id_type), pa.array(np.cumsum(counts) - counts), pa.array(counts)], names=["id", "start", "n_tokens"])
        with self.fs.open_output_stream(f"{self.name}.docs.arrow.{self.tail}") as out, pa.ipc.new_file(out, index.schema) as file:
            file.write_table(index)
        for end in ("docs.arrow", "arrow"):
            self.fs.move(f"{self.name}.{end}.{self.tail}", f"{self.name}.{end}")
        return len(self.docs), self.total


class ShardReader:
    """Random access to the sequences, masks and documents of one shard."""

    def __init__(self, path: str, shard: int):
        from pyarrow import fs

        system, root = _filesystem(path)
        name = f"{root}/shard-{shard:05d}"
        opened = (lambda p: pa.memory_map(p)) if isinstance(system, fs.LocalFileSystem) else system.open_input_file
        self.file = pa.ipc.open_file(opened(f"{name}.arrow"))
        self.docs = pa.ipc.open_file(opened(f"{name}.docs.arrow")).read_all()
        self.length = self.file.schema.field("ids").type.list_size

    def batch(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequences (a view of the file) and masks of one record batch."""
        b = self.file.get_batch(at)
        return b.column(0).flatten().to_numpy().reshape(-1, self.length), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.length)

    def sequence(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        first, inside = divmod(at, BATCH)
        ids, mask = self.batch(first)
        return ids[inside], mask[inside]

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """(id, start, ids) of each document, from the sequences' masked places; one record batch is held at a time."""
        held, at, start = np.zeros(0, self.file.schema.field("ids").type.value_type.to_pandas_dtype()), 0, 0
        parts, size = [held], 0
        for doc, first, n in zip(*(self.docs.column(k).to_pylist() for k in range(3)), strict=True):
            while size - start < n:
                ids, mask = self.batch(at)
                flat = ids.reshape(-1)
                used = int(mask.sum())
                parts = [held[start:], flat[:used]]
                held, start, at = np.concatenate(parts), 0, at + 1
                size = len(held)
            yield doc, first, held[start : start + n]
            start += n


def _boundaries(docs: DataFrame, id_col: str, shards: int) -> list:
    """At most shards - 1 ids that cut the rows into about equal ranges (approximate quantiles of the ids alone)."""
    if shards < 2:
        return []
    found = docs.agg(F.percentile_approx(f"`{id_col}`", [k / shards for k in range(1, shards)], 10_000)).first()[0]
    return sorted(set(found or []))


def write_sequences(docs: DataFrame, tokenizer: str, end_id: int, path: str, length: int = 2048, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int]]:
    """Writes all shards below path; returns (shard, documents, ids) of each, in id order."""
    spark = docs.sparkSession
    cuts = _boundaries(docs, id_col, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_type = as_schema(f"x {docs.schema[id_col].dataType.simpleString()}").field(0).type
    shard = F.lit(0)
    if cuts:
        # the number of a row's range; the cuts are as many as the shards
        shard = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("id"))) if len(cuts) < 64 else F.expr(_search(cuts))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("shard", F.when(F.col("id").isNull(), F.lit(0)).otherwise(shard).cast("int"))
    dealt = rows.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "text")
    schema = as_schema("shard int, docs bigint, ids bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        writer, own, done = None, None, []
        for batch in rows_of(batches, SLICE):
            ids = encode.ids_of(batch.column(1))
            for doc, k, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ids, strict=True):
                if k != own:
                    if writer:
                        done.append((own, *writer.close()))
                    writer, own = ShardWriter(path, k, length, encode.dtype, id_type), k
                writer.add(doc, x + end)
        if writer:
            done.append((own, *writer.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)

    # one row for each shard comes back
    return sorted(tuple(r) for r in dealt.select("id", "text", "shard").mapInArrow(run, "shard int, docs bigint, ids bigint").collect())


def _search(cuts: list) -> str:
    """A balanced CASE over sorted cuts: the number of cuts below id, in a logarithm of comparisons."""

    def part(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN id > {cuts[mid]!r} THEN {part(mid + 1, hi)} ELSE {part(lo, mid)} END"

    return part(0, len(cuts))


def read_documents(spark: SparkSession, path: str, shards: list[tuple[int, int, int]], id_type: str = "bigint") -> DataFrame:
    """A row for each document, from the files: doc_id, start, n_tokens, ids_crc32, shard. One task reads one shard."""
    ddl = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint, shard int"
    schema = as_schema(ddl)
    first, before = {}, 0
    for k, _, n in shards:
        first[k], before = before, before + n
    order = [k for k, *_ in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                reader = ShardReader(path, order[at])
                rows = []
                for doc, start, ids in reader.documents():
                    rows.append((doc, first[order[at]] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), order[at]))
                    if len(rows) == 10_000:
                        yield _rows(rows, schema)
                        rows = []
                if rows:
                    yield _rows(rows, schema)

    return spark.range(0, len(order), 1, max(1, len(order))).mapInArrow(run, ddl)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the token files of docs to path (the shared folder if None) and reads every document back from them."""
    path = path or scratch_path(docs.sparkSession, "token-files")
    shards = write_sequences(docs, tokenizer, end_id, path, length, id_col=id_col, text_col=text_col)
    return read_documents(docs.sparkSession, path, shards, docs.schema[id_col].dataType.simpleString())
