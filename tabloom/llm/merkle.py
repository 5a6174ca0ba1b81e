"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line with its line end, so the paragraphs of a text are the whole text. A section ends
at a blank paragraph, or at a paragraph whose digest says so (content-defined: an edit moves no far
boundary). A section's digest is that of its paragraphs' digests, the root is that of the sections'
digests. The leaves below a paragraph are its runs of a few words, also cut where the words say so.

The fingerprint is the root and, in base64, the tree below it: how many paragraphs each section has, how many runs each
paragraph has, 32 bits of each paragraph's digest, and of each run 24 bits of its checksum and its size in bytes; about a fifth
of the text's size. Two fingerprints alone tell all that is compared: equal roots mean equal texts; different trees
are compared from the top: equal sections are passed over, then equal paragraphs (`changes` gives the rest: where an
edit is), and the runs of what is left are held against each other. The share of bytes found in both (twice the
common bytes over the sum) is the likeness.

Defined results: a null text is the empty text (no paragraph; two such are alike, 1.0); rows with equal ids
follow each other by text, rows with null ids come last in descending order; ids must be whole numbers (TypeError); a table of
one row is its own next document; an empty table gives an empty table; a text of any length is worked on whole; other
columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import as_schema, range_of, rows_of, whole_number_id

#: A paragraph ends its section if its digest's first byte is a multiple of this; a run of words ends behind a
#: word whose checksum is a multiple of RUN, when it has LEAST words at least, or at MOST words.
SECTION, RUN, LEAST, MOST = 8, 3, 2, 8
#: Runs of more bytes (long words, scripts without spaces) are cut into steps.
WIDE, STEP = 128, 16
#: The runs of paragraphs up to this size (bytes) are kept for the next tree, and of how many paragraphs.
SHORT, KEPT = 8192, 4096


def _digest(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _runs(paragraph: bytes) -> list[int]:
    """The runs of a paragraph: checksum (24 bits) and size (8 bits) of each; the sizes add up to the paragraph's."""
    checksum, out, first, at = zlib.crc32, [], 0, 0
    words = paragraph.split(b" ")
    last = len(words) - 1
    start = 0
    for n, word in enumerate(words):
        at += len(word) + (n < last)
        if n == last or n - first >= LEAST - 1 and (n - first == MOST - 1 or not checksum(word) % RUN):
            if at - start <= WIDE:
                out.append((checksum(paragraph[start:at]) & 0xFFFFFF) << 8 | at - start)
            else:
                out += [(checksum(x) & 0xFFFFFF) << 8 | len(x) for k in range(start, at, STEP) for x in (paragraph[k : min(at, k + STEP)],)]
            first, start = n + 1, at
    return out


_short_runs = functools.lru_cache(KEPT)(_runs)


class Tree:
    """The Merkle tree of one text, or of one fingerprint: what a fingerprint holds.

    root: hex; sections: paragraphs of each; paragraphs: runs of each; digests: 32 bits of each paragraph's; runs: checksum and size.
    """

    __slots__ = ("digests", "paragraphs", "root", "runs", "sections", "size")

    def __init__(self, text: str):
        data = text.encode("utf-8")
        lines = _lines(data)
        whole = [_digest(x) for x in lines]
        ends = [at + 1 for at, (d, x) in enumerate(zip(whole, lines, strict=True)) if not d[0] % SECTION or at == len(whole) - 1 or x == b"\n"]
        starts = [0, *ends[:-1]] if ends else []
        self.root = _digest(b"".join(_digest(b"".join(whole[a:b])) for a, b in zip(starts, ends, strict=True)), 32).hex()
        self.sections = np.array([b - a for a, b in zip(starts, ends, strict=True)], np.uint32)
        self.digests = np.frombuffer(b"".join(x[:4] for x in whole), "<u4")
        runs = [_short_runs(x) if len(x) <= SHORT else _runs(x) for x in lines]
        self.paragraphs = np.array([len(x) for x in runs], np.uint32)
        self.runs = np.array([r for x in runs for r in x], np.uint32)
        self.size = len(data)

    @property
    def fingerprint(self) -> str:
        parts = [np.array([len(self.sections), len(self.paragraphs)]), self.sections, self.paragraphs, self.digests, self.runs]
        return f"{self.root}.{base64.b64encode(np.concatenate(parts).astype('<u4').tobytes()).decode()}"

    @classmethod
    def read(cls, fingerprint: str) -> Tree:
        """The tree of a fingerprint."""
        out = cls.__new__(cls)
        out.root, _, rest = fingerprint.partition(".")
        x = np.frombuffer(base64.b64decode(rest), "<u4")
        n, m = int(x[0]), int(x[1])
        out.sections, out.paragraphs, out.digests, out.runs = x[2 : 2 + n], x[2 + n : 2 + n + m], x[2 + n + m : 2 + n + 2 * m], x[2 + n + 2 * m :]
        out.size = int((out.runs & 0xFF).sum())
        return out


def _lines(data: bytes) -> list[bytes]:
    """Lines at \\n alone, each with its end."""
    return [x + b"\n" for x in data.split(b"\n")[:-1]] + ([x] if (x := data.rpartition(b"\n")[2]) else [])


def _unmatched(items: Iterable[tuple[object, int]], other: Counter) -> list[int]:
    """Numbers of the items that `other` (used up as they match) does not hold."""
    out = []
    for digest, at in items:
        if other[digest] > 0:
            other[digest] -= 1
        else:
            out.append(at)
    return out


def _sections(tree: Tree) -> list[tuple[bytes, int, int]]:
    """(digests, first paragraph, paragraph behind) of each section."""
    ends = np.cumsum(tree.sections, dtype=np.int64).tolist()
    return [(tree.digests[a:b].tobytes(), a, b) for a, b in zip([0, *ends[:-1]], ends)] if ends else []  # noqa: B905


def _left(a: Tree, b: Tree) -> list[int]:
    """Paragraphs of a that are in no section and no paragraph of b."""
    own, other = _sections(a), _sections(b)
    mine = _unmatched(((x[0], n) for n, x in enumerate(own)), Counter(x[0] for x in other))
    theirs = _unmatched(((x[0], n) for n, x in enumerate(other)), Counter(x[0] for x in own))
    rest = Counter(int(d) for n in theirs for d in b.digests[other[n][1] : other[n][2]])
    return _unmatched(((int(a.digests[k]), k) for n in mine for k in range(*own[n][1:])), rest)


def changes(a: Tree, b: Tree) -> list[int]:
    """Numbers of the paragraphs of a that b does not have: where an edit is."""
    return [] if a.root == b.root else _left(a, b)


def _runs_of(tree: Tree, paragraphs: list[int]) -> np.ndarray:
    """The runs of some paragraphs."""
    ends = np.cumsum(tree.paragraphs, dtype=np.int64)
    parts = [tree.runs[ends[k] - int(tree.paragraphs[k]) : ends[k]] for k in paragraphs]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def likeness(a: Tree, b: Tree) -> float:
    """From 0 (nothing in common) to 1 (equal roots, and only these)."""
    if a.root == b.root:
        return 1.0
    both = a.size + b.size
    mine, theirs = _runs_of(a, _left(a, b)), _runs_of(b, _left(b, a))
    common = a.size - int((mine & 0xFF).sum())
    x, n = np.unique(mine, return_counts=True)
    y, m = np.unique(theirs, return_counts=True)
    at = np.searchsorted(y, x)
    there = np.flatnonzero(at < len(y))
    there = there[y[at[there]] == x[there]]
    common += int((np.minimum(n[there], m[at[there]]) * (x[there] & 0xFF)).sum())
    return max(0.0, min(2 * common / both, 1 - 1 / both))


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) characters replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ordered_with_next(docs: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    """Rows (id, text, halo) in partitions by id, descending inside, the first row of the next partition at the end (halo).

    One shuffle of the texts; the cuts and the largest id of each range (as many as partitions) go to the driver.
    """
    least = -(1 << 63)
    whole_number_id(docs, id_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("bigint"), F.lit(least)))
    keys = rows.select("key")
    found = keys.agg(F.percentile_approx("key", [k / shards for k in range(1, shards)], 10_000)).first()[0] if shards > 1 else []
    cuts = sorted(set(found or []))

    shard = range_of(cuts, "key")
    most = {r[0]: r[1] for r in keys.groupBy(shard.alias("shard")).agg(F.max("key")).collect()}
    own = sorted(most)
    above = {k: own[(n + 1) % len(own)] for n, k in enumerate(own)}  # of the highest: the lowest
    heads = F.array(*(F.lit(most.get(k, least)) for k in range(len(cuts) + 1)))
    goes = F.array(*(F.lit(above.get(k, 0)) for k in range(len(cuts) + 1)))
    at = F.col("shard") + 1
    to = F.array(F.struct(F.col("shard").alias("to"), F.lit(0).alias("halo")))
    also = F.array(F.struct(F.element_at(goes, at).alias("to"), F.lit(1).alias("halo")))
    dealt = rows.withColumn("shard", shard).withColumn("x", F.explode(F.when(F.col("key") == F.element_at(heads, at), F.concat(to, also)).otherwise(to)))
    return dealt.select("id", "text", "key", "x.to", "x.halo").repartitionById(len(cuts) + 1, F.col("to")).sortWithinPartitions("to", "halo", F.desc("key"), "text").select("id", "text", "halo")


def fingerprints(docs: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: n_chars, fingerprints of its text and its edited text, likeness to that and to the next document's.

    The next document is that of the next lower id, of the lowest the highest.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, sections int, paragraphs int, changed array<int>"
    schema = as_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out: list[tuple] = []
        for batch in rows_of(batches):
            for doc, text, halo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = Tree(text)
                if held:
                    out.append(_row(*held, text, tree))
                held = None if halo else (doc, text, tree)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []

    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _ordered_with_next(docs, id_col, text_col, n).mapInArrow(run, ddl)


def _row(doc, text: str, tree: Tree, following: str, next_tree: Tree) -> tuple:
    changed = edited(text, following)
    other = Tree(changed)
    return (doc, len(text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), tree.fingerprint, other.fingerprint, likeness(tree, other), likeness(tree, next_tree), len(tree.sections), len(tree.paragraphs), changes(tree, other))
