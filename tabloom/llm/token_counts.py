"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as a doubly linked list of byte symbols; a heap holds its adjacent pairs by
merge rank. Popping the lowest rank joins one pair and offers the two new neighbours; the count
is the initial symbols less the merges, and no ids are made.

Defined results: a null text counts as empty (0 bytes, 0 tokens); equal texts get equal counts;
an empty table gives an empty table; null ids stay null; columns beside id and text are not read.
A special string inside a text is one token, as the library does by default.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import as_schema, rows_of
from tabloom.llm.encoding import SLICE, Cutter, Kept, byte_characters, strings

#: Fixed value: the byte-level pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class MergeCounter:
    """Counts the tokens of texts for a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.first = [vocab[c] for c in byte_characters()]
        pairs = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        #: (left id, right id) -> (rank, joined id)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(PATTERN)
        self.cutter = Cutter(False, special)
        #: Tokens of pieces and of pre-tokens.
        self.kept: Kept[int] = Kept()
        self.kept_words: Kept[int] = Kept()

    def merged(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        symbols = [self.first[b] for b in word]
        count, merges = len(symbols), self.merges
        heap = []
        for at in range(count - 1):
            if found := merges.get((symbols[at], symbols[at + 1])):
                heap.append((found[0], at, symbols[at], symbols[at + 1], found[1]))
        if not heap:
            return count
        heapq.heapify(heap)
        end = count
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while heap:
            _, at, left, right, joined = heapq.heappop(heap)
            if symbols[at] != left:
                continue
            nxt = after[at]
            if nxt >= end or symbols[nxt] != right:
                continue  # a neighbour has been merged since
            count -= 1
            symbols[at], symbols[nxt] = joined, -1
            after[at] = follow = after[nxt]
            if follow < end:
                before[follow] = at
                if found := merges.get((joined, symbols[follow])):
                    heapq.heappush(heap, (found[0], at, joined, symbols[follow], found[1]))
            if (lead := before[at]) >= 0 and (found := merges.get((symbols[lead], joined))):
                heapq.heappush(heap, (found[0], lead, symbols[lead], joined, found[1]))
        return count

    def _merged(self, words: list[str]) -> list[int]:
        return [self.merged(x.encode("utf-8")) for x in words]

    def pieces(self, texts: list[str]) -> list[int]:
        """Tokens of pieces of text that no pre-token crosses the ends of; a pre-token is merged once."""
        found = [self.words.findall(x) for x in texts]
        distinct = [*{w for words in found for w in words}]
        known = dict(zip(distinct, self.kept_words.all(distinct, self._merged), strict=True))
        return [sum(map(known.__getitem__, words)) for words in found]

    def whole(self, text: str) -> int:
        """Tokens of a text that is not cut: special strings first, as ordinary white space rules end at them."""
        parts = self.special.split(text) if self.special else [text]
        return sum(self.pieces(parts[::2])) + len(parts) // 2

    def counts(self, texts: pa.Array | list[str]) -> np.ndarray:
        """Tokens of each text: those of each distinct piece, once, summed by text."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        pieces, bounds, whole = self.cutter.cut(texts)
        each = np.array(self.kept.all(strings(pieces.dictionary), self.pieces), np.int64)
        out = np.diff(np.concatenate([[0], np.cumsum(each[pieces.indices.to_numpy()])])[bounds])
        for k in whole.tolist():
            out[k] = self.whole(texts[k].as_py())
        return out


@functools.cache
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row; narrow, no shuffle."""
    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    schema = as_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer)
        for batch in rows_of(batches, SLICE):
            n = counts.counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], schema=schema)

    return docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).mapInArrow(run, ddl)
