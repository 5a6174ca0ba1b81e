"""Quality classifier by co-training of two views.

One classifier sees the content of a text (frequencies of pairs of character classes, hashed words, repetition of words and
lines), the other its page metadata and nothing of the text (source, language, length). Each starts from labelled
rows. In each of some rounds both score every unlabelled row, and the labels that one is sure of join the other's training
data; then each takes a Newton step on its labelled rows and on what it was given. Both are calibrated on labelled
rows kept apart, and all documents are scored by the sum of their calibrated log-odds (less the prior, which both hold).

The labelled rows of the fit are a bounded sample: at most about `LABELLED`, chosen by a hash of the id, so their features
(not texts) fit on the driver at any size. Everything else covers all rows: features are worked out once and written, the
pool of a round is every unlabelled row, and what a round needs of it are sums (gradients and curvatures by class, of a fixed size),
which are added up in tasks, by partition and then in two levels. The rows handed over weigh together as much as the labelled
rows of their class at most, however many they are.

Where the metadata says nothing of the quality, its view is sure of nothing, hands nothing over, and adds nothing to the score.

Defined results: a null text is empty, null metadata is a value of its own, a table without source, language or n_chars has them
null (the length is then that of the text); with labels of fewer than two classes every row gets the labels' mean
(1.0 without labels); a document with several labels counts as its lowest; equal rows get equal scores; an
empty table gives an empty table; columns are read by name, others are kept or ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import as_schema, give_back, rows_of, written
from tabloom.session import ship

#: Bound of the labelled sample (rows), rounds, and how sure a pseudo-label must be.
LABELLED, ROUNDS, SURE = 8000, 3, 0.995
#: A document is rejected below this score.
THRESHOLD = 0.5
#: Tasks that add up the sums of all partitions before one adds up theirs.
MIDDLE = 32
_GROUPS = 14
_WORDS, _SOURCES, _LANGS = 64, 48, 12


def _classes() -> np.ndarray:
    """A character class for each byte: blank, line end, letters by case, digits, kinds of punctuation, rest."""
    out = np.full(256, 13, np.int64)
    for n, group in enumerate((b" \t", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",;:", b"!?", b"#*$%&", b"|<>", b"'\"()[]-", b"/\\_@=+~^{}`")):
        out[[*group]] = n
    out[128:] = 12
    return out


_CLASS = _classes()


def content_features(text: str) -> np.ndarray:
    """The content view: root frequencies of pairs of character classes, and how much words repeat."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    pairs = np.zeros(_GROUPS * _GROUPS)
    if len(data) > 1:
        for at in range(0, len(data) - 1, 1 << 20):
            c = _CLASS[data[at : at + (1 << 20) + 1]]
            pairs += np.bincount(c[:-1] * _GROUPS + c[1:], minlength=_GROUPS * _GROUPS)
        pairs = np.sqrt(pairs / (len(data) - 1))
    words = text.split()
    n = max(1, len(words))
    upper = sum(map(str.isupper, words)) / n
    same = sum(a == b for a, b in zip(words, words[1:]))  # noqa: B905
    distinct = {*words}
    hashed = np.sqrt(np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % _WORDS for w in distinct], minlength=_WORDS) / max(1, len(distinct)))
    lines = text.split("\n")
    lengths = np.array([len(x) for x in lines])
    layout = [np.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.max()), len(set(lines)) / len(lines), (lengths == 0).mean()]
    return np.concatenate([pairs, hashed, layout, [len(distinct) / n, len(set(zip(words, words[1:]))) / n, same / n, upper, np.log1p(len(text) / n), float(not words)]])  # noqa: B905


def metadata_features(source: str, lang: str, n_chars: int) -> np.ndarray:
    """The metadata view: where a page comes from, its language and how long it is."""
    out = np.zeros(_SOURCES + _LANGS + 2)
    out[zlib.crc32(source.encode()) % _SOURCES] = 1
    out[_SOURCES + zlib.crc32(lang.encode()) % _LANGS] = 1
    out[-2:] = np.log1p(max(0, n_chars)), np.log1p(max(0, n_chars)) ** 2
    return out


class Logistic:
    """L2 logistic regression on standardised features by Newton steps, with a calibration (scale, shift) of its log-odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0):
        self.mean, self.scale, self.l2 = x.mean(0), x.std(0) + 1e-6, l2
        self.w, self.calibration = np.zeros(x.shape[1] + 1), (1.0, 0.0)
        for _ in range(30):
            if self.step(*self.sums(x, y, weight)) < 1e-6:
                break

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the likelihood of some rows at the present weights; those of all rows are their sums."""
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        p = _sigmoid(z @ self.w)
        return z.T @ (weight * (y - p)), (z.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ z

    def step(self, gradient: np.ndarray, curvature: np.ndarray) -> float:
        """One Newton step, damped; its largest change."""
        ridge = np.full(len(self.w), self.l2)
        ridge[-1] = 1e-6
        step = np.linalg.solve(curvature + np.diag(ridge), gradient - ridge * self.w)
        most = np.abs(step).max()
        self.w = self.w + step * min(1.0, 3.0 / max(most, 1e-12))
        return most

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return a * self.raw(x) + b

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows kept apart, its targets smoothed."""
        n1 = y.sum()
        n0 = len(y) - n1
        if n1 and n0:
            target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
            fit = Logistic(self.raw(x)[:, None], target, np.ones(len(y)), 0.01)
            a = fit.w[0] / fit.scale[0]
            # a view whose log-odds don't rise with the labels says nothing
            self.calibration = (a, fit.w[1] - a * fit.mean[0]) if a > 0 else (0.0, float(np.log(n1 / n0)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pool_sums(views: list[Logistic], content: np.ndarray, metadata: np.ndarray, sure: float = SURE) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """What unlabelled rows give to the next round: number, gradient and curvature of the rows handed to each view, by label.

    In this order: to content with label 0 and 1 (those that metadata is sure of), to metadata with label 0 and 1.
    """
    seen, out = (content, metadata), []
    for view in (0, 1):
        p = _sigmoid(views[1 - view].log_odds(seen[1 - view]))
        for label, q in ((0.0, 1 - p), (1.0, p)):
            rows = seen[view][q >= sure]
            out.append((len(rows), *views[view].sums(rows, np.full(len(rows), label), np.ones(len(rows)))))
    return out


class CoTrained:
    """Two calibrated views and the prior, from labelled rows; rounds over unlabelled rows are `step`s."""

    def __init__(self, content: np.ndarray, metadata: np.ndarray, y: np.ndarray):
        """y: labels of the rows of content and metadata, in an order that says nothing of the labels."""
        self.prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 1.0
        self.views: list[Logistic] = []
        #: Pseudo-labels handed over: by round, to content with label 0 and 1, to metadata with label 0 and 1.
        self.handed: list[tuple[int, ...]] = []
        self._apart = np.arange(len(y)) % 4 == 0
        self._seen, self._y = (content, metadata), y
        if len(y) < 8 or len({*y[self._apart]}) < 2 or len({*y[~self._apart]}) < 2:
            return
        self.views = [Logistic(x[~self._apart], y[~self._apart], np.ones((~self._apart).sum())) for x in self._seen]
        self._calibrate()

    def _calibrate(self) -> None:
        for view, x in zip(self.views, self._seen, strict=True):
            view.calibrate(x[self._apart], self._y[self._apart])

    def step(self, sums: list[tuple[int, np.ndarray, np.ndarray]]) -> int:
        """One round: each view moves by its labelled rows and by what it was given; the number of rows handed over."""
        self.handed.append(tuple(n for n, _, _ in sums))
        own = self._y[~self._apart]
        for k, view in enumerate(self.views):
            gradient, curvature = view.sums(self._seen[k][~self._apart], own, np.ones(len(own)))
            for label in (0, 1):
                n, g, c = sums[2 * k + label]
                if n:  # all of a class together weigh as much as the labelled rows of the class at most
                    weight = min(0.5, (own == label).sum() / n)
                    gradient, curvature = gradient + weight * g, curvature + weight * c
            view.step(gradient, curvature)
        self._calibrate()
        return sum(self.handed[-1])

    def fitted(self) -> CoTrained:
        """Without the labelled rows, as tasks need it."""
        self._seen, self._y, self._apart = (), np.zeros(0), np.zeros(0, bool)
        return self

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of both views, and combined."""
        if not self.views:
            flat = np.full(len(content), self.prior)
            return flat, flat, flat
        a, b = self.views[0].log_odds(content), self.views[1].log_odds(metadata)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - np.log(self.prior / (1 - self.prior)))


def _inputs(docs: DataFrame, text_col: str) -> list[Column]:
    own = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    length = F.length(own(text_col)).cast("bigint")
    return [own(text_col).alias("text"), own("source").alias("source"), own("lang").alias("lang"), (F.coalesce(F.col("n_chars").try_cast("bigint"), length) if "n_chars" in docs.columns else length).alias("n_chars")]


def _views(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    texts, *rest = (batch.column(first + k).to_pylist() for k in range(4))
    # as 32-bit numbers, like the written features
    return np.array([content_features(x) for x in texts], "<f4").astype(np.float64), np.array([metadata_features(*x) for x in zip(*rest, strict=True)], "<f4").astype(np.float64)


def features(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table with a row for each of docs: id, y (null if not in `known`), and both views as bytes of 32-bit numbers."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"id {kind}, y double, content binary, metadata binary"
    schema = as_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([row.tobytes() for row in x.astype("<f4")], pa.binary()) for x in _views(batch, 2))], schema=schema)

    # `known` has about LABELLED rows at most
    tagged = docs.select(F.col(f"`{id_col}`").alias("_id"), *_inputs(docs, text_col)).join(F.broadcast(known), "_id", "left")
    return written(tagged.select("_id", "_y", "text", "source", "lang", "n_chars").mapInArrow(run, ddl), "features")


def _matrix(column: pa.Array | list[bytes]) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), -1).astype(np.float64)


def _pooled(table: DataFrame, model: CoTrained) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """pool_sums over all unlabelled rows: a row of sums for each partition, added up by MIDDLE tasks and then by one."""
    views, sizes = model.views, [len(v.w) for v in model.views]
    ddl = "part int, sums binary"
    schema = as_schema(ddl)
    one = lambda part, x: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], schema=schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = 0
        for batch in rows_of(batches):
            parts = pool_sums(views, _matrix(batch.column(0)), _matrix(batch.column(1)))
            total = total + np.concatenate([np.concatenate([[n], g, c.ravel()]) for n, g, c in parts])
        if type(total) is np.ndarray:
            yield one(TaskContext.get().partitionId(), total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = 0, 0
        for batch in batches:  # sorted by part, so that sums come out the same
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, part = total + np.frombuffer(x), k
        if type(total) is np.ndarray:
            yield one(part, total)

    sums = table.where("y is null").select("content", "metadata").mapInArrow(first, ddl)
    for many in (MIDDLE, 1):
        sums = sums.repartitionById(many, F.col("part") % many).sortWithinPartitions("part").mapInArrow(add, ddl)
    found = sums.collect()  # one row of a fixed size
    flat = np.frombuffer(bytes(found[0]["sums"])) if found else np.zeros(sum(2 * (1 + d + d * d) for d in sizes))
    out, at = [], 0
    for d in (sizes[0], sizes[0], sizes[1], sizes[1]):
        out.append((int(flat[at]), flat[at + 1 : at + 1 + d], flat[at + 1 + d : at + 1 + d + d * d].reshape(d, d)))
        at += 1 + d + d * d
    return out


def fit_with_features(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> tuple[CoTrained, DataFrame]:
    """Fits on labels (id, label) of some of docs; only features of the bounded sample, and sums, go to the driver."""
    known = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.min(F.col(f"`{label_col}`").cast("double")).alias("_y"))
    million = 1_000_000
    many = known.count()
    sample = known.where(F.pmod(F.xxhash64(F.col("_id"), F.lit(1)), F.lit(million)) < int(million * min(1.0, labelled / max(1, many))))
    table = features(docs, sample, id_col, text_col)
    found = table.where("y is not null").select(F.xxhash64("id").alias("h"), "y", "content", "metadata").collect()
    found.sort(key=lambda r: (r["h"], r["y"], bytes(r["content"]), bytes(r["metadata"])))
    a, b = (_matrix([bytes(r[k]) for r in found]) if found else np.zeros((0, 0)) for k in ("content", "metadata"))
    model = CoTrained(a, b, (np.array([r["y"] for r in found]) > 0.5).astype(float))
    for _ in range(rounds if model.views else 0):
        if not model.step(_pooled(table, model)):
            break
    return model.fitted(), table


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> CoTrained:
    return fit_with_features(docs, labels, id_col, text_col, **options)[0]


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, p_content, p_metadata, score and kept of every row; narrow."""
    return _scored(docs.select(F.col(f"`{id_col}`"), *_inputs(docs, text_col)), model, lambda batch: _views(batch, 1), threshold)


def _scored(rows: DataFrame, model: CoTrained, views, threshold: float) -> DataFrame:
    """rows begin with the id; views gives those of a batch."""
    name = rows.columns[0]
    ddl = f"`{name}` {rows.schema[name].dataType.simpleString()}, p_content double, p_metadata double, score double, kept boolean"
    schema = as_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = model.scores(*views(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in found), pa.array(found[2] >= threshold)], schema=schema)

    return rows.mapInArrow(run, ddl)


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """Fits, and scores every row from its written features."""
    model, table = fit_with_features(docs, labels, id_col, text_col, **options)
    rows = table.select(F.col("id").alias(id_col), "content", "metadata")
    return _scored(rows, model, lambda batch: (_matrix(batch.column(1)), _matrix(batch.column(2))), threshold)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns; each row is scored where it lies.

    Only what the views look at goes to Python, once, and one boolean for each row comes back: the rows stay in the JVM.
    """
    model = fit(docs, labels, id_col, text_col, **options)
    inputs = _inputs(docs, text_col)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            batch = pa.RecordBatch.from_arrays([*columns], [str(k) for k in range(4)])
            yield pa.array(np.concatenate([np.zeros(0, bool), *(model.scores(*_views(x, 0))[2] >= threshold for x in rows_of([batch]))]))
        give_back()

    ship(docs.sparkSession)
    return docs.where(F.arrow_udf(run, "boolean")(*inputs))
