"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Words and word shapes (letters, digits and marks in outline) are hashed to ``BUCKETS`` rows.  Every
row has a sparse ternary index vector; a word's vector sums the index vectors of its neighbours
over the whole corpus.  These sums are integers, one small matrix per task and one grouped
sum, so they do not depend on the order of tasks and their size does not grow with the
corpus.  A document is the mean of its word vectors; a two-layer numpy network is fitted on a
bounded sample of labelled rows, and its logits are divided by a temperature that was fitted on a
part of the sample the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .shared import tidy

WORD_BUCKETS, SHAPE_BUCKETS, DIMS, NONZERO = 6144, 2048, 32, 4
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
REACH = 2
CACHED_WORDS = 150_000


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of fold 1 never teach.  A null id reads as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def _index():
    """Index vectors: for each bucket the places and signs of its non-zero entries."""
    import numpy as np

    rng = np.random.default_rng(20240101)
    places = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1, 1], size=(BUCKETS, NONZERO))


class _Words(dict):
    """Word to bucket numbers, the word's in the low and the shape's in the high 16 bits; a bounded cache."""

    def __init__(self):
        import re

        self.letters = re.compile(r"[^\W\d_]+")
        self.digits = re.compile(r"\d+")

    def __missing__(self, word: str) -> int:
        if word.isalpha():
            shape = "A" if len(word) > 1 and word.isupper() else "a"
        else:
            shape = self.letters.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word)
            shape = self.digits.sub("9", shape)
        low = crc32(word.lower().encode("utf-8", "replace")) % WORD_BUCKETS
        self[word] = both = low | (WORD_BUCKETS + crc32(shape.encode("utf-8", "replace")) % SHAPE_BUCKETS) << 16
        return both

    def buckets(self, texts: list[str]):
        """(words, shapes, starts): bucket numbers of all texts in a row, and where each text starts."""
        import numpy as np

        if len(self) > CACHED_WORDS:
            self.clear()
        got: list[int] = []
        starts = []
        for text in texts:
            starts.append(len(got))
            got += map(self.__getitem__, text.split())
        both = np.array(got, np.int64)
        return both & 0xFFFF, both >> 16, np.array([*starts, len(got)])


def word_vectors(docs: DataFrame, text_col: str = "text"):
    """The (BUCKETS, DIMS) matrix of word vectors: a grouped sum over all texts, a bounded result."""
    import numpy as np

    fields = [T.StructField("bucket", T.IntegerType()), T.StructField("seen", T.LongType())]
    fields += [T.StructField(f"d{k}", T.LongType()) for k in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        places, signs = _index()
        words = _Words()
        total = np.zeros(BUCKETS * DIMS)
        seen = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, 0):
            w, s, starts = words.buckets([t or "" for t in batch.column(0).to_pylist()])
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            for row in (w, s):
                seen += np.bincount(row, minlength=BUCKETS)
                for step in range(1, REACH + 1):
                    near = doc[step:] == doc[:-step]
                    a, b = row[:-step][near], row[step:][near]
                    for x, y in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            total += np.bincount(x * DIMS + places[y, k], weights=signs[y, k], minlength=BUCKETS * DIMS)
        some = np.flatnonzero(seen)
        sums = np.rint(total).astype(np.int64).reshape(BUCKETS, DIMS)[some]
        words.clear()
        tidy()
        cols = [pa.array(some, pa.int32()), pa.array(seen[some])] + [pa.array(sums[:, k]) for k in range(DIMS)]
        yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    parts = docs.select(text_col).mapInArrow(run, T.StructType(fields))
    rows = parts.groupBy("bucket").agg(*[F.sum(f.name).alias(f.name) for f in fields[1:]]).collect()  # a row a bucket
    out = np.zeros((BUCKETS, DIMS))
    for r in rows:
        out[r[0]] = r[2:]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out = out / np.where(norm > 0, norm, 1)
    places, signs = _index()
    own = np.zeros((BUCKETS, DIMS))
    np.put_along_axis(own, places, signs / NONZERO**0.5, axis=1)
    return (own + out).astype(np.float32)


def pooled(texts: list[str], words: _Words, vectors):
    """Document features: means of word and of shape vectors, their squared lengths, log of the length."""
    import numpy as np

    w, s, starts = words.buckets(texts)
    n = np.diff(starts)
    out = np.zeros((len(texts), 2 * DIMS + 3), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        for k, row in enumerate((w, s)):
            sums = np.add.reduceat(vectors[row], starts[:-1][some], axis=0, dtype=np.float64)
            mean = sums / n[some, None]
            out[some, k * DIMS : (k + 1) * DIMS] = mean
            out[some, 2 * DIMS + k] = (mean**2).sum(axis=1)
    out[:, -1] = np.log1p(n) / 10
    return out


@dataclass
class Model:
    vectors: object
    centre: object
    scale: object
    w1: object
    b1: object
    w2: object
    b2: float
    temperature: float

    def logits(self, features):
        import numpy as np

        x = (features.astype(np.float64) - self.centre) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, features):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -500, 500)))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 20_000, hidden: int = 24, epochs: int = 40,
) -> Model:
    """Word vectors from all of ``docs``; the network from at most ``sample`` labelled rows.

    The sample takes the rows with the smallest hash of their id, fold 1 left out.  Labels other than 0
    and 1 teach nothing; an id that is labelled twice counts once, with its smaller label.
    """
    import numpy as np

    vectors = word_vectors(docs, text_col)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 1))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("double").alias("__y"))
    drawn = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    chosen = own.join(F.broadcast(drawn), "__id")  # at most ``sample`` ids and labels
    width = 2 * DIMS + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in slices(batches, 1):
            x = pooled([t or "" for t in batch.column(1).to_pylist()], words, vectors)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float32()))], ["__id", "__y", "__x"]
            )

    kind = own.schema["__id"].dataType.simpleString()
    shown = chosen.select("__id", "__text", "__y").mapInArrow(run, f"__id {kind}, __y double, __x array<float>")
    order = [F.xxhash64("__id"), F.col("__id"), F.hash("__x")]
    rows = shown.orderBy(*order).limit(sample).collect()
    if not rows:
        return Model(vectors, 0.0, 1.0, np.zeros((width, 1)), 0.0, np.zeros(1), 0.0, 1.0)
    x = np.array([r["__x"] for r in rows], np.float64)
    y = np.array([r["__y"] for r in rows])
    return _train(x, y, vectors, hidden, epochs)


def _train(x, y, vectors, hidden: int, epochs: int) -> Model:
    import numpy as np

    rng = np.random.default_rng(11)
    aside = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - centre) / scale
    zt, yt = z[~aside], y[~aside]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    rate = yt.mean().clip(0.01, 0.99)
    p[3][0] = np.log(rate / (1 - rate))
    step, size = 0, 128
    rounds = max(epochs, -(-1500 // max(1, -(-len(zt) // size))))
    for _ in range(rounds):
        order = rng.permutation(len(zt))
        for at in range(0, len(order), size):
            k = order[at : at + size]
            h = np.tanh(zt[k] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -50, 50))) - yt[k]) / len(k)
            dh = d[:, None] * p[2] * (1 - h * h)
            g = [zt[k].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for a, b, c, e in zip(p, m, v, g):
                b += 0.1 * (e - b)
                c += 0.001 * (e * e - c)
                a -= 0.004 * (b / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if aside.any() and 0 < y[aside].mean() < 1:
        logit = model.logits(x[aside])
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, -np.where(y[aside] == 1, 1, -1) * logit / t).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; empty and null texts are scored like any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in slices(batches, 1):
            x = pooled([t or "" for t in batch.column(1).to_pylist()], words, model.vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])
        words.clear()
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores under ``least``; all columns unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in slices(batches, at):
            x = pooled([t or "" for t in batch.column(at).to_pylist()], words, model.vectors)
            yield batch.filter(pa.array(model.scores(x) >= least))
        words.clear()
        tidy()

    return docs.mapInArrow(run, docs.schema)
