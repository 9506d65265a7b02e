r"""Quality classifier (operator 1): random-indexing word vectors, pooled, then a small calibrated network.

1. Words are runs of letters and digits or runs of punctuation, hashed to ``BUCKETS`` rows. Each
   row has a fixed sparse index vector (``SLOTS`` entries of +1 or -1 in ``DIM`` places, by
   hash). A word's context vector is the sum of the index vectors of the words within
   ``WINDOW`` places, over all documents. The counts are whole numbers, so the sum does not
   depend on the order in which tasks finish. A task sends its matrix once, in blocks.
2. A document is the mean of its words' unit context vectors.
3. A two-layer network (tanh, then one logit) is fitted with numpy on at most ``MAX_TRAIN``
   labelled documents, those with the smallest hash of doc_id, and a temperature is fitted on a
   quarter of them that the network did not see. Scores are ``sigmoid(logit / temperature)``.

Only the text is an input of a score. Sizes in driver and tasks are fixed: the matrix has
``BUCKETS * DIM`` numbers (4 MB), the sample ``MAX_TRAIN * DIM``.

Defined results: null and empty texts have the zero vector and get the score that the network
gives it; rows with a null or repeated doc_id are scored each; labels that are null, or whose
document is missing, are not used; of contradictory labels of a document each counts; without two
classes among the labels every score is the share of label 1 (0.5 without labels). Other
columns pass through; ``score`` replaces a column of that name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.llm.arrowtext import by_bytes, utf8
from abode.llm.columns import ROW, carried, kept, restored
from abode.llm.wordhash import mix64, runs

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
DIM = 64
SLOTS = 4
WINDOW = 2
MAX_TRAIN = 20_000
HIDDEN = 32
EPOCHS = 300
SEED = 7
BLOCKS = 64          # the matrix travels in so many blocks of rows
BATCH_BYTES = 2 << 20
POOL_ROWS = 1 << 16
KINDS = np.array([0 if b in (9, 10, 11, 12, 13, 32) else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], np.int8)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of each row's index vector, [BUCKETS, SLOTS]."""
    h = mix64(np.arange(1, BUCKETS * SLOTS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).reshape(BUCKETS, SLOTS)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the words of each text and the texts' offsets into them."""
    hashes, rows = runs(data, off, KINDS)
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), rows


def _texts(batch, text):
    data, off = utf8(batch.column(batch.schema.get_field_index(text)))
    for a, b in by_bytes(off, BATCH_BYTES):
        part = off[a:b + 1]
        yield a, b, data[part[0]:part[-1]], part - part[0]


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vectors [BUCKETS, DIM], summed over all documents."""
    def count(batches):
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIM, np.int64)
        for batch in batches:
            for _, _, data, off in _texts(batch, text):
                word, rows = tokens(data, off)
                row = np.repeat(np.arange(len(off) - 1), np.diff(rows))
                for gap in range(1, WINDOW + 1):
                    near = np.flatnonzero(row[gap:] == row[:-gap])
                    for one, other in ((word[near], word[near + gap]), (word[near + gap], word[near])):
                        for slot in range(SLOTS):
                            total += np.bincount(one * DIM + places[other, slot], weights=signs[other, slot], minlength=BUCKETS * DIM).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS)), pa.array([b.tobytes() for b in total.reshape(BLOCKS, -1)], pa.binary())], names=["block", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(data.as_buffer(), np.int64)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "sums"])

    parts = docs.select(text).mapInArrow(count, "block long, sums binary")
    rows = parts.repartition("block").mapInArrow(add, "block long, sums binary").collect()
    matrix = np.zeros((BLOCKS, BUCKETS * DIM // BLOCKS))
    for row in rows:
        matrix[row["block"]] += np.frombuffer(row["sums"], np.int64)
    matrix = matrix.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return (matrix / np.where(norm > 0, norm, 1)).astype(np.float32)


def pool(data: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text [rows, DIM]; zero for a text without words."""
    word, rows = tokens(data, off)
    n = np.diff(rows)
    out = np.zeros((len(n), DIM), np.float64)
    row = np.repeat(np.arange(len(n)), n)
    for a in range(0, len(word), POOL_ROWS):
        part = row[a:a + POOL_ROWS]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        out[part[first]] += np.add.reduceat(vectors[word[a:a + POOL_ROWS]], first, axis=0)
    return out / np.maximum(n, 1)[:, None]


class Network:
    """Two layers: ``tanh(x W1 + b1) W2 + b2``; fitted with Adam on all rows at once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.temperature = 1.0
        z = self._scaled(x)
        p = [rng.normal(0, 1 / np.sqrt(DIM), (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(z @ p[0] + p[1])
            error = (_sigmoid(h @ p[2] + p[3]) - y) / len(y)
            back = np.outer(error, p[2]) * (1 - h * h)
            grads = [z.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ error + 1e-4 * p[2], error.sum(keepdims=True)]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        self.weights = p

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -20, 20)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(self._scaled(x) @ w[0] + w[1]) @ w[2] + w[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss on rows that were not fitted."""
        logits = self.logits(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
        self.temperature = float(min(grid, key=lambda t: np.logaddexp(0, np.where(y > 0.5, -1, 1) * logits / t).mean()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


class Constant:
    def __init__(self, value: float):
        self.value = value

    def scores(self, x):
        return np.full(len(x), self.value)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def with_column(docs: DataFrame, name: str, kind, values, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with one more column, computed from byte parts of the text by ``values``."""
    columns = kept(docs, (name,))
    rows = carried(docs, columns, _qm_text=F.col(f"`{text}`"))

    def run(batches):
        for batch in batches:
            for a, b, data, off in _texts(batch, "_qm_text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), values(data, off)], names=[ROW, "value"])

    out = rows.mapInArrow(run, T.StructType([rows.schema[ROW], T.StructField("value", kind)]))
    return restored(out, columns, F.col("value").alias(name))


def fit(docs: DataFrame, labels: DataFrame, vectors, max_train: int = MAX_TRAIN):
    """Network fitted on labelled documents: labels is (doc_id, label), already without held-out rows."""
    sample = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("h", F.xxhash64("text"))
    # a doc_id may repeat: equal texts count once, and of all that remain at most max_train are taken
    rows = rows.dropDuplicates(["doc_id", "label", "h"]).orderBy(F.xxhash64("doc_id"), "doc_id", "label", "h").limit(max_train).drop("h")

    def pooled(data, off):
        return pa.array(list(pool(data, off, vectors.value).astype(np.float32)), pa.list_(pa.float32()))

    found = with_column(rows, "x", T.ArrayType(T.FloatType()), pooled).drop("text").toPandas().sort_values(["doc_id", "label"])
    if found["label"].nunique() < 2:
        return Constant(float(found["label"].mean()) if len(found) else 0.5)
    x, y = np.stack(found["x"].to_numpy()).astype(np.float64), found["label"].to_numpy(float)
    aside = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~aside])) < 2:
        return Constant(float(y.mean()))
    net = Network(x[~aside], y[~aside])
    if aside.any():
        net.calibrate(x[aside], y[aside])
    return net


def score(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Add ``score``: the calibrated probability of label 1. ``docs`` needs doc_id and text."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(context_vectors(docs, text))
    model = spark.sparkContext.broadcast(fit(docs, labels, vectors))

    def scored(data, off):
        return pa.array(model.value.scores(pool(data, off, vectors.value)))

    return with_column(docs, "score", T.DoubleType(), scored, text)
