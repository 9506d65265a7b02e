"""Vector code compression (operator 13): product codes whose nearest entries come from bitmasks.

A vector's components become the integers ``floor(256 * x)`` and are cut into ``PARTS`` equal
parts; each part position has a codebook of up to 64 entries, so a set of entries is one
uint64. Nearest entries are found by slices and intersections (``PartIndex``): per dimension
the entries' coordinates are sorted, and entry j of a prefix table holds the mask of the first
j sorted entries; a radius gives one range of coordinates per dimension, two prefix masks give
its entries, and the masks of all dimensions are ANDed. What is left holds every entry within the
radius, so its nearest is the nearest of all once it lies within the radius itself; otherwise
that row asks again with the distance found, or with twice the radius where nothing was left.
All arithmetic is in integers, ties go to the lower index.

Codebooks start as the parts of the 64 kept vectors with the smallest ids, and each round
replaces an entry by the floor of the mean of its parts. Tasks add up counts and sums of at
most 16 x 64 entries before the shuffle; the codebooks, 64 vectors, are all the driver holds.
Sums per label are added up the same way and come back by a lookup of a checked size.

Defined results: rows whose vector is null, empty, holds null or non-finite components, is not
cut evenly by ``PARTS``, or has another length than the kept one with the smallest id are
dropped; integers beyond 2**26 are held at that bound, so that sums stay exact; null ids stand
last and equal ids go by their vectors when codebooks start; repeated rows are coded each; null
labels are one label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm.joins import BROADCAST_ROWS, attach
from abode.session import materialize

SCALE = 256
PARTS = 16
ENTRIES = 64        # entries of a codebook: the bits of a mask
ROUNDS = 2
BOUND = 1 << 26     # largest integer component
BATCH = 4096        # vectors that a task codes at once


class PartIndex:
    """Nearest entries of one part position's codebook (k x d integers, k <= 64)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, d = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [np.ascontiguousarray(entries[order[:, j], j]) for j in range(d)]
        bits = np.uint64(1) << np.arange(k, dtype=np.uint64)
        self.prefixes = [np.concatenate([[np.uint64(0)], np.bitwise_or.accumulate(bits[order[:, j]])]) for j in range(d)]
        gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        nearest = [np.min(g[g > 0], initial=np.iinfo(np.int64).max) for g in gaps]
        self.radius = max(1, int(np.sqrt(float(np.median(nearest)))) if (gaps > 0).any() else 1)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask per row of the entries whose every coordinate is within the row's radius."""
        mask = np.full(len(x), ~np.uint64(0))
        for j, (values, prefix) in enumerate(zip(self.sorted, self.prefixes)):
            low = np.searchsorted(values, x[:, j] - radius, side="left")
            high = np.searchsorted(values, x[:, j] + radius, side="right")
            mask &= prefix[high] ^ prefix[low]
        return mask

    def best_of(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row's mask, by its set bits from the lowest."""
        index, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        rows, left = np.arange(len(x)), mask.copy()
        while len(rows):
            low = left & (~left + np.uint64(1))
            entry = np.log2(low.astype(np.float64)).astype(np.int64)
            distance = ((x[rows] - self.entries[entry]) ** 2).sum(1)
            nearer = distance < best[rows]
            index[rows[nearer]], best[rows[nearer]] = entry[nearer], distance[nearer]
            left ^= low
            more = left != 0
            rows, left = rows[more], left[more]
        return index, best

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest of all entries for each row of ``x``."""
        index, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        rows, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(rows):
            part = x[rows]
            mask = self.candidates(part, radius)
            some = np.flatnonzero(mask)
            index[rows[some]], best[rows[some]] = self.best_of(part[some], mask[some])
            reach = np.ceil(np.sqrt(best[rows].astype(np.float64))).astype(np.int64)
            reach += reach * reach < best[rows]
            empty = mask == 0
            again = empty | (best[rows] > radius * radius)
            radius = np.where(empty, 2 * radius, reach)[again]
            rows = rows[again]
        return index, best


def finite_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector is whole and can be cut."""
    rows = df.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    whole = F.coalesce(F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    return rows.where(whole & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0))


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values * SCALE), -BOUND, BOUND).astype(np.int64)


def _matrix(batch, width: int) -> np.ndarray:
    """Rows x width integers of a batch's vectors."""
    return integers(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


def _blocks(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            yield batch.slice(a, BATCH)


def first_codebooks(vectors: DataFrame) -> np.ndarray | None:
    """parts x entries x width: the parts of the vectors with the smallest ids; None without vectors."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector")
    top = first.limit(1).collect()
    if not top:
        return None
    width = len(top[0].vector)
    rows = first.where(F.size("vector") == width).limit(ENTRIES).collect()
    return integers(np.array([r.vector for r in rows])).reshape(len(rows), PARTS, width // PARTS).transpose(1, 0, 2).copy()


def assign(x: np.ndarray, indexes: list[PartIndex]) -> tuple[np.ndarray, np.ndarray]:
    """(codes rows x parts, error per row) of integer vectors."""
    codes, error = np.zeros((len(x), len(indexes)), np.int64), np.zeros(len(x), np.int64)
    d = x.shape[1] // len(indexes)
    for p, index in enumerate(indexes):
        codes[:, p], distance = index.nearest(x[:, p * d:(p + 1) * d])
        error += distance
    return codes, error


def next_codebooks(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: the floors of the means of the parts assigned to each entry; unused entries stay."""
    parts, k, d = books.shape

    def run(batches):
        indexes, count, total = [PartIndex(b) for b in books], np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        for batch in _blocks(batches):
            x = _matrix(batch, parts * d)
            codes, _ = assign(x, indexes)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=k)
                for j in range(d):  # sums of a block are below 2**53: exact
                    total[p, :, j] += np.bincount(codes[:, p], x[:, p * d + j], k).astype(np.int64)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "n": pa.array(count[part, entry]),
            "sums": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

    sums = vectors.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    sums = sums.select("part", "entry", "n", F.posexplode("sums").alias("j", "total"))
    sums = sums.groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = books.copy()
    for r in sums.collect():  # at most parts x entries x width / parts rows
        out[r.part, r.entry, r.j] = r.total // r.n
    return out


def codebooks_digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(("" if books is None else ",".join(map(str, books.ravel().tolist()))).encode()).hexdigest()


def encode(df: DataFrame, rounds: int = ROUNDS, bound: int = BROADCAST_ROWS) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code binary of one byte a part, error, label_error) of the kept rows, and the final codebooks."""
    vectors = finite_vectors(df)
    books = first_codebooks(vectors)
    if books is None:
        return vectors.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"),
                              F.lit(0).cast("long").alias("label_error")), None
    parts, _, d = books.shape
    vectors = vectors.where(F.size("vector") == parts * d)
    for _ in range(rounds):
        books = next_codebooks(vectors, books)

    def run(batches):
        indexes = [PartIndex(b) for b in books]
        for batch in _blocks(batches):
            codes, error = assign(_matrix(batch, parts * d), indexes)
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(codes), [None, pa.py_buffer(codes.astype(np.uint8).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code.cast(pa.binary()), pa.array(error)],
                                             names=["vec_id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    coded = materialize(vectors.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code binary, error long"), "vector-codes")
    labels = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "vector-label-errors")
    return attach(coded, labels, "label", F.col("code"), bound), books


def decode(code: bytes, books: np.ndarray) -> np.ndarray:
    """Integer vector that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(code)])


def oracle() -> str:
    """DuckDB SQL of the query: every distance, and ties to the lower index."""
    def nearest(book):
        return (f"SELECT v.id, v.p, arg_min(c.e, d * {ENTRIES} + c.e) AS e, min(d) AS d FROM (SELECT x.id, x.p, c.e, list_sum(list_transform("
                f"list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts x JOIN {book} c USING (p)) c JOIN parts v USING (id, p) GROUP BY ALL")

    def updated(book, near):
        return (f"SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM {book} c LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS v FROM ("
                f"SELECT a.p, a.e, j, CAST(floor((sum(x.v[j]) - (((sum(x.v[j]) % count(*)) + count(*)) % count(*))) / count(*)) AS BIGINT) AS m "
                f"FROM {near} a JOIN parts x USING (id, p), generate_series(1, len(x.v)) AS g(j) GROUP BY ALL) GROUP BY ALL) n USING (p, e)")

    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS v FROM kept, generate_series(0, {PARTS - 1}) AS g(p)),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, v FROM parts WHERE id <= {ENTRIES}),
a1 AS MATERIALIZED ({nearest('b0')}), b1 AS MATERIALIZED ({updated('b0', 'a1')}),
a2 AS MATERIALIZED ({nearest('b1')}), b2 AS MATERIALIZED ({updated('b1', 'a2')}),
a3 AS MATERIALIZED ({nearest('b2')}),
coded AS (SELECT id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (id), digest"""
