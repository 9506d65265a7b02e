r"""Document fingerprints (operator 6): I-Match over randomised lexicon subsets.

``term_counts`` counts over all documents in how many each word occurs. The lexicon is the words
whose inverse document frequency ``ln(documents / count)`` lies in ``IDF_BAND``; its least
count bounds its size by ``exp(IDF_BAND[1]) * distinct words per document``, whatever the
corpus size, and it is sent to the tasks as sorted 64-bit word hashes (``MAX_LEXICON``: an
error above). ``SUBSETS`` random subsets of the lexicon hold, in turn, one word in each of the numbers
``ONE_IN``, by hash, so that for short and long documents alike some hold about one of their words: those
survive an edit elsewhere. Besides, every word belongs to one of the largest subsets by another hash, so the subsets cover
the lexicon. A document's fingerprint lists, for each subset, the hash of the document's sorted
distinct words in it, or ``-`` if it has none. The likeness of two fingerprints is the share of equal
entries among the subsets in which either has words.

``compare_with_next`` pairs each document with the next in descending doc_id: the documents are
range-partitioned and sorted by (doc_id, the first ``PREFIX`` characters, a hash of the text), and a
task streams its sorted rows, keeping only the row before and parts of ``BATCH_BYTES`` of text (a longer
text is alone). Equal rows are dealt out by their place in the input, so no doc_id gathers in one
task. Only each partition's first and last document meet their neighbour partition's in a join.
Texts travel as one compressed frame each.

Defined results: null text is empty; a text without words of the lexicon has ``=`` and the hash of its
bytes as fingerprint, so it is like equal texts only; rows of equal doc_id are ordered by their first
``PREFIX`` characters, then by xxhash64 of the text;
a null doc_id comes last; a single row is its own next; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm.arrowtext import by_bytes, utf8
from abode.llm.wordhash import distinct, mix64, words
from abode.session import scratch_path

IDF_BAND = (1.0, 7.0)
ONE_IN = (8, 16, 32, 64, 128, 256, 512, 1024)  # subset j holds one word in ONE_IN[j % 8]
SUBSETS = 12 * len(ONE_IN)
DIGITS = 4  # hex digits of an entry
MAX_LEXICON = 1 << 23
BLOCK_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
PREFIX = 64
MERGE_AT = 1 << 22
NULL_ID = -(1 << 63)


def _terms(data, off):
    return distinct(*words(data, off))


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): documents that hold each word, counted over all documents; pre-summed per task."""
    def run(batches):
        kept, size = [], 0

        def merged():
            values, at = np.unique(np.concatenate([v for v, _ in kept]), return_inverse=True)
            return values, np.bincount(at, weights=np.concatenate([c for _, c in kept])).astype(np.int64)

        def report():
            values, counts = merged()
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["term", "df"])

        for batch in batches:
            data, off = utf8(batch.column(0))
            for a, b in by_bytes(off, BATCH_BYTES):
                part = off[a:b + 1]
                found = np.unique(_terms(data[part[0]:part[-1]], part - part[0])[0], return_counts=True)
                kept.append(found)
                size += len(found[0])
            if size > MERGE_AT:
                kept[:] = [merged()]
                size = len(kept[0][0])
                if size > MERGE_AT // 2:
                    yield report()
                    kept, size = [], 0
        if kept:
            yield report()

    return docs.select(text).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, n_docs: int, band=IDF_BAND) -> np.ndarray:
    """Sorted hashes of the words whose inverse document frequency lies in the band."""
    least, most = n_docs * math.exp(-band[1]), n_docs * math.exp(-band[0])
    rows = term_counts(docs).where(F.col("df").between(least, most)).select("term").limit(MAX_LEXICON + 1).toPandas()
    if len(rows) > MAX_LEXICON:
        raise ValueError("the band holds too many words; lower its upper end")
    return np.sort(rows["term"].to_numpy(np.int64).view(np.uint64))


def fingerprints(data: np.ndarray, off: np.ndarray, lex: np.ndarray, subsets: int = SUBSETS, one_in: tuple = ONE_IN) -> list[str]:
    """Fingerprint of each row's text."""
    terms, rows = _terms(data, off)
    if len(lex):
        held = lex[np.minimum(np.searchsorted(lex, terms), len(lex) - 1)] == terms
    else:
        held = np.zeros(len(terms), bool)
    rows = np.concatenate([[0], np.cumsum(held)])[rows]
    terms = terms[held]
    parts = []
    largest = subsets // len(one_in)
    home = (mix64(terms ^ mix64(np.array([subsets + 1], np.uint64))) % np.uint64(largest)) * np.uint64(len(one_in))
    for j in range(subsets):
        keep = (mix64(terms ^ mix64(np.array([j + 1], np.uint64))) % np.uint64(one_in[j % len(one_in)]) == 0) | (home == j)
        cut = np.concatenate([[0], np.cumsum(keep)])[rows].tolist()
        kept = terms[keep].tobytes()
        parts.append([xxhash.xxh32_hexdigest(kept[8 * a:8 * b])[:DIGITS] if b > a else "-" for a, b in zip(cut[:-1], cut[1:])])
    out = []
    for r, entries in enumerate(zip(*parts)):
        if any(e != "-" for e in entries):
            out.append(".".join(entries))
        else:
            out.append("=" + xxhash.xxh3_128_hexdigest(data[off[r]:off[r + 1]].tobytes()))
    return out


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if a.startswith("=") or b.startswith("="):
        return 0.0
    pairs = [(x, y) for x, y in zip(a.split("."), b.split(".")) if x != "-" or y != "-"]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def _of_texts(texts: list[str], lex: np.ndarray) -> list[str]:
    out: list[str] = []
    data, off = utf8(pa.array(texts, pa.large_string()))
    for a, b in by_bytes(off, BATCH_BYTES):
        part = off[a:b + 1]
        out += fingerprints(data[part[0]:part[-1]], part - part[0], lex)
    return out


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]


def _edited(rows: list[tuple[int, str, str, str, str]], lex: np.ndarray) -> pd.DataFrame:
    """(doc_id, text, fingerprint, next text, next fingerprint) -> result rows."""
    texts = [text[:len(text) - len(text) // 2] + after[:len(text) // 2] for _, text, _, after, _ in rows]
    prints = _of_texts(texts, lex)
    out = [(None if i == NULL_ID else i, len(text), hashlib.sha256(t.encode()).hexdigest(), own, p, likeness(own, p), likeness(own, nxt))
           for (i, text, own, _, nxt), t, p in zip(rows, texts, prints)]
    return pd.DataFrame(out, columns=OUT_NAMES).astype({"doc_id": "Int64"})


PACKED = "id long, head string, hash long, place long, blob binary"


def _pack(batches):
    """Rows with their text as one compressed frame each, so that the exchange carries less."""
    import zstandard
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blobs = pa.array([packer.compress(t.encode()) for t in batch.column(4).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], blobs], names=[c.split()[0] for c in PACKED.split(", ")])


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    """(id, text) -> (id, blob), range-partitioned and sorted; ``place`` only deals out equal rows."""
    keyed = rows.select("id", F.substring("text", 1, PREFIX), F.xxhash64("text"), F.monotonically_increasing_id(), "text")
    keys = [F.col("id").desc(), F.col("head").asc(), F.col("hash").asc()]
    return keyed.mapInArrow(_pack, PACKED).repartitionByRange(parts, *keys, "place").sortWithinPartitions(*keys).select("id", "blob")


def compare_with_next(docs: DataFrame, band=IDF_BAND, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Fingerprints of every text, of its edited text, and likeness to the edited text and the next document."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n_docs, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    lex = spark.sparkContext.broadcast(lexicon(rows, n_docs, band))

    def batch_of(out: pd.DataFrame) -> list[pa.RecordBatch]:
        out = out.reindex(columns=names).astype({"doc_id": "Int64", "block": "Int64"})
        return pa.Table.from_pandas(out, schema=schema, preserve_index=False).to_batches()

    def of_part(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        first = before = None
        for batch in batches:
            ids, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            off = np.cumsum([0, *(zstandard.frame_content_size(x) for x in blobs)])
            for a, b in by_bytes(off, BATCH_BYTES):
                texts = [unpack.decompress(x).decode() for x in blobs[a:b]]
                own = list(zip(ids[a:b], texts, _of_texts(texts, lex.value)))
                first = first or own[0]
                chain = [before, *own] if before else own
                before = own[-1]
                if len(chain) > 1:
                    yield from batch_of(_edited([(*x, *y[1:]) for x, y in zip(chain, chain[1:])], lex.value))
        if first:
            ends = pd.DataFrame([("head", *first), ("tail", *before)], columns=["end", "doc_id", "text", "fingerprint"])
            yield from batch_of(ends.assign(block=TaskContext.get().partitionId()))

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    spec = OUT + ", end string, text string, block long"
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in spec.split(", ")])
    names = schema.names
    path = scratch_path(spark, "imatch-parts")
    in_order(rows, max(1, -(-n_bytes // block_bytes))).mapInArrow(of_part, spec).write.option("compression", "zstd").parquet(path)
    parts = spark.read.schema(spec).parquet(path)

    # a partition's last document is followed by the first of the next one that has rows, the last by the very first
    held = sorted(r.block for r in parts.where("end = 'head'").select("block").collect())  # one number a partition
    after = spark.createDataFrame(list(zip(held, held[1:] + held[:1])), "block long, below long")
    tails = parts.where("end = 'tail'").select("doc_id", "text", "fingerprint", "block").join(F.broadcast(after), "block")
    heads = parts.where("end = 'head'").select(F.col("block").alias("below"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))

    def of_ends(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = _edited([(row["doc_id"], row["text"], row["fingerprint"], row["next_text"], row["next_fingerprint"])], lex.value)
                yield from pa.Table.from_pandas(out, schema=pa.schema(list(schema)[:len(OUT_NAMES)]), preserve_index=False).to_batches()

    ends = tails.join(heads, "below").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(of_ends, OUT)
    return parts.where("end IS NULL").select(*OUT_NAMES).unionByName(ends)
