r"""Token counts (operator 9): batch encoding inside Arrow functions that return lengths only.

``count_tokens`` adds ``n_bytes`` and ``n_tokens`` with ``mapInArrow``. Rows are taken in
batches of at most ``batch_bytes`` of text, so a batch's memory does not depend on how long
single texts are, and every text is split at safe boundaries into short pieces; the library
encodes each distinct piece of a batch once, and a document's count is the sum over its pieces.

A boundary is safe for a byte-level BPE whose pre-tokenizer starts a new token at a single
space between two other non-space characters: no pattern crosses it, and no added token
holds a space. It is the place before such a space. Characters that could be Unicode white
space are never next to a boundary, so the split may be coarser than possible, never wrong.
Other kinds of tokenizer (``.model``) get whole texts.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
each; other columns pass through, ``n_bytes`` and ``n_tokens`` replace columns of that name.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.llm.arrowtext import by_bytes, strings, utf8
from abode.llm.columns import ROW, carried, kept, restored

BATCH_BYTES = 8 << 20
CACHE_PIECES = 1 << 19
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 127]) | (np.arange(256) >= 0x80)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def safe_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted starts of pieces: every text's start and every safe boundary.

    Before and after the space stands visible ASCII or a two-byte letter of U+00C0..U+00FF
    (lead byte 0xC3), of which none is white space.
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[off[:-1]] = True
    if len(data) >= 3:
        plain = ~SPACES[data]
        before, after = plain[:-2].copy(), plain[2:] | (data[2:] == 0xC3)
        before[1:] |= (data[1:-2] >= 0x80) & (data[:-3] == 0xC3)
        cut[1:-2] |= (data[1:-1] == 0x20) & before & after
    return np.flatnonzero(cut[:-1])


class _Counter:
    """Lengths of distinct pieces, with a bounded cache per worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, int] = {}

    def lengths(self, pieces: list[str]) -> np.ndarray:
        known = self.cache
        new = [p for p in pieces if p not in known]
        found = dict(zip(new, (len(e) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        out = np.fromiter((known[p] if p in known else found[p] for p in pieces), np.int64, len(pieces))
        if len(known) + len(found) > CACHE_PIECES:
            known.clear()
        known.update((p, n) for p, n in found.items() if len(p) <= 64) if len(found) <= CACHE_PIECES else None
        return out


def _bpe_lengths(counter: _Counter, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    starts = safe_starts(data, off)
    if not len(starts):
        return np.zeros(len(off) - 1, np.int64)
    coded = strings(data, starts).dictionary_encode()
    pieces = coded.dictionary.cast(pa.large_string()).to_pylist()
    total = np.concatenate([[0], np.cumsum(counter.lengths(pieces)[coded.indices.to_numpy()])])
    cut = np.searchsorted(starts, off)
    return total[cut[1:]] - total[cut[:-1]]


def _piece_lengths(model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    texts = [bytes(data[a:b]).decode() for a, b in zip(off[:-1], off[1:])]
    return np.array([len(x) for x in model.encode(texts, num_threads=1)], np.int64)


def count_tokens(df: DataFrame, path: str, text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Add ``n_bytes`` and ``n_tokens`` (long) of ``text`` under the tokenizer file ``path``."""
    columns = kept(df, ("n_bytes", "n_tokens"))
    rows = carried(df, columns, text=F.col(f"`{text}`"))
    schema = T.StructType([rows.schema[ROW], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    model_file = path.endswith(".model")

    def run(batches):
        if model_file:
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            model = _Counter(path)
        count = _piece_lengths if model_file else _bpe_lengths
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, b in by_bytes(off, batch_bytes):
                part = off[a:b + 1]
                n = count(model, data[part[0]:part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(part)), pa.array(n)],
                                                 names=[ROW, "n_bytes", "n_tokens"])

    # the text itself need not come back when the caller drops it: select before the call
    return restored(rows.mapInArrow(run, schema), columns, F.col("n_bytes"), F.col("n_tokens"))
