r"""SentencePiece encoding and decoding (operator 5): forward filtering, backward sampling, lossless decoding.

The vocabulary of a ``.model`` file spans a lattice over a text: an edge for every piece that
matches, and byte pieces for characters that are no piece. A segmentation is drawn with
probability proportional to the product of its pieces' weights: filtering sums the weights of
all ways to reach each place, then sampling walks back from the end and draws each edge by its
share. The file's scores are merge ranks; a piece of rank r weighs ``(r + 2) ** -power``.

No piece joins a non-space and a following space, and some characters are in no longer piece;
the lattice falls apart there into short units. Each distinct unit of a batch is filtered once,
and all its occurrences are sampled together. A draw depends only on the seed, the row's key and the
place in its text, so reruns and other partitionings give the same pieces.

Decoding joins the pieces' bytes. Spaces are spelled by the pieces; a ``U+2581`` in a text is
spelled in byte pieces, so decoding gives back every text exactly.

Defined results: null and empty texts have no pieces and decode to the empty text; a null key
counts as one more key; rows with equal key and text get equal pieces; long texts are encoded
whole, in bounded batches; other columns pass through and ``ids`` (``decoded``) replaces a column of that
name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.llm.arrowtext import by_bytes, released, strings, utf8
from abode.llm.columns import ROW, carried, kept, restored
from abode.llm.wordhash import BYTE, mix64, powers

POWER = 1.0
SEED = 11
BATCH_BYTES = 1 << 18
SPACE = 0x20
BYTE_WEIGHT = 1e-3
RESCALE_EVERY = 16
KNOWN_UNITS = 50_000  # filtered units that a worker keeps for later batches
SLOT_BITS = 20
PIECES_AT_ONCE = 1 << 18


class Vocabulary:
    """Pieces with their spelling and weight, and a hash table of all endings of pieces."""

    def __init__(self, path: str, power: float = POWER):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.weight = np.zeros(size)
        self.spelled = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        pieces: dict[bytes, int] = {}
        for i in range(size):
            if model.is_byte(i):
                byte = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[byte], self.spelled[i], self.weight[i] = i, bytes([byte]), BYTE_WEIGHT
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace("▁", " ")
                if piece.strip(" ") and " " in piece.lstrip(" "):
                    raise ValueError("a piece joins a word and a following space")
                rank = min(-model.get_score(i), float(size))
                self.weight[i], self.spelled[i] = (max(rank, 0) + 2) ** -power, piece.encode()
                pieces[self.spelled[i]] = i
        joined = {c for p in pieces if len(p.decode()) > 1 for c in p}
        self.alone = np.array([b < 0x80 and b not in joined for b in range(256)])
        self.longest = max(map(len, pieces))
        self.powers = powers(self.longest)
        values, turn = BYTE.tolist(), self.powers.tolist()
        endings: dict[int, int] = {}
        for piece, i in pieces.items():
            h = 0
            for k, b in enumerate(reversed(piece)):
                h = (h + values[b] * turn[k]) & (2 ** 64 - 1)
                endings.setdefault(h, -1)
            endings[h] = i
        self.keys = np.array(sorted(endings), np.uint64)
        self.ids = np.array([endings[k] for k in self.keys.tolist()], np.int32)
        slot = (self.keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange((1 << SLOT_BITS) + 1)).astype(np.int32)  # keys of a slot are neighbours
        self.deep = int(np.diff(self.first).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each ending's hash in ``keys``, -1 if it is none."""
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        row = self.first[slot]
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(self.first[slot + 1] > row)
        for step in range(self.deep):
            at = np.minimum(row[some] + step, len(self.keys) - 1)
            same = self.keys[at] == h[some]
            out[some[same]] = at[same]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str, power: float = POWER) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(path, power)


def unit_starts(data: np.ndarray, off: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Sorted starts of the units: row starts, spaces after a non-space, and single characters that join no piece."""
    cut = np.zeros(len(data) + 1, bool)
    cut[off[:-1]] = True
    space, single = data == SPACE, alone[data]
    cut[1:-1] |= space[1:] & ~space[:-1]
    cut[:-1] |= single
    cut[1:] |= single
    return np.flatnonzero(cut[:-1])


class Lattice:
    """Lattices of many units (their bytes, one after another, and the units' offsets), filtered.

    Place t of unit u has slot ``off[u] + u + t``. Edges are sorted by the slot of their end, and ``first``
    is a slot's first edge; ``share`` is the running share of an edge among those with the same end.
    """

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, off: np.ndarray):
        unit = np.repeat(np.arange(len(off) - 1), np.diff(off))
        place = np.arange(len(data)) - off[unit]  # of each byte in its unit
        last, length, self.id = self._edges(vocabulary, data, place)
        order = np.argsort(last, kind="stable")
        last, length, self.id = last[order], length[order], self.id[order]
        end = last + unit[last] + 1
        self.start = place[last] + 1 - length
        share = self._filter(vocabulary.weight[self.id], end, end - length, place[last], off, vocabulary.longest)
        self.share = share
        self.slots = off[:-1] + np.arange(len(off) - 1)
        self.n_slots = int(off[-1]) + len(off) - 1
        self.first = np.searchsorted(end, np.arange(self.n_slots))

    @staticmethod
    def _edges(v: Vocabulary, data, place):
        """(last byte, length, id) of every piece that matches, and byte pieces for characters without one."""
        lead = (data & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        size = np.arange(len(data)) - np.flatnonzero(lead)[char] + 1  # bytes of the character up to here
        known = np.zeros(int(char[-1]) + 1, bool)
        at, h, found = np.arange(len(data)), np.zeros(len(data), np.uint64), []
        for n in range(1, v.longest + 1):
            inside = place[at] >= n - 1
            at, h = at[inside], h[inside]
            h = h + BYTE[data[at - (n - 1)]] * v.powers[n - 1]
            row = v.find(h)
            match = row >= 0
            at, h, ids = at[match], h[match], v.ids[row[match]]
            whole = ids >= 0
            found.append((at[whole], np.full(int(whole.sum()), n, np.int64), ids[whole]))
            known[char[at[whole][size[at[whole]] == n]]] = True
            if not len(at):
                break
        other = np.flatnonzero(~known[char])
        found.append((other, np.ones(len(other), np.int64), v.byte_id[data[other]]))
        return tuple(np.concatenate(x) for x in zip(*found))

    @staticmethod
    def _filter(weight, end, begin, place, off, longest) -> np.ndarray:
        """Running share of each edge: forward sums, all units one place at a time."""
        slots = off[:-1] + np.arange(len(off) - 1)
        size = np.diff(off)
        reach = np.zeros(off[-1] + len(size))
        reach[slots] = 1.0
        flow = np.zeros(len(weight))
        order = np.argsort(place.astype(np.uint16) if len(place) and size.max() < 1 << 16 else place, kind="stable")
        steps = np.searchsorted(place[order], np.arange(int(size.max()) + 1))
        by_size = np.argsort(-size, kind="stable")
        for t in range(int(size.max())):
            e = order[steps[t]:steps[t + 1]]
            if len(e):  # none inside characters of all units that are this long
                flow[e] = reach[begin[e]] * weight[e]
                first = np.flatnonzero(np.append(True, end[e][1:] != end[e][:-1]))
                reach[end[e[first]]] = np.add.reduceat(flow[e], first)
            if t % RESCALE_EVERY == RESCALE_EVERY - 1:  # only ratios matter; keep long units in range
                more = by_size[:np.searchsorted(-size[by_size], -(t + 1), side="left")]
                window = slots[more, None] + np.arange(max(t + 2 - longest, 0), t + 2)
                reach[window] /= reach[window].max(axis=1, keepdims=True)
        first = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
        count = np.diff(np.append(first, len(end)))
        share = flow / np.repeat(np.add.reduceat(flow, first), count)
        total = np.cumsum(share)
        share = total - np.repeat(total[first] - share[first], count)
        share[first + count - 1] = 1.0
        return share


class Sampler:
    def __init__(self, path: str, power: float = POWER, seed: int = SEED):
        self.vocabulary = vocabulary(path, power)
        self.seed = np.array([seed], np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.units = pa.array([], pa.large_binary())
        self.slots, self.n_slots = np.zeros(0, np.int64), 0
        self.share, self.start, self.id = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int32)

    def _learn(self, units: pa.Array) -> np.ndarray:
        """First slots of the units' lattices; units that are not known yet are filtered and kept."""
        if len(self.units) > KNOWN_UNITS:
            self._forget()
        new = units.filter(pc.invert(pc.is_in(units, value_set=self.units)))
        if len(new):
            found = Lattice(self.vocabulary, *utf8(new))
            self.units = pa.concat_arrays([self.units, new])
            self.slots = np.concatenate([self.slots, found.slots + self.n_slots])
            self.first = np.concatenate([self.first, (found.first + len(self.id)).astype(np.int32)])
            self.share = np.concatenate([self.share, found.share])
            self.start = np.concatenate([self.start, found.start.astype(np.int32)])
            self.id = np.concatenate([self.id, found.id.astype(np.int32)])
            self.n_slots += found.n_slots
        return self.slots[pc.index_in(units, value_set=self.units).to_numpy()]

    def encode(self, data: np.ndarray, off: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row offsets). ``keys`` are the rows' 64-bit keys."""
        full = off[:-1][off[1:] > off[:-1]]
        n = np.diff(off)
        data = np.insert(data, full, SPACE)  # the model's dummy prefix
        off = np.concatenate([[0], np.cumsum(n + (n > 0))])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        starts = unit_starts(data, off, self.vocabulary.alone)
        coded = strings(data, starts).dictionary_encode()
        base = self._learn(coded.dictionary)[coded.indices.to_numpy()]
        row = np.searchsorted(off, starts, side="right") - 1
        salt = mix64(keys ^ mix64(self.seed))[row]
        begin = (starts - off[row]).astype(np.uint64)
        place, active = np.diff(np.append(starts, len(data))), np.arange(len(starts))
        where, ids = [], []
        while len(active):
            at = place[active]
            draw = mix64(salt[active] + (begin[active] + at.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
            u = (draw >> np.uint64(11)).astype(np.float64) / float(1 << 53)  # below 1, the share of a place's last edge
            edge = self.first[base[active] + at]
            todo = np.arange(len(edge))
            while len(todo):
                todo = todo[self.share[edge[todo]] <= u[todo]]
                edge[todo] += 1
            start = self.start[edge]
            where.append(starts[active] + start)
            ids.append(self.id[edge])
            place[active] = start
            active = active[start > 0]
        where, ids = np.concatenate(where), np.concatenate(ids)
        order = np.argsort(where, kind="stable")
        return ids[order].astype(np.int32), np.searchsorted(where[order], off)


class Speller:
    """Texts that pieces spell."""

    def __init__(self, path: str):
        spelled = vocabulary(path).spelled
        self.size = np.array([len(x) for x in spelled])
        self.begin, self.letters = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(spelled), np.uint8)

    def texts(self, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
        """Text of each row of pieces (row i holds ids[rows[i]:rows[i + 1]]), without the dummy prefix."""
        size = self.size[ids]
        place = np.concatenate([[0], np.cumsum(size)])
        out = self.letters[np.repeat(self.begin[ids] - place[:-1], size) + np.arange(place[-1])]
        some = rows[1:] > rows[:-1]
        out = np.delete(out, place[rows[:-1][some]])
        text_ends = place[rows] - np.concatenate([[0], np.cumsum(some)])
        texts = pa.Array.from_buffers(pa.large_string(), len(rows) - 1, [None, pa.py_buffer(text_ends.astype(np.int64)), pa.py_buffer(out)])
        texts.validate(full=True)
        return texts


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", power: float = POWER, seed: int = SEED) -> DataFrame:
    """Add ``ids``: the sampled pieces of each text."""
    columns = kept(df, ("ids",))
    rows = carried(df, columns, text=F.col(f"`{text}`"), key=F.xxhash64(F.col(f"`{key}`")))

    def run(batches):
        sampler = Sampler(path, power, seed)
        for batch in batches:
            data, off = utf8(batch.column(1))
            keys = batch.column(2).to_numpy().view(np.uint64)
            for a, b in by_bytes(off, BATCH_BYTES):
                part = off[a:b + 1]
                ids, ends = sampler.encode(data[part[0]:part[-1]], part - part[0], keys[a:b])
                found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), found], names=[ROW, "ids"])

    coded = rows.mapInArrow(released(run), T.StructType([rows.schema[ROW], T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return restored(coded, columns, F.col("ids"))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the text that the pieces spell, without the dummy prefix; null ids decode to the empty text."""
    columns = kept(df, ("decoded",))
    rows = carried(df, columns, ids=F.col(f"`{ids}`"))

    def run(batches):
        speller = Speller(path)
        for batch in batches:
            column = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])
            for a, b in by_bytes(ends, PIECES_AT_ONCE):
                texts = speller.texts(column.slice(a, b - a).flatten().to_numpy(), ends[a:b + 1] - ends[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), texts.cast(pa.string())], names=[ROW, "decoded"])

    out = rows.mapInArrow(released(run), T.StructType([rows.schema[ROW], T.StructField("decoded", T.StringType())]))
    return restored(out, columns, F.col("decoded"))


def encode_and_check(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", power: float = POWER, seed: int = SEED) -> DataFrame:
    """``encode``, and ``lossless``: whether the pieces decode to the text. One worker a task; the text itself is dropped."""
    columns = kept(df, ("ids", "lossless", text))
    rows = carried(df, columns, text=F.coalesce(F.col(f"`{text}`"), F.lit("")), key=F.xxhash64(F.col(f"`{key}`")))

    def run(batches):
        sampler, speller = Sampler(path, power, seed), Speller(path)
        for batch in batches:
            data, off = utf8(batch.column(1))
            keys = batch.column(2).to_numpy().view(np.uint64)
            for a, b in by_bytes(off, BATCH_BYTES):
                part = off[a:b + 1]
                ids, ends = sampler.encode(data[part[0]:part[-1]], part - part[0], keys[a:b])
                same = pc.equal(speller.texts(ids, ends), batch.column(1).slice(a, b - a).cast(pa.large_string()))
                found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), found, same], names=[ROW, "ids", "lossless"])

    coded = rows.mapInArrow(released(run), T.StructType([
        rows.schema[ROW], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())]))
    return restored(coded, columns, F.col("ids"), F.col("lossless"))
