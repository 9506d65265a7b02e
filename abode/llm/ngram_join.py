r"""N-gram Jaccard join (operator 8): grouped prefix join on sets of word shingles.

Documents are sets of distinct shingles (``k`` words, A-Z lower-cased), as 64-bit hashes. Two
sets link when ``100 * |a & b| >= percent * |a | b|``.

1. Equal sets collapse into one node, named by the smallest doc_id.
2. All sets use one order of shingles: frequent ones last, else by hash. Linked sets share a
   shingle among the first ``n - ceil(percent * n / 100) + 1`` of their own, and ``COMMON`` (or as
   many as they must share at all) among the first so many and ``COMMON - 1`` more, the prefix. The
   frequent shingles are those that many documents hold, counted over all documents; their
   table has at most ``MAX_FREQUENT`` rows. It steers only the order, so any table is right.
3. Nodes with identical prefix and size collapse into one group, and only groups are joined,
   on prefix shingles that at least two groups hold. A group with too few of those is done.
4. Links are needed only as far as they decide components. So first each group is compared
   with one hub of each of its shingles, nodes with their group's hub; verified links are
   contracted to components. Then all remaining candidates - pairs of groups with a common
   prefix shingles that pass the size and count filters and are not yet in one component -
   are expanded to their members and verified. No pair that could join two components is
   left out, and the pairs inside a component of near copies are never listed.
5. Verification intersects the two sets. Only sets of nodes with a candidate are computed
   again from the text.

A link that hashing decides wrongly needs two different shingles of one pair with one 64-bit
hash. Frequent keys: a passage in many documents leaves the prefixes because its shingles are
ordered last; near copies in bulk meet in hub pairs, one per group and shingle.

Defined results: null and empty texts and texts without words have no shingles, link with
nothing and are their own component; rows with one doc_id share a component; a null doc_id is
one more id, smaller than all others, and a component led by it has a null component_id; a real doc_id
of -2**63 counts as that null id. ``components`` returns doc_id, n_shingles and component_id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm.arrowtext import by_bytes, released, small_batches, utf8
from abode.llm.wordhash import shingle_sets
from abode.operators.dbscan import connected_components
from abode.session import materialize

SHINGLE_WORDS = 5
PERCENT = 80
MAX_FREQUENT = 1 << 18   # rows of the table of frequent shingles: 4 MB
FREQUENT_FROM = 8        # documents that hold a shingle, summed over tasks in which two or more do
BATCH_BYTES = 1 << 20
MERGE_AT = 1 << 20       # distinct shingles a task keeps while it counts
HUB_ROUNDS = 2
COMMON = 4               # prefix shingles that a linking pair shares, unless it must share fewer shingles at all
NULL_ID = -(1 << 63)


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _parts(batch, text):
    """(first row, last row, bytes, offsets) of byte-balanced parts of a batch."""
    data, off = utf8(_column(batch, text))
    for a, b in by_bytes(off, BATCH_BYTES):
        part = off[a:b + 1]
        yield a, b, data[part[0]:part[-1]], part - part[0]


def frequent_shingles(docs: DataFrame, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, documents) of the most frequent shingles of all documents, at most MAX_FREQUENT.

    A task counts a shingle over its own documents and reports it from two documents on.
    """
    def count(batches):
        kept, size = [], 0

        def merged():
            values, at = np.unique(np.concatenate([v for v, _ in kept]), return_inverse=True)
            return values, np.bincount(at, weights=np.concatenate([c for _, c in kept])).astype(np.int64)

        def report():
            values, counts = merged()
            often = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["token", "n"])

        for batch in batches:
            for _, _, data, off in _parts(batch, "text"):
                found = np.unique(shingle_sets(data, off, k)[0], return_counts=True)
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

    counts = docs.select("text").mapInArrow(released(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= FREQUENT_FROM).orderBy(F.col("n").desc(), "token").limit(MAX_FREQUENT).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top["n"].to_numpy(np.int64)[order]


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - (n * percent + 99) // 100 + COMMON)


def signatures(docs: DataFrame, frequent, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, node, pkey, prefix) of each document: its set's size and hash, the prefix and its hash."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches):
        often, documents = shared.value
        for batch in batches:
            ids = _column(batch, "doc_id")
            for a, b, data, off in _parts(batch, "text"):
                tokens, rows = shingle_sets(data, off, k)
                n = np.diff(rows)
                at = np.minimum(np.searchsorted(often, tokens), max(len(often) - 1, 0))
                rank = np.where(often[at] == tokens, documents[at], 0) if len(often) else np.zeros(len(tokens), np.int64)
                nodes, pkeys, prefixes = [], [], []
                for x, y in zip(rows[:-1].tolist(), rows[1:].tolist()):
                    own = tokens[x:y]
                    nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                    p = prefix_length(y - x, percent) if y > x else 0
                    if rank[x:y].any():
                        own = own[np.argsort(rank[x:y], kind="stable")]
                    head = own[:p]
                    pkeys.append(xxhash.xxh3_64_intdigest(head.tobytes(), seed=y - x))
                    prefixes.append(head)
                ends = np.concatenate([[0], np.cumsum([len(h) for h in prefixes])]).astype(np.int32)
                flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n.astype(np.int32)), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                     pa.array(np.array(pkeys, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["doc_id", "n", "node", "pkey", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n int, node long, pkey long, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(id, tokens) of the documents in ``wanted`` (id): sorted shingle hashes as binary."""
    def run(batches):
        for batch in batches:
            ids = _column(batch, "doc_id")
            for a, b, data, off in _parts(batch, "text"):
                tokens, rows = shingle_sets(data, off, k)
                ends = rows * 8
                sets = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(tokens)])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), sets.cast(pa.binary())], names=["id", "tokens"])

    return docs.select("doc_id", "text").join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(released(run), "id long, tokens binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    pairs = materialize(pairs, "shingle-pairs")
    if pairs.count() <= BROADCAST_IDS:  # few pairs go to the sets, not all sets to the pairs
        heads = sets.join(F.broadcast(pairs.select(F.col("b").alias("id")).distinct()), "id", "left_semi")
        pairs = F.broadcast(pairs)
    else:
        heads = sets
    rows = (pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("sa")), "a")
            .join(heads.select(F.col("id").alias("b"), F.col("tokens").alias("sb")), "b"))

    def run(batches):
        for batch in batches:
            left, right = utf8(_column(batch, "sa")), utf8(_column(batch, "sb"))
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                x, y = (d[o[r]:o[r + 1]].view(np.uint64) for d, o in (left, right))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[r] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([_column(batch, c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "sa", "sb").mapInArrow(released(run), "a long, b long")


def _sizes_fit(a: str, b: str, percent: int):
    return (F.greatest(a, b) * percent <= F.least(a, b) * 100)


def components(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text)."""
    with small_batches(docs.sparkSession):  # all stages with Python are written in here
        return _components(docs, k, percent)


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    sig = materialize(signatures(rows, frequent_shingles(rows, k), k, percent), "shingle-signatures")
    nodes = materialize(sig.where("n > 0").groupBy("node", "pkey", "n").agg(F.min("doc_id").alias("id")), "shingle-nodes")
    groups = materialize(sig.where("n > 0").groupBy("pkey", "n", "prefix").agg(F.min("doc_id").alias("g")), "shingle-groups")
    members = nodes.join(groups.select("pkey", "n", "g"), ["pkey", "n"]).select("id", "g", "n")

    postings = groups.select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    held = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = materialize(postings.join(held.select("token"), "token"), "shingle-postings")
    enough = lists.groupBy("g", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= F.least(F.lit(COMMON), F.ceil(F.col("n") * percent / 100)))
    lists = materialize(lists.join(enough.select("g"), "g", "left_semi"), "shingle-lists")
    members = materialize(members, "shingle-members")
    inner = members.where("id <> g").select(F.col("id").alias("a"), F.col("g").alias("b"))

    # sets of every node that is in a list or shares its group
    wanted = lists.select("g").unionByName(inner.select(F.col("b").alias("g"))).distinct()
    wanted = materialize(members.join(wanted, "g", "left_semi").select("id").distinct(), "shingle-wanted")
    n_wanted = wanted.count()
    sets = materialize(sets_of(rows, F.broadcast(wanted) if n_wanted <= BROADCAST_IDS else wanted, k), "shingle-sets")

    links = [materialize(verified(inner, sets, percent), "shingle-links")]
    linked, live = None, lists
    for turn in range(HUB_ROUNDS):
        order = F.col("g") if turn == 0 else F.xxhash64("g", F.lit(turn))
        hubs = live.groupBy("token").agg(F.min(F.struct(order.alias("o"), "g", "n")).alias("hub"))
        hubs = hubs.select("token", F.col("hub.g").alias("hg"), F.col("hub.n").alias("hn"))
        pairs = live.join(hubs, "token").where((F.col("g") != F.col("hg")) & _sizes_fit("n", "hn", percent))
        pairs = pairs.groupBy(F.greatest("g", "hg").alias("a"), F.least("g", "hg").alias("b")).agg(
            F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).where(F.col("c") >= F.least(F.lit(COMMON), F.col("n"))).select("a", "b")
        if linked is not None:
            pairs = pairs.join(linked.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left") \
                .join(linked.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left") \
                .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        links.append(materialize(verified(pairs, sets, percent), "shingle-links"))
        linked = materialize(connected_components(_union(links), "a", "b"), "shingle-components")
        live, groups_now, nodes_now = _live(lists, members, linked)
    rest = _candidates(live, groups_now, nodes_now, percent)
    links.append(materialize(verified(rest, sets, percent), "shingle-links"))
    linked = connected_components(_union(links), "a", "b")

    named = nodes.select("node", "id", "n").join(linked, "id", "left").select("node", "n", F.coalesce("component", "id").alias("component"))
    of_doc = sig.where("n > 0").select("doc_id", "node", "n").join(named, ["node", "n"]).groupBy("doc_id").agg(F.min("component").alias("component"))
    of_doc = sig.select("doc_id", "n").join(of_doc, "doc_id", "left")
    return of_doc.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                         F.when(~F.coalesce("component", "doc_id").eqNullSafe(F.lit(NULL_ID)), F.coalesce("component", "doc_id")).alias("component_id"))


BROADCAST_IDS = 1 << 21  # ids of documents with candidates that are broadcast to the second scan; more are joined


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _live(lists: DataFrame, members: DataFrame, linked: DataFrame):
    """Lists that still hold two components; each group's range of components; each node's component."""
    nodes = members.join(linked, "id", "left").select("id", "g", "n", F.coalesce("component", "id").alias("c"))
    nodes = materialize(nodes, "shingle-nodes-now")
    groups = nodes.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    rows = materialize(lists.join(groups, "g"), "shingle-lists-now")
    open_lists = rows.groupBy("token").agg(F.min("c0").alias("x"), F.max("c1").alias("y")).where("x < y").select("token")
    return rows.join(open_lists, "token", "left_semi"), groups, nodes


def _candidates(live: DataFrame, groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Node pairs (a, b) of different components from group pairs that pass all filters, and from inside groups.

    A linking pair has ``needed`` shingles in common. ``needed - k`` of them follow the k-th, so that one stands
    at most at place ``n - needed + k`` in either set; the first ``COMMON`` (all, if fewer) are counted.
    """
    x = live.select("token", *[F.col(c).alias(f"{c}_x") for c in ("g", "n", "pos", "c0", "c1")])
    y = live.select("token", *[F.col(c).alias(f"{c}_y") for c in ("g", "n", "pos", "c0", "c1")])
    needed = F.ceil((F.col("n_x") + F.col("n_y")) * F.lit(percent) / F.lit(100 + percent))
    one = (F.col("c0_x") == F.col("c1_x")) & (F.col("c0_y") == F.col("c1_y")) & (F.col("c0_x") == F.col("c0_y"))
    pairs = x.join(y, (x["token"] == y["token"]) & (F.col("g_x") < F.col("g_y")) & _sizes_fit("n_x", "n_y", percent)
                   & (F.col("pos_x") < F.col("n_x") - needed + COMMON) & (F.col("pos_y") < F.col("n_y") - needed + COMMON) & ~one)
    pairs = pairs.groupBy("g_x", "g_y", "n_x", "n_y").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= F.least(F.lit(COMMON), needed)).select("g_x", "g_y")
    pairs = pairs.unionByName(groups.where("c0 < c1").select(F.col("g").alias("g_x"), F.col("g").alias("g_y")))
    a = nodes.select(F.col("id").alias("a"), F.col("g").alias("g_x"), F.col("c").alias("ca"))
    b = nodes.select(F.col("id").alias("b"), F.col("g").alias("g_y"), F.col("c").alias("cb"))
    return pairs.join(a, "g_x").join(b, "g_y").where("ca <> cb and (g_x <> g_y or a < b)").select("a", "b").distinct()


def one_of_each_group(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group of linked documents, that of the smallest doc_id; columns as they came.

    Rows whose doc_id is null or repeated are told apart by a hash of doc_id and text; of equal rows one stays.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_nj_odd"), F.lit(True).alias("_nj_is"))
    odd = materialize(odd, "shingle-odd-ids")
    n_odd = odd.count()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_nj_row"), F.col("doc_id").cast("long").alias("_nj_key"), "text")
    if n_odd:
        ids = F.broadcast(odd) if n_odd <= BROADCAST_IDS else odd
        row = row.join(ids, row["_nj_row.doc_id"].eqNullSafe(ids["_nj_odd"]), "left")
        row = row.withColumn("_nj_key", F.when(F.col("_nj_is"), F.xxhash64("_nj_key", "text")).otherwise(F.col("_nj_key"))).drop("_nj_odd")
    groups = components(row.select(F.col("_nj_key").alias("doc_id"), "text"), k, percent)
    leaders = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_nj_key")).distinct()
    stay = row.join(leaders, "_nj_key", "left_semi")
    if n_odd:  # of equal rows one stays: added up before the shuffle, whatever their number
        once = stay.where("_nj_is").groupBy("_nj_key").agg(F.min_by("_nj_row", F.xxhash64("_nj_row")).alias("_nj_row"))
        stay = stay.where(F.col("_nj_is").isNull()).select("_nj_row").unionByName(once.select("_nj_row"))
    return stay.select("_nj_row.*")


def oracle(k: int = SHINGLE_WORDS, percent: int = PERCENT) -> str:
    """DuckDB SQL of the query: all pairs with a common shingle, then the documents each one reaches."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {k} THEN list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d),
g AS (SELECT d, min(m) AS component_id FROM r GROUP BY d)
SELECT q.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, g.component_id
FROM documents q LEFT JOIN n ON n.doc_id = q.doc_id JOIN g ON g.d = q.doc_id"""
