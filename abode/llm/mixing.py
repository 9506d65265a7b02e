"""Mixing sources to target weights (operator 3): systematic sampling with DataFrame functions only.

Every source gets a target size: all sizes together are shared by weight, no source gets
more than ``max_repeat`` times its own size, and what a capped source cannot take is shared
by weight among the others. With targets ``min(max_repeat * size, level * weight)`` that is
one number, the level, found in closed form from sums over the sources.

A document is expected ``rate = target / source_size`` times. Documents of a source stand in
a fixed order; the prefix sum of expected copies, plus one offset per source drawn from the
seed, crosses ``floor(end) - floor(start)`` integers inside a document, and so many copies
are emitted. Each document gets floor(rate) or ceil(rate) copies. The order is by size class
first, so every stretch of sampled documents stands for others of nearly the same size and a
source's taken size stays near its target.

No source is handled by one task: documents are dealt out in cells of (source, size class,
key bucket); ranks are counted inside cells, and the cells' small table of counts holds the
prefix sums (at most ``classes * BUCKETS`` rows a source, whatever the corpus size).

Defined results: a null source is one source and comes last; null and empty texts have size
0, never add to what is taken; a source without words has target 0 and no copies; repeated
rows are separate documents of equal size; other columns pass through and the output columns
replace columns of the same name, in any case. Keys are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abode.llm.columns import carried, kept, restored
from abode.llm.joins import BROADCAST_ROWS, attach
from abode.operators.split import hash_uniform
from abode.session import materialize

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
MAX_REPEAT = 3
BUCKETS = 64
SEED = 17


def word_count(text) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text, 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> plus weight and target. One row per source: the windows run over that small table."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = totals.withColumn("_rank", F.row_number().over(by_name))
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", F.lit(float(max_repeat)) * F.col("source_size"))
    order = Window.orderBy((F.col("_cap") / F.col("weight")), "_rank")
    everything = Window.partitionBy()
    t = t.withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("_after", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("_all", F.sum("source_size").over(everything).cast("double"))
    # the level rises while sources are capped and falls from the first that is not
    t = t.withColumn("_level", F.max((F.col("_all") - F.col("_before")) / F.col("_after")).over(everything))
    return t.select("source", "source_size", "weight", F.least("_cap", F.col("_level") * F.col("weight")).alias("target"))


def size_class(size) -> Column:
    """Bit length and the three bits after the first: classes of at most one eighth in width."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(bits * 8 + F.expr("shiftright(_mx_size, length(bin(_mx_size)) - 4)").cast("long") % 8 + 16)


def mix(df: DataFrame, size: str = "size", key: str = "doc_id", source: str = "source", weights=WEIGHTS,
        max_repeat: int = MAX_REPEAT, seed: int = SEED, ties: tuple = ()) -> DataFrame:
    """Add source_size, target (of the row's source) and copies. ``df`` is read twice: pass a written table.

    Rows with equal size and key are ordered by the columns ``ties``.
    """
    columns = kept(df, ("source_size", "target", "copies"))
    rows = carried(df, columns, _mx_size=F.col(f"`{size}`").cast("long"), _mx_none=F.col(f"`{source}`").isNull(), _mx_key=F.col(f"`{key}`"),
                   _mx_source=F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")),
                   _mx_bucket=F.coalesce(F.pmod(F.col(f"`{key}`"), F.lit(BUCKETS)), F.lit(-1)).cast("long"),
                   **{f"_mx_tie{i}": F.col(f"`{c}`") for i, c in enumerate(ties)})
    ties = [f"_mx_tie{i}" for i in range(len(ties))]
    rows = rows.withColumn("_mx_class", size_class(F.col("_mx_size")).cast("long"))
    cell = ["_mx_none", "_mx_source", "_mx_class", "_mx_bucket"]
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_mx_n"), F.sum("_mx_size").alias("_mx_sum"))
    of_source = cells.groupBy("_mx_none", "_mx_source").agg(F.sum("_mx_sum").alias("source_size"))
    named = of_source.select(F.when(~F.col("_mx_none"), F.col("_mx_source")).alias("source"), "source_size")
    targets = source_targets(named, weights, max_repeat).select(
        F.col("source").isNull().alias("_mx_none"), F.coalesce("source", F.lit("")).alias("_mx_source"), "source_size", "target")
    classes = cells.groupBy("_mx_none", "_mx_source", "_mx_class").agg(F.sum("_mx_n").alias("_mx_cn"))
    w_class = Window.partitionBy("_mx_none", "_mx_source").orderBy("_mx_class").rowsBetween(Window.unboundedPreceding, -1)
    w_bucket = Window.partitionBy("_mx_none", "_mx_source", "_mx_class").orderBy("_mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("_mx_c0", F.coalesce(F.sum("_mx_cn").over(w_class), F.lit(0))).drop("_mx_cn")
    cells = cells.withColumn("_mx_b0", F.coalesce(F.sum("_mx_n").over(w_bucket), F.lit(0))).drop("_mx_n", "_mx_sum")
    cells = cells.join(classes.join(targets, ["_mx_none", "_mx_source"]), ["_mx_none", "_mx_source", "_mx_class"])
    ranked = rows.withColumn("_mx_k", F.row_number().over(Window.partitionBy(*cell).orderBy("_mx_size", "_mx_key", *ties)))
    out = ranked.join(cells, cell)
    rate = F.col("target") / F.col("source_size")
    end = F.col("_mx_c0") + F.col("_mx_b0") + F.col("_mx_k")
    offset = hash_uniform(F.when(F.col("_mx_none"), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("_mx_source"))), seed)
    copies = F.floor(end * rate + offset) - F.floor((end - 1) * rate + offset)
    copies = F.when(F.col("source_size") > 0, copies).otherwise(F.lit(0)).cast("long").alias("copies")
    return restored(out, columns, F.col("source_size"), F.col("target"), copies)


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy; the columns that ``mix`` added are dropped."""
    columns = kept(mixed, ("source_size", "target", "copies"))
    rows = carried(mixed.where("copies > 0"), columns, _mx_copy=F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return restored(rows, columns)


def row_identity(df: DataFrame) -> Column:
    """128 bits of a row's values, as text; equal for equal rows only."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.concat_ws("-", F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))


def emit_to(df: DataFrame, mixed: DataFrame, identity: str = "_mx_id", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` as often as ``mixed`` (``mix`` of a written table of keys, sizes and ``identity``) says; whole rows stay where they are.

    Equal rows have one identity; their copies are added up and come from one of them.
    """
    copies = mixed.groupBy(identity).agg(F.sum("copies").alias("_mx_copies"), F.count(F.lit(1)).alias("_mx_rows")).where("_mx_copies > 0")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_mx_row"), row_identity(df).alias(identity))
    rows = attach(rows, materialize(copies, "mix-copies"), identity, F.col(identity), bound)
    single = rows.where("_mx_rows = 1").select("_mx_row", "_mx_copies")
    equal = rows.where("_mx_rows > 1").groupBy(identity, "_mx_copies").agg(F.first("_mx_row").alias("_mx_row"))
    out = single.unionByName(equal.select("_mx_row", "_mx_copies"))
    return out.select("_mx_row", F.explode(F.sequence(F.lit(1), F.col("_mx_copies").cast("int")))).select("_mx_row.*")


def oracle(weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> str:
    """DuckDB SQL of the query, with one window per source instead of cells."""
    unit = f"(CAST(('0x' || substr(md5(CASE WHEN k.source IS NULL THEN 'null' ELSE '=' || k.source END || ':{seed}'), 1, 8)) AS BIGINT) / 4294967296.0)"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, CAST(list_extract({list(weights)}, CAST((rk - 1) % {len(weights)} + 1 AS BIGINT)) AS DOUBLE) AS weight, CAST({max_repeat} AS DOUBLE) * source_size AS cap FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM w),
t AS (SELECT source, source_size, least(cap, max((total - before) / after) OVER () * weight) AS target FROM l),
c AS (SELECT *, CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)) % 8 + 16 END AS class,
  coalesce(((doc_id % {BUCKETS}) + {BUCKETS}) % {BUCKETS}, -1) AS bucket FROM d),
k AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY class, bucket, size, doc_id) AS k FROM c)
SELECT doc_id, size, source_size, target, CAST(size * CASE WHEN source_size > 0 THEN
  floor(k * (target / source_size) + {unit}) - floor((k - 1) * (target / source_size) + {unit}) ELSE 0 END AS BIGINT) AS taken
FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source"""
