r"""CSV with newlines inside quotes, read by many tasks (A1).

A record may span lines, so a task that starts in the middle of a file cannot know by itself whether
its first line lies inside quotes. It can count, though: every quote character turns the state,
an escaped (doubled) one twice. So

1. each byte range (block) of a file counts the quotes of its lines: one bit per block;
2. a prefix scan of those bits, one row per block and not per line, gives the state at the start of each;
3. each task then cuts its blocks into records from its known state, in one pass over the lines in order. A
   record that crosses a border is left in pieces: a head (lines that finish an earlier record) and a tail;
4. the few pieces, at most two per block, are joined to records in a second, small step;
5. Spark's own parser turns each record into columns.

Lines are Spark's text source with its splits, so a file of any size is read by as many tasks
as it has ranges, and no line is shuffled but those of the pieces.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.session import materialize

BROADCAST_BLOCKS = 1 << 21  # states of so many blocks are broadcast; more are joined
WHOLE, HEAD, TAIL = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def block_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a block starts inside quotes, from the quotes of all earlier blocks of its file."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return odd.select("file", "block", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))


def _cut(batches):
    """Lines in order -> (file, block, kind, first, record): whole records, and the pieces at a block's borders."""
    out, at, open_lines, inside, kind, first = [], None, [], False, WHOLE, False

    def flush():
        out.append((*at, TAIL if kind == WHOLE and inside else kind, first, "\n".join(open_lines)))
        open_lines.clear()

    def result():
        columns = list(zip(*out)) if out else [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))],
                                          names=["file", "block", "kind", "first", "record"])

    for batch in batches:
        for value, file, block, starts_inside in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block", "inside"))):
            if at != (file, block):
                if open_lines:
                    flush()
                at, inside = (file, block), starts_inside
                kind, first = HEAD if inside else WHOLE, block == 0
            open_lines.append(value)
            if value.count('"') % 2:
                inside = not inside
            if not inside:
                flush()
                kind, first = WHOLE, False
        yield result()
    if open_lines:
        flush()
    yield result()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first): the records of the files under ``path``, line ends inside quotes kept; ``first`` marks a file's first one."""
    lines = _lines(spark, path)
    states = materialize(block_states(lines), "csv-blocks")
    if states.count() <= BROADCAST_BLOCKS:  # the join leaves a task's lines in their order
        placed = lines.join(F.broadcast(states), ["file", "block"])
    else:
        placed = (lines.withColumn("_line", F.monotonically_increasing_id()).join(states, ["file", "block"])
                  .repartition("file", "block").sortWithinPartitions("file", "block", "_line"))
    cut = placed.select("value", "file", "block", "inside").mapInArrow(_cut, "file long, block long, kind int, first boolean, record string")
    cut = materialize(cut, "csv-records")
    pieces = cut.where(F.col("kind") != WHOLE).select("file", "block", "kind")
    so_far = Window.partitionBy("file").orderBy("block", "kind")  # a block's head stands before its tail
    chains = pieces.withColumn("chain", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(so_far))
    joined = cut.where(F.col("kind") != WHOLE).join(chains, ["file", "block", "kind"])
    joined = joined.groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts"), F.max("first").alias("first"))
    joined = joined.select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"), "first")
    return cut.where(F.col("kind") == WHOLE).select("record", "first").unionByName(joined)


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of CSV files with a header each; doubled quotes are escapes, empty lines are no records."""
    rows = records(spark, path).where(~F.col("first")).select(F.regexp_replace("record", "\r$", "").alias("record")).where(F.col("record") != "")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.select(F.from_csv("record", fields, {"escape": '"', "mode": "PERMISSIVE"}).alias("row")).select("row.*")
