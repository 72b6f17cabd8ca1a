"""One large JSON array of objects, read by many tasks.

Spark's text source can cut a file at any separator and deals byte ranges of a
file to tasks. Cut at ``}``, a JSON array comes as pieces whose ends are known
but not what they are: the end of an element, of an object inside one, or part
of a string. Two running sums over a file's pieces tell: the number of quotes
before a piece (odd: it starts inside a string), and from that the depth of
brackets before it. A piece that starts outside a string at depth 1 or less
begins an element, and a third running sum numbers the elements.

A running sum is taken within each byte range and shifted by the sums of the
ranges before it (one small row per range), so no task sees more than a byte
range of text at once and no file is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumflow.operators.joins import broadcast_if_small
from forumflow.sinks.writers import staged

# A string, or the rest of one that the piece does not end.
_STRING = r'"[^"]*(?:"|\z)'


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _with_running_sum(pieces: DataFrame, amount: Column, out: str) -> DataFrame:
    """``out``: the sum of ``amount`` over the file's earlier pieces."""
    pieces = pieces.withColumn("__amount", amount)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.groupBy("file", "block").agg(F.sum("__amount").alias("__sum"))
    ranges = ranges.select("file", "block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    here = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return (pieces.join(broadcast_if_small(ranges), ["file", "block"])
            .withColumn(out, F.coalesce(F.sum("__amount").over(here), F.lit(0)) + F.col("__base")).drop("__amount", "__base"))


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, record): every object of the top-level arrays in the files at ``path`` as JSON text, ``ord`` from
    0 in file order. Elements that are no objects are not read; the files are UTF-8, of any layout."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    pieces = staged(raw, "json-pieces")
    # an escape never spans two pieces: no escape ends in '}'
    bare = F.regexp_replace("value", r"\\.", "")
    pieces = _with_running_sum(pieces, _count(bare, '"'), "quotes")
    inside = F.col("quotes") % 2 == 1
    outside = F.regexp_replace(F.when(inside, F.concat(F.lit('"'), bare)).otherwise(bare), _STRING, "")
    ends_inside = (F.col("quotes") + _count(bare, '"')) % 2 == 1
    depth = _count(outside, "{[") - _count(outside, "}]") - F.when(ends_inside, 0).otherwise(1)
    pieces = _with_running_sum(pieces, depth, "depth")
    begins = F.when(~inside & (F.col("depth") <= 1), 1).otherwise(0)
    pieces = _with_running_sum(pieces, begins, "before").withColumn("ord", F.col("before") + begins - 1)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "value"))), lambda p: p["value"])
    records = pieces.groupBy("file", "ord").agg(F.concat(F.array_join(texts, "}"), F.lit("}")).alias("record"))
    # what stands between elements; behind the last one nothing is left but the array's end
    records = records.withColumn("record", F.regexp_replace("record", "^[\\s,\\[\ufeff]+", ""))
    return records.where(F.startswith("record", F.lit("{")))
