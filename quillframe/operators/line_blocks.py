"""Segments of texts of any size, given as rows of lines.

A text that fits a row is folded inside it (``markdown``). Here no task holds a text:
its lines are dealt in blocks of ``BLOCK``, and what a line needs to know of all
before it is a scan over blocks of something that joins associatively: the parity of fence marks, the kinds of lines next to a
block, how many segments began, and the line on which the last one did. Each block adds its
own in a window of its own; the scans themselves run over a row a block. A
segment is then gathered by the line on which it begins, over block bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .markdown import SEGMENT_SCHEMA, _folded, cells, cleaned, kind, piece

#: Lines of a block.
BLOCK = 65_536


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of text files, which Spark may split: the path, and lines numbered from 1 through all splits of a file.

    Lines end at line feeds, of which a carriage return before one is a part; a byte order mark is dropped.
    """
    place = F.struct("_metadata.file_path", F.col("_metadata.file_block_start").alias("start"))
    rows = spark.read.option("lineSep", "\n").text(path).select("value", place.alias("at"), F.monotonically_increasing_id().alias("n"))
    splits = rows.groupBy("at").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = Window.partitionBy("at.file_path").orderBy("at.start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("at", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    numbered = rows.join(splits, "at").select(F.col("at.file_path").alias("file"), (F.col("n") + F.col("shift")).alias("line_no"), "value")
    bare = F.when((F.col("line_no") == 1) & F.col("value").startswith("﻿"), F.col("value").substr(F.lit(2), F.length("value"))).otherwise(F.col("value"))
    return numbered.select("file", "line_no", F.regexp_replace(bare, r"\r\z", "").alias("raw"))


def lines_of(docs: DataFrame, content: str = "content") -> DataFrame:
    """(file, line_no, raw) of (file, content)."""
    from .markdown import lines

    rows = docs.select("file", F.posexplode(lines(F.col(content))).alias("i", "raw"))
    return rows.select("file", (F.col("i") + 1).cast("long").alias("line_no"), "raw")


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds what ``value``, an aggregate, comes to over all blocks of the file before this one."""
    return rows.withColumn(name, value.over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))


def segments(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, seg_ord, line, role, text, line_offsets) of (file, line_no, raw), as ``markdown.segments`` has them of whole texts.

    Files are told apart by their names, and a null one is a name like others; a file's line numbers must run from 1 without a gap. Only a segment, which is a
    row of the result, is ever held whole.
    """
    own = lines.select("file", "line_no", F.floor((F.col("line_no") - 1) / block).alias("block"), "raw", cleaned(F.col("raw")).alias("clean"))
    own = own.select("file", "line_no", "block", "clean", kind(F.col("raw"), F.col("clean")).alias("kind")).withColumn("text", piece(F.col("clean"), F.col("kind"))).drop("clean")
    here = Window.partitionBy("file", "block").orderBy("line_no")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)

    def told(rows: DataFrame, blocks: DataFrame) -> DataFrame:
        blocks = blocks.withColumnsRenamed({"file": "_file", "block": "_block"})
        return rows.join(blocks, rows["file"].eqNullSafe(blocks["_file"]) & (rows["block"] == blocks["_block"])).drop("_file", "_block")

    # fences: a line is within one where an odd number of marks is before it
    marks = own.groupBy("file", "block").agg(F.count_if(F.col("kind") == "F").alias("marks"))
    marks = _before(marks, F.sum("marks"), "fences").select("file", "block", F.coalesce("fences", F.lit(0)).alias("fences"))
    is_mark = (F.col("kind") == "F").cast("int")
    inside = (F.col("fences") + F.sum(is_mark).over(upto) - is_mark) % 2 == 1
    rows = told(own, marks).withColumn("kind", F.when(inside | (F.col("kind") == "F"), "B").otherwise(F.col("kind"))).drop("fences")

    # the lines around: a text line goes on with what is before it, and an empty item counts if a text line follows
    ends = rows.groupBy("file", "block").agg(F.min_by("kind", "line_no").alias("first"), F.max_by("kind", "line_no").alias("last"))
    by_block = Window.partitionBy("file").orderBy("block")
    ends = ends.select("file", "block", F.lag("last").over(by_block).alias("before"), F.lead("first").over(by_block).alias("after"))
    rows = told(rows, ends)
    before = F.coalesce(F.lag("kind").over(here), F.col("before"), F.lit("B"))
    after = F.coalesce(F.lead("kind").over(here), F.col("after"), F.lit("B"))
    item, table = F.col("kind").isin("L", "N"), F.col("kind") == "T"
    begins = F.col("kind").isin("H", "T", "L", "N") | ((F.col("kind") == "X") & ~before.isin("L", "N", "X"))
    count = F.when(~begins, 0).when(table, F.size(cells(F.col("text")))).when(item, ((F.col("text") != "") | (after == "X")).cast("int")).otherwise(1)
    rows = rows.withColumns({"begins": begins, "count": count}).drop("before", "after")

    # numbers: how many segments are before, and where the open one began
    sums = rows.groupBy("file", "block").agg(F.sum("count").alias("n"), F.max(F.when(F.col("begins"), F.col("line_no"))).alias("began"))
    sums = _before(_before(sums, F.sum("n"), "ord"), F.max("began"), "open").select("file", "block", F.coalesce("ord", F.lit(0)).alias("ord"), "open")
    start = F.coalesce(F.max(F.when(F.col("begins"), F.col("line_no"))).over(upto), F.col("open"))
    rows = told(rows, sums).withColumns({"ord": (F.col("ord") + F.sum("count").over(upto) - F.col("count")).cast("int"), "start": start}).where("kind <> 'B'")

    line = F.col("line_no").cast("int")
    in_row = rows.where(table).select("file", "ord", line.alias("line"), F.posexplode(cells(F.col("text"))).alias("i", "text"))
    offsets = F.array(F.struct(F.lit(0).alias("offset"), F.col("line")))
    in_row = in_row.select("file", (F.col("ord") + F.col("i")).alias("seg_ord"), "line", F.lit("TableRow").alias("role"), "text", offsets.alias("line_offsets"))
    head = F.min_by(F.struct("kind", "ord"), "line_no")
    gathered = rows.where(~table).groupBy("file", "start").agg(head.alias("h"), F.array_sort(F.collect_list(F.struct(line.alias("line"), "text"))).alias("rows"))
    role = F.when(F.col("h.kind") == "H", "Heading").when(F.col("h.kind") == "X", "Paragraph").otherwise("ListItem")
    whole = gathered.select("file", F.col("h.ord").alias("seg_ord"), _folded(role, F.col("rows")).cast(SEGMENT_SCHEMA).alias("s")).select("file", "seg_ord", "s.*")
    return whole.where((F.col("role") == "Heading") | (F.col("text") != "")).unionByName(in_row.select(whole.columns))
