"""Markdown to prose segments, one pass a document, without a shuffle.

Every line is coded as its kind, number and text, and the coded document is read
as a small regular language: a fenced block is a break, a segment is a heading, a
table row, a list item with its continuations, or a run of text lines. So fences
and wrapped lines are folded by linear regular expressions inside the row,
where windows over exploded lines would shuffle the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import let, running_sum, trimmed, trimmed_left

SEGMENT_SCHEMA = "struct<line:int,role:string,text:string,line_offsets:array<struct<offset:int,line:int>>>"

_MARK = "\x01"
_FENCED = r"(?dm)^F[^\n]*\n(?:[^F][^\n]*\n)*+(?:F[^\n]*\n)?"
_SEGMENT = r"(?dm)^(?:[HT][^\n]*\n|[LN][^\n]*\n(?:X[^\n]*\n)*+|(?:X[^\n]*\n)++)"


def lines(text: Column) -> Column:
    """Lines of a text, carriage returns before line feeds dropped, a byte order mark too."""
    bare = F.when(text.startswith("\ufeff"), F.substring(text, 2, (1 << 31) - 1)).otherwise(text)
    return F.split(F.replace(bare, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def cleaned(line: Column) -> Column:
    """Links as their visible text."""
    tail = F.substring_index(line, ")", -1)
    head = line.substr(F.lit(1), F.length(line) - F.length(tail))
    return F.when(line.contains("]("), F.concat(F.regexp_replace(head, P.LINK, "$1$2"), tail)).otherwise(line)


def heading(line: Column) -> Column:
    """The text of a heading, without the marks that may close it."""
    bare = F.rtrim(F.regexp_extract(line, P.HEADING, 1), F.lit(P.SPACES))
    return F.rtrim(F.rtrim(bare, F.lit("#")), F.lit(P.SPACES))


def kind(raw: Column, line: Column | None = None) -> Column:
    """F(ence), B(reak), H(eading), L(ist item), T(able row), N(ested item) or X (text); the first that applies. ``line`` is the cleaned one."""
    line = cleaned(raw) if line is None else line
    return (
        F.when((raw.contains("```") | raw.contains("~~~")) & raw.rlike(P.FENCE), "F")
        .when(trimmed_left(line) == "", "B")
        .when(line.contains("#") & line.rlike(P.HEADING), "H")
        .when(line.rlike(P.LIST_ITEM), "L")
        .when(line.contains("|") & line.rlike(P.TABLE_ROW), F.when(line.rlike(P.TABLE_RULE), "B").otherwise("T"))
        .when(line.rlike(P.NESTED_ITEM), "N")
        .otherwise("X")
    )


def piece(line: Column, kinds: Column) -> Column:
    """The prose of a cleaned line of a kind."""
    return (
        F.when(kinds == "X", trimmed(line))
        .when(kinds == "H", heading(line))
        .when(kinds == "L", trimmed(F.regexp_extract(line, P.LIST_ITEM, 1)))
        .when(kinds == "N", trimmed(F.regexp_extract(line, P.NESTED_ITEM, 1)))
        .when(kinds == "T", line)
        .otherwise("")
    )


def cells(row: Column) -> Column:
    """Cells of a table row: split at pipes outside code, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(row, F.lit(P.TABLE_CELL), F.lit(1)), trimmed), lambda x: x != "")


def coded(text: Column) -> Column:
    one = lambda raw, i: let(cleaned(raw), lambda line: let(kind(raw, line), lambda k: F.concat(k, (i + 1).cast("string"), F.lit(_MARK), piece(line, k))))
    return F.concat(F.array_join(F.transform(lines(text), one), "\n"), F.lit("\n"))


def _rows(segment: Column) -> Column:
    """(line, text) of the coded lines of a segment."""
    own = F.filter(F.split(segment, "\n", -1), lambda x: x != "")
    return F.transform(own, lambda x: F.struct(F.substring_index(x, _MARK, 1).substr(F.lit(2), F.length(x)).cast("int").alias("line"), x.substr(F.instr(x, _MARK) + 1, F.length(x)).alias("text")))


def _folded(role: Column, rows: Column) -> Column:
    """Texts joined by a space, and the offset at which each line's text begins."""
    sizes = F.transform(rows, lambda r: F.when(r["text"] == "", 0).otherwise(F.length(r["text"]) + 1))
    before = F.zip_with(running_sum(sizes), sizes, lambda end, size: end - size)
    return F.struct(
        rows[0]["line"].alias("line"),
        role.alias("role"),
        F.array_join(F.filter(F.transform(rows, lambda r: r["text"]), lambda t: t != ""), " ").alias("text"),
        F.zip_with(before, rows, lambda offset, r: F.struct(offset.alias("offset"), r["line"].alias("line"))).alias("line_offsets"),
    )


def _segments_of(segment: Column) -> Column:
    """A coded segment as an array of structs: one, or one a cell of a table row."""
    head, rows = F.substring(segment, 1, 1), _rows(segment)
    role = F.when(head == "H", "Heading").when(head == "X", "Paragraph").otherwise("ListItem")
    in_row = lambda r: F.transform(
        cells(r["text"]), lambda c: F.struct(r["line"].alias("line"), F.lit("TableRow").alias("role"), c.alias("text"), F.array(F.struct(F.lit(0).alias("offset"), r["line"].alias("line"))).alias("line_offsets"))
    )
    whole = F.filter(F.transform(F.array(rows), lambda r: _folded(role, r)), lambda s: (s["role"] == "Heading") | (s["text"] != ""))
    return F.when(head == "T", in_row(rows[0])).otherwise(whole).cast(f"array<{SEGMENT_SCHEMA}>")


def segments_column(text: Column) -> Column:
    """array<struct<line, role, text, line_offsets>> of a document, in order."""
    found = F.regexp_extract_all(F.regexp_replace(coded(text), _FENCED, "B\n"), F.lit(f"({_SEGMENT})"), F.lit(1))
    return F.flatten(F.transform(found, _segments_of))


def segments(docs: DataFrame, file: str = "file", content: str = "content", more: tuple[str, ...] = ()) -> DataFrame:
    """(file, seg_ord, line, role, text, line_offsets), a row a segment, of every document, with the columns ``more`` of it.

    Null content has no segments. Documents may repeat; nothing crosses from one row to another.
    """
    # exploded where it is made: a filter on an exploded column would make it twice
    found = docs.select(F.col(file).alias("file"), *more, F.posexplode(segments_column(F.col(content))).alias("seg_ord", "_s"))
    return found.select("file", "seg_ord", "_s.*", *more)


