"""Column functions over text and arrays."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def table_of(rows: list[dict], key: str, schema: str) -> Callable[[Column], Column]:
    """Look-ups in a constant table by a text ``key``: of a value, the rows (structs of ``schema``) with that key, in order.

    Rows are dealt by the hash of the key, so a look-up costs no more in a table of thousands. The table is read from one literal when the plan is made.
    """
    if not rows:
        return lambda value: F.expr(f"cast(array() as array<struct<{schema}>>)")
    size = 1 << max(4, (2 * len(rows)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for row in rows:
        buckets[zlib.crc32(row[key].encode()) % size].append(row)
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<{schema}>>>")
    return lambda value: F.filter(F.get(table, (F.crc32(F.encode(value, "UTF-8")) % size).cast("int")), lambda r: r[key] == value)


def trimmed(text: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.btrim(text, F.lit(P.SPACES))


def trimmed_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(P.SPACES))


def leading_space(text: Column) -> Column:
    return F.length(text) - F.length(trimmed_left(text))


def tokens(text: Column) -> Column:
    """Runs without white space."""
    return F.array_remove(F.split(text, f"{P.S}+", -1), "")


def _fold(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    start = F.expr("cast(array() as array<int>)")
    return F.aggregate(values, start, lambda done, x: F.concat(done, F.array(F.when(F.size(done) == 0, x).otherwise(join(F.try_element_at(done, F.lit(-1)), x)))))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """An int array joined up to each place by an associative ``join``, in blocks, so that long arrays take little more than linear time."""
    starts = lambda v: F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK))).otherwise(F.expr("cast(array() as array<int>)"))
    blocks = lambda v: F.transform(starts(v), lambda s: _fold(F.slice(v, s + 1, F.lit(BLOCK)), join))

    def joined(b: Column) -> Column:
        ends = _fold(F.transform(b, lambda x: F.element_at(x, -1)), join)
        before = F.concat(F.array(F.lit(None).cast("int")), F.slice(ends, F.lit(1), F.size(b) - 1))
        return F.flatten(F.zip_with(b, before, lambda x, y: F.when(y.isNull(), x).otherwise(F.transform(x, lambda z: join(y, z)))))

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, _fold(v, join)).otherwise(let(blocks(v), joined)))


def running_sum(values: Column) -> Column:
    """Sums of an int array up to each place."""
    return running(values, lambda a, b: a + b)


#: Stands around matches in a text that has none itself.
SIGN = "\x01"


def cut_at(text: Column, pattern: str | Column, groups: tuple[str, ...] = ("$0",)) -> Column:
    """A text without ``SIGN`` cut at the matches of a pattern, which is read once: what stands before the first match, then for each match its ``groups`` and what stands after it."""
    return F.split(F.regexp_replace(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(SIGN.join(["", *groups, ""]))), SIGN, -1)


def places(pieces: Column, groups: int = 1) -> Column:
    """The end of each match in what ``cut_at`` gives; the match itself is the first of its groups."""
    step = groups + 1
    sizes = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1 - step, F.lit(step)), lambda i: F.length(F.get(pieces, i)) + F.length(F.get(pieces, i + 1)))
    return running_sum(sizes)


def located(text: Column, pattern: str | Column, gaps: bool = False) -> Column:
    """Matches of a pattern without groups, as array<struct<start, end, value>>, from the gaps between them.

    Offsets are in code points, the end exclusive. ``gaps`` adds the text between a match and the one before (gap), and the one after (after).
    """

    def struct(end: Column, value: Column, gap: Column, after: Column) -> Column:
        return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), *([gap.alias("gap"), after.alias("after")] if gaps else []))

    def placed(x: Column) -> Column:
        return F.transform(places(x), lambda e, i: struct(e, F.get(x, 2 * i + 1), F.get(x, 2 * i), F.get(x, 2 * i + 2)))

    def placed_apart(x: Column) -> Column:
        before = F.slice(x["g"], F.lit(1), F.size(x["m"]))
        ends = running_sum(F.zip_with(x["m"], before, lambda m, g: F.length(m) + F.length(g)))
        return F.transform(ends, lambda e, i: struct(e, F.get(x["m"], i), F.get(x["g"], i), F.get(x["g"], i + 1)))

    whole = F.lit(f"({pattern})") if isinstance(pattern, str) else F.concat(F.lit("("), pattern, F.lit(")"))
    kind = "array<struct<start:int,end:int,value:string" + (",gap:string,after:string>>" if gaps else ">>")
    none = F.expr(f"cast(array() as {kind})")
    once = let(cut_at(text, pattern), lambda x: F.when(F.size(x) > 1, placed(x)).otherwise(none))
    apart = let(F.struct(F.regexp_extract_all(text, whole, F.lit(1)).alias("m"), F.split(text, pattern, -1).alias("g")), placed_apart)
    return F.when(text.contains(SIGN), apart).otherwise(once).cast(kind)


def outside_code(text: Column, pattern: str, gaps: bool = False) -> Column:
    """``located`` matches that lie in no inline code span; for patterns that cannot match a backtick."""
    return F.filter(located(text, f"{P.CODE}|{pattern}", gaps), lambda x: ~x["value"].startswith("`"))


def masked_code(text: Column) -> Column:
    return F.when(text.contains("`"), F.regexp_replace(text, P.CODE, "C")).otherwise(text)


def truncated(text: Column) -> Column:
    return F.when(F.length(text) <= 80, text).otherwise(F.concat(F.substring(text, 1, 77), F.lit("...")))


def resolve_line(line_offsets: Column, offset: Column) -> Column:
    """The source line of an offset: the last entry at or before it."""
    return F.element_at(F.filter(line_offsets, lambda e: e["offset"] <= offset), -1)["line"]
