"""Reports and the gate over findings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from .lint import ORDER


def text_line() -> Column:
    """A finding as a line of text."""
    return _text_line(F.concat_ws(":", "file", "line", F.col("column")))


def text_line_without_column() -> Column:
    return _text_line(F.concat_ws(":", "file", "line"))


def _text_line(place: Column) -> Column:
    hint = F.when(F.col("suggestion").isNull(), "").otherwise(F.concat(F.lit(" (Suggestion: "), F.col("suggestion"), F.lit(")")))
    return F.concat(place, F.lit(": ["), F.upper("severity"), F.lit("] "), F.col("rule_code"), F.lit(" — "), F.col("message"), hint)


def counts(found: DataFrame) -> DataFrame:
    """errors and warnings, one row."""
    return found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))


def by_file(docs: DataFrame, found: DataFrame) -> DataFrame:
    """A row a file, those without findings too: file, errors, warnings."""
    each = found.groupBy("file").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    zero = F.lit(0).cast("long")
    return docs.select("file").distinct().join(each, "file", "left").select("file", F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"))


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_code", "severity").agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))


def summary_line(files: int, errors: int, warnings: int) -> str:
    return f"Checked {files} file(s): {errors} error(s), {warnings} warning(s)."


def failed(found: DataFrame, strict: bool = False) -> DataFrame:
    """Whether the gate fails, one row: some error, or in strict runs some warning."""
    bad = (F.col("severity") == "error") | (F.lit(strict) & (F.col("severity") == "warn"))
    return found.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("failed"))


def gate(segments: DataFrame) -> DataFrame:
    """(strict, failed): whether the gate fails by the structural rules in strict runs, and in others. One pass over segments with mode and rules, without findings."""
    worst = rules.with_sentences(segments, counted=False).select(rules.worst().alias("w"))
    told = lambda c: F.coalesce(F.bool_or(F.col(f"w.{c}")), F.lit(False)).alias("failed")
    each = worst.agg(F.array(F.struct(F.lit(True).alias("strict"), told("some")), F.struct(F.lit(False).alias("strict"), told("error"))).alias("r"))
    return each.select(F.explode("r").alias("r")).select("r.*")


def _totals(docs: DataFrame, found: DataFrame) -> DataFrame:
    return counts(found).crossJoin(docs.select("file").distinct().agg(F.count("*").alias("files")))


def _head() -> list[Column]:
    return [F.col("files").alias("filesChecked"), F.col("errors").alias("errorCount"), F.col("warnings").alias("warningCount")]


def _fields() -> list:
    return ["file", "line", F.lit(None).cast("int").alias("column"), F.col("rule_code").alias("ruleCode"), "severity", "message", "suggestion"]


def _item() -> Column:
    return F.struct(*_fields())


#: Opens the sort keys in a shuffled line of ``json_rows``; numbers alone follow, so its last place in a line is this one.
_KEYS = ',"pass":'


def json_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The JSON report as rows in order (column report), of any size: an object with filesChecked, errorCount and warningCount, then an object a finding.

    Findings are made once: each is shuffled as one text, its report and sort keys, and that shuffle is read for the counts, for the
    ranges of the sort and for the rows. As one column it is the same for all of them, where Spark would leave out columns for the counts and make it again.
    """
    told = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    kinds = {f.name: f.dataType for f in found.schema}
    once = found.select(told(F.struct(*_fields(), *ORDER[1:])).alias("v")).repartition("v")
    head = counts(once.select(F.get_json_object("v", "$.severity").alias("severity"))).crossJoin(docs.select("file").distinct().agg(F.count("*").alias("files")))
    head = head.select(F.lit(0).alias("_part"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ORDER), told(F.struct(*_head())).alias("report"))
    keys = F.from_json("v", ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in ORDER))
    line = F.concat(F.col("v").substr(F.lit(1), F.length("v") - F.length(F.substring_index("v", _KEYS, -1)) - len(_KEYS)), F.lit("}"))
    items = once.select(keys.alias("k"), line.alias("report")).select(F.lit(1).alias("_part"), *(F.col(f"k.{c}").alias(c) for c in ORDER), "report")
    return head.unionByName(items).orderBy("_part", *ORDER).select("report")


def json_lines(rows: Iterable[str]) -> Iterator[str]:
    """Lines of one JSON document from the texts of ``json_rows``, held one at a time."""
    rows = iter(rows)
    yield next(rows)[:-1] + ',"diagnostics":['
    last = next(rows, None)
    for row in rows:
        yield f"{last},"
        last = row
    if last is not None:
        yield last
    yield "]}"


def json_report(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One JSON document (column report): filesChecked, errorCount, warningCount, diagnostics in order. All findings meet in one row, so only for small reports; ``json_rows`` has no such bound."""
    listed = found.agg(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, _item().alias("item")))), lambda x: x["item"]).alias("items"))
    whole = F.struct(*_head(), F.col("items").alias("diagnostics"))
    return _totals(docs, found).crossJoin(listed).select(F.to_json(whole, {"ignoreNullFields": "false", "pretty": "true"}).alias("report"))


def _ranged(df: DataFrame, parts: int | None, *order: str) -> DataFrame:
    return df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)


def numbered(found: DataFrame, order: tuple[str, ...] = ORDER, name: str = "number", parts: int | None = None) -> DataFrame:
    """``found`` in the order of a report, with the number of each row from 1.

    Rows are dealt by ranges and sorted in them; a row's number is its place in its range and the count of all ranges before, of which there are as many as
    partitions: ``parts``, or what Spark takes. Dealt rows are checkpointed, so that a task that runs again finds them as they were.
    """
    dealt = _ranged(found, parts, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()).checkpoint()
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(F.shiftright(name, 33).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return dealt
    before = list(accumulate((sizes.get(p, 0) for p in range(max(sizes))), initial=0))
    starts = F.split(F.lit(",".join(map(str, before))), ",", -1).cast("array<bigint>")
    return dealt.withColumn(name, F.get(starts, F.shiftright(name, 33).cast("int")) + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + 1)


def write_json(docs: DataFrame, found: DataFrame, path: str, parts: int | None = None) -> None:
    """The JSON report as one document in many files: joined in the order of the manifest they are what the command line writes.

    ``path``/parts has the files, each written by a task; ``path``/manifest has their names and bytes, and is written last: where it is, the document is whole.
    """
    told = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    rows = numbered(found, parts=parts)
    total = F.lit(rows.count())
    head = _totals(docs, found).select(F.lit(0).cast("long").alias("number"), F.regexp_replace(told(F.struct(*_head())), r"\}\z", ',"diagnostics":[').alias("value"))
    items = rows.select("number", F.concat(told(_item()), F.when(F.col("number") < total, ",").otherwise("")).alias("value"))
    tail = docs.sparkSession.range(1).select((total + 1).alias("number"), F.lit("]}").alias("value"))
    whole = head.unionByName(items).unionByName(tail)
    _ranged(whole, parts, "number").sortWithinPartitions("number").select("value").write.text(f"{path}/parts")
    # task numbers are part of the names, so names sort as the rows do
    names = docs.sparkSession.read.format("binaryFile").load(f"{path}/parts").where("length > 0").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")
    names.coalesce(1).sortWithinPartitions("name").write.json(f"{path}/manifest")


def write_table(found: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Diagnostics as Parquet, for collections too large for a report."""
    found.write.mode(mode).parquet(path)


def write_text(found: DataFrame, path: str) -> None:
    """The text report as files of lines, in order."""
    found.orderBy(*ORDER).select(text_line().alias("value")).write.text(path)
