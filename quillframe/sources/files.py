"""Text files as a table of (file, content)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT_INCLUDE, Config
from .globs import glob_regex


class UnsafePathError(ValueError):
    """A path that leaves the folder it must stay in."""


def safe_join(folder: str, path: str) -> str:
    """``path`` within ``folder``; absolute paths and ways out are refused."""
    base = Path(folder).resolve()
    full = (base / path).resolve()
    if Path(path).is_absolute() or not full.is_relative_to(base):
        raise UnsafePathError(f"{path!r} leaves {folder!r}")
    return str(full)


def read_files(spark: SparkSession, root: str, config: Config | None = None, globs: list[str] | None = None) -> DataFrame:
    """(file, content) of the selected files below ``root``, paths relative with forward slashes.

    ``globs`` replace the include and exclude lists. Paths are chosen before any content is read.
    """
    config = config or Config()
    include, exclude = (globs, []) if globs else (config.include or DEFAULT_INCLUDE, config.exclude)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root if "://" in root or root.startswith("file:") else Path(root).resolve().as_uri()
    plain = base.replace("file:///", "file:/").rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    rows = found.select(path.substr(F.lit(len(plain) + 1), F.length(path)).alias("file"), "content")
    hit = lambda gs: F.lit(False) if not gs else F.greatest(*(F.col("file").rlike(glob_regex(g)) for g in gs), F.lit(False))
    return rows.where(hit(include) & ~hit(exclude)).select("file", F.decode("content", "UTF-8").alias("content"))


def from_table(df: DataFrame, content: str, *path: str) -> DataFrame:
    """(file, content) of any table with a text column; the path is made of the named columns and ``.md``."""
    return df.select(F.concat(F.concat_ws("/", *(F.col(c).cast("string") for c in path)), F.lit(".md")).alias("file"), F.col(content).alias("content"))
