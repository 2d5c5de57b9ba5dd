"""Line sources and dispatch on the file extension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = _BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a counted table; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def positioned_lines(spark: SparkSession, paths: str | Sequence[str], end: str = "\n",
                     glob: str | None = None) -> DataFrame:
    """``file, block, file_size, pos, value``: lines, or what else ``end`` ends, of splittable files with their place."""
    lines = spark.read.text(paths, lineSep=end, pathGlobFilter=glob)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def _unended(lines: DataFrame) -> DataFrame:
    """Place of the last line of every file that does not end in a line break.

    The bytes of such a file's lines, each counted with a break, exceed its size by one (three less
    where a byte-order mark was skipped).
    """
    files = lines.groupBy("file").agg(
        F.max(F.struct("block", "pos")).alias("last"),
        (F.sum(F.octet_length("value") + 1) - F.max("file_size")).alias("excess"))
    return files.where(F.col("excess").isin(1, -2)).select("file", "last.*", F.lit(True).alias("open"))


def _pieces(text: Column) -> Column:
    """Old-style line breaks inside a line end rows as well."""
    unified = F.regexp_replace(text, "\r\n?", "\n")
    many = F.filter(F.split(unified, "(?<=\n)"), lambda p: p != "")
    return F.when(F.contains(text, F.lit("\r")), many).otherwise(F.array(text))


def read_lines(spark: SparkSession, paths: str | Sequence[str],
               keep_linebreaks: bool = True) -> DataFrame:
    """One row per line, with its line break if asked for. Large files are read in splits."""
    if not keep_linebreaks:  # whether the last line has one makes no difference
        whole = F.concat("value", F.lit("\n"))
        rows = spark.read.text(paths, lineSep="\n").select(F.explode(_pieces(whole)).alias("text"))
        return rows.select(F.regexp_replace("text", "\n$", "").alias("text"))
    lines = positioned_lines(spark, paths)
    opened = broadcast_if_small(_unended(lines))
    ended = lines.join(opened, ["file", "block", "pos"], "left")
    text = F.when(F.col("open"), F.col("value")).otherwise(F.concat("value", F.lit("\n")))
    return ended.select(F.explode(_pieces(text)).alias("text"))


def read_any(spark: SparkSession, paths: Sequence[str], keep_linebreaks: bool = True,
             **options: str) -> DataFrame:
    """Read files in the format their extension names; different extensions are refused."""
    kinds = {p.rsplit("/", 1)[-1].rsplit(".", 1)[-1] for p in paths}
    if len(kinds) != 1:
        raise ValueError(f"files of one format expected, not {sorted(kinds)}")
    kind = kinds.pop()
    if kind == "txt":
        return read_lines(spark, list(paths), keep_linebreaks)
    defaults = {"header": "true", "multiLine": "true", "escape": '"'} if kind == "csv" else {}
    return spark.read.format(kind).options(**{**defaults, **options}).load(list(paths))


def text_column(df: DataFrame) -> str:
    return "text" if "text" in df.columns else df.columns[0]


def as_text(df: DataFrame) -> DataFrame:
    return df.select(F.col(text_column(df)).alias("text"))
