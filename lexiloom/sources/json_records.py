"""JSON sources: dialogues, framed multi-line objects, instruction records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.index import with_row_index
from .lines import positioned_lines
from .structure import with_counts, with_structure

MATHS_KEYS = ("original_text", "equation", "ans")


def read_dialogues(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """``file, conv_id, utterances``.

    ``array``: a file is one JSON array of arrays; values of other kinds are no conversations. ``lines``: one
    conversation per line. Either way files are read in splits, and ``conv_id`` counts the conversations of a
    file from 0, however the file is split.
    """
    if layout == "lines":
        lines = positioned_lines(spark, path)
        numbered = with_row_index(lines.where(F.trim("value") != "").select("file", "block", "pos", "value"),
                                  ["block", "pos"], "conv_id", ["file"])
        return numbered.select("file", "conv_id", F.from_json("value", "array<string>").alias("utterances"))
    if layout != "array":
        raise ValueError(f"layout must be array or lines, not {layout}")
    found = _elements(spark, path, "]")
    return found.select("file", F.col("element").alias("conv_id"),
                        F.from_json(_last(F.col("body"), "["), "array<string>").alias("utterances"))


def _strings(parsed: Column, keys: Sequence[str]) -> tuple[Column, dict[str, Column]]:
    """Whether exactly one object with text under every key was parsed, and those texts."""
    alone = parsed.isNotNull() & F.try_variant_get(parsed, "$[1]", "variant").isNull()
    fields = {}
    for key in keys:
        field = F.try_variant_get(parsed, f"$[0].{key}", "variant")
        alone = alone & F.coalesce(F.schema_of_variant(field) == "STRING", F.lit(False))
        fields[key] = F.try_variant_get(parsed, f"$[0].{key}", "string")
    return alone, fields


def read_framed_json(spark: SparkSession, path: str | Sequence[str],
                     keys: Sequence[str] = MATHS_KEYS) -> DataFrame:
    """Objects written one after another over several lines: ``file, frame, <keys>, _corrupt``.

    A line that begins with a brace opens a frame; a line that ends with one closes a record of the frame
    or fails to. Only the first close outside strings and brackets can end an object, so all lines up to it
    are parsed, once. Any other close gives a row of its own with the lines since the close before in
    ``_corrupt``, as does an object without text under all keys. Files are read in splits, and lines meet only
    once the borders of their record are known.
    """
    begins, closes = F.col("value").rlike(r"(?U)^\s*\{"), F.col("value").rlike(r"(?U)\}\s*$")
    lines = with_structure(positioned_lines(spark, path), begins, F.col("value"), closes)
    # Before the first opening line nothing can parse.
    whole = closes & ~F.col("in_string") & (F.col("depth") == 0) & (F.col("frame") > 0)
    # Lines between two closes are a segment; what no close follows belongs to none.
    segments = lines.groupBy("file_id", "frame", "n_flag").agg(
        F.first("file").alias("file"), F.array_sort(F.collect_list(F.struct("block", "pos", "value"))).alias("ls"),
        F.max(closes).alias("closed"), F.min("n_flag").alias("number"), F.max(whole).alias("whole")).where("closed")
    segments = segments.select("file_id", "file", "frame", "number", F.array_join("ls.value", "\n").alias("body"), "whole")
    # Most records are one segment. Others begin with segments whose closes have failed, and end with the first whole one.
    same = Window.partitionBy("file_id", "frame")
    rest = segments.where("not (whole and number = 0)").select(
        "*", F.min("number").over(same).alias("least"), F.min(F.when(F.col("whole"), F.col("number"))).over(same).alias("end"))
    longer = rest.where("least = 0 and number <= end").groupBy("file_id", "frame").agg(
        F.first("file").alias("file"), F.array_join(F.array_sort(F.collect_list(F.struct("number", "body")))["body"], "\n")
        .alias("body")).select("file", "frame", "body")
    tried = segments.where("whole and number = 0").select("file", "frame", "body").unionByName(longer)
    # Inside brackets the parser must reach the end of the text.
    parsed = tried.withColumn("_v", F.try_parse_json(F.concat(F.lit("["), "body", F.lit("]"))))
    good, fields = _strings(F.col("_v"), keys)
    records = parsed.select("file", "frame", *[F.when(good, v).alias(k) for k, v in fields.items()],
                            F.when(~good, F.col("body")).alias("_corrupt"))
    nothing = [F.lit(None).cast("string").alias(k) for k in keys]
    failed = rest.where("not (least = 0 and number <=> end)").select("file", "frame", *nothing, F.col("body").alias("_corrupt"))
    return records.unionByName(failed)


def _elements(spark: SparkSession, path: str | Sequence[str], close: str, glob: str | None = None) -> DataFrame:
    """``file, element, body``: the values that end with ``close``, straight below the root, of files that are one
    JSON array, or the root of files that are one object.

    Files are read in splits cut at ``close``, whether it ends a value or stands in a string; ``element`` grows along
    the file. Values of other kinds come at the front of the body of the next one. A file that is not whole is an error.
    """
    pieces = positioned_lines(spark, path, close, glob)
    state = with_structure(pieces, F.lit(False), F.concat("value", F.lit(close)))
    root = F.when(F.col("object_file"), 0).otherwise(1)
    ended = with_counts(state.withColumn("end", ~F.col("in_string") & (F.col("depth") == root)), ["end"])
    grouped = ended.groupBy("file_id", F.col("n_end").alias("element")).agg(
        F.first("file").alias("file"), F.array_sort(F.collect_list(F.struct("block", "pos", "value"))).alias("ls"), F.max("end").alias("whole"),
        F.max("broken").alias("broken"), F.max("object_file").alias("object_file")).where("whole or broken")
    text = F.concat(F.array_join("ls.value", close), F.lit(close))
    inner = F.when(F.col("object_file"), text).otherwise(F.regexp_replace(text, r"^﻿?\s*[\[,]\s*", ""))
    error = F.raise_error(F.concat(F.lit("not whole JSON: "), "file"))
    return grouped.select("file", "element", F.when(F.col("broken"), error).otherwise(inner).alias("body"))


def _last(body: Column, opening: str) -> Column:
    """The body itself, or its last value where others come before it."""
    values = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")
    return F.when(F.startswith(body, F.lit(opening)), body).otherwise(F.element_at(values, -1))


def instruction_schema(list_output: bool) -> T.StructType:
    output = T.ArrayType(T.StringType()) if list_output else T.StringType()
    return (T.StructType().add("instruction", "string").add("input", "string")
            .add("output", output))


def list_json(spark: SparkSession, dirs: str | Sequence[str], schema: T.StructType,
              layout: str = "array", glob: str | None = "*.json") -> DataFrame:
    """Records of the files directly inside the directories whose names fit ``glob``.

    ``array``: a file is one array of objects, or one object, and is read in splits. ``lines``: one object a line.
    """
    if layout == "lines":
        return spark.read.schema(schema).json(dirs, pathGlobFilter=glob)
    if layout != "array":
        raise ValueError(f"layout must be array or lines, not {layout}")
    body = _last(F.col("body"), "{")
    return _elements(spark, dirs, "}", glob).select(F.from_json(body, schema).alias("record")).select("record.*")
