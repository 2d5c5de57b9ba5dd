"""Trees of text files: scanning, decoding, joining, writing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .tree import list_tree, local_root, read_contents, write_one_file, write_tree

ENCODINGS = ("utf-8", "gb18030")


def _empty_files(files: DataFrame) -> DataFrame:
    """Files of zero bytes: Spark lists them but leaves them out of a scan.

    Names come to the driver only if there are such files.
    """
    if len(files._jdf.inputFiles()) == files.count():
        return files.limit(0)
    uri = F.url_decode(F.regexp_replace("uri", "\\+", "%2B"))
    listed = files.sparkSession.createDataFrame([(u,) for u in files.inputFiles()], "uri string")
    paths = listed.select(F.regexp_replace(uri, "^file:/+", "file:/").alias("path"))
    missing = paths.join(files.select("path"), "path", "left_anti")
    return missing.withColumn("content", F.lit("").cast("binary"))


def scan_books(spark: SparkSession, root: str, suffix: str = ".txt",
               keep_empty: bool = True) -> DataFrame:
    """Files below ``root`` whose names end in ``suffix`` (case-sensitive), with relative paths.

    A tree on a mount is listed and read by tasks. In other stores Spark lists the files on the driver;
    there names that begin with a dot or an underscore are hidden, and empty files are added from that
    listing. ``keep_empty`` leaves empty files out if off.
    """
    root = root.rstrip("/")
    if "/" not in root[:1] and ":" not in root:
        raise ValueError("give the root as an absolute path or URI")
    mount = local_root(spark, root)
    if mount is not None:
        listed = list_tree(spark, mount, suffix)
        read = read_contents(listed if keep_empty else listed.where("length > 0"), mount)
        return _named(read.withColumn("path", F.concat(F.lit(f"file:{mount}/"), "rel_path")))
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}").load(root).select("path", "content")
    )
    if keep_empty:
        files = files.unionByName(_empty_files(files))
    start = F.locate(f"{root}/", F.col("path")) + len(root) + 1
    return _named(files.withColumn("rel_path", F.substring("path", start, F.length("path"))))


def _named(rel: DataFrame) -> DataFrame:
    return rel.select(
        "path", F.regexp_replace("rel_path", "/?[^/]*$", "").alias("dir"), "rel_path",
        F.substring_index("rel_path", "/", -1).alias("file_name"), "content")


def _lenient(encodings: tuple[str, ...]):
    """Arrow function for bytes that are not UTF-8; rows that are arrive as null and stay null."""
    def one(raw: bytes) -> dict:
        if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return {"text": raw.decode("utf-16", "ignore"), "encoding": "utf-16"}
        for name in encodings:
            try:
                return {"text": raw.decode(name), "encoding": name}
            except UnicodeDecodeError:
                continue
        return {"text": raw.decode("utf-8", "ignore"), "encoding": "utf-8"}

    shape = pa.struct([("text", pa.string()), ("encoding", pa.string())])

    def batches(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in contents:
            yield pa.array([None if c is None else one(c) for c in batch.to_pylist()], shape)

    batches.__annotations__ = {"contents": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = T.StructType().add("text", "string").add("encoding", "string")
    return F.arrow_udf(batches, out)


def decode_books(df: DataFrame, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """Replace ``content`` by ``text`` and ``encoding``.

    Valid UTF-8 is decoded by Spark itself; only the other files pass through Python, which tries
    the encodings strictly and at last drops undecodable bytes. Line breaks become ``\\n``.
    """
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    other = _lenient(encodings)(F.when(~valid, F.col("content")))
    decoded = df.withColumn("_other", other)
    text = F.coalesce("_other.text", F.col("content").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return decoded.select(
        *[c for c in df.columns if c != "content"], plain.alias("text"),
        F.coalesce("_other.encoding", F.lit("utf-8")).alias("encoding"))


def unreadable(df: DataFrame) -> DataFrame:
    """Paths of scanned files that are not UTF-8; the joined corpus leaves them out."""
    return df.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("rel_path")


def readable(df: DataFrame) -> DataFrame:
    """The scanned files that are UTF-8, with their text."""
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    good = df.where(F.is_valid_utf8(F.col("content").cast("string")))
    return good.withColumn("text", text).drop("content")


def _in_order(df: DataFrame) -> DataFrame:
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    return df.orderBy(depth.desc(), "dir", "file_name")


def concat_corpus(df: DataFrame) -> DataFrame:
    """Every book followed by one line break, deepest directories first, in a total order."""
    return _in_order(df.withColumn("text", F.concat("text", F.lit("\n"))))


def write_corpus(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write the joined corpus; its part files follow the order. One file, ``corpus.txt``, only on request.

    The sink itself ends every book with the line break. On a mount many tasks write the one file; in
    other stores, which take a file from one writer only, one task does.
    """
    texts = _in_order(df).select("text")
    mount = local_root(df.sparkSession, path)
    if single_file and mount is not None:
        write_one_file(texts, f"{mount}/corpus.txt")
    else:
        (texts.coalesce(1) if single_file else texts).write.text(path, lineSep="\n")


def write_books(df: DataFrame, root: str, by_dir: bool = False, as_files: bool = False) -> None:
    """Cleaned books keyed by relative path, as text below one folder per directory, or as one file each.

    ``as_files`` mirrors the tree: every book is a UTF-8 file under its relative path. The input is never deleted. Ranges of directory and path keep small directories in one file and
    spread a huge one over many.
    """
    if as_files:
        write_tree(df, root)
    elif by_dir:
        ranged = df.repartitionByRange("dir", "rel_path").select("dir", "text")
        ranged.write.partitionBy("dir").text(root, lineSep="\n")
    else:
        df.select("rel_path", "text").write.parquet(root)
