"""Directories of unlike CSV files: each with its own header and types, bad files and rows set apart with their reasons.

Files are read in groups of equal headers, so a directory of millions of files with a few headers takes a few reads. Lines
get their numbers in file order from the counts of Spark's own splits (``store.numbered``); the first is the header.
"""

from __future__ import annotations

import csv
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqa.functions.scalar import document_id, table_id
from sparkqa.sources.catalog import clean_headers
from sparkqa.sources.store import numbered

#: Files that are read as tables; bytes of a compressed file that is checked as a whole, at most.
PLAIN, PACKED, MAX_PACKED = ".csv", ".csv.gz", 1 << 30
#: Different headers that a directory may have.
MAX_HEADERS = 1000
FILES = "uri string, path string, file string, length long, header string, reason string"


@dataclass
class Directory:
    """files: uri, path, file, length, header and reason (null for files that are read, though single rows of theirs may be
    refused); tables: one frame per header, cells as text, with source, ids and row number; refused: rows that do not fit
    their header (file, row, line, reason)."""

    files: DataFrame
    tables: list[DataFrame]
    refused: DataFrame

    def types(self) -> DataFrame:
        """(file, column, type): what each file's own cells allow, of bigint, double, boolean and string. One pass; a column
        without values is a string."""
        return reduce(DataFrame.unionByName, [_types(t) for t in self.tables])

    def load(self, file: str) -> DataFrame:
        """The table of one file, in its own types. Files of one name in several folders are one table if their headers are
        equal."""
        held = [t for t in self.tables if not t.where(F.col("__source_file") == file).isEmpty()]
        if len(held) != 1:
            raise ValueError(f"{file}: {'no such table' if not held else 'several tables have this name'}")
        rows = held[0].where(F.col("__source_file") == file)
        kinds = {r["column"]: r["type"] for r in _types(rows).collect()}
        return rows.select(*[F.col(f"`{c}`").cast(kinds.get(c, dict(rows.dtypes)[c])).alias(c) for c in rows.columns])


def _text(column: str) -> Column:
    return F.trim(F.col(f"`{column}`"))


def _types(rows: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if not c.startswith("__")]
    tests = []
    for i, c in enumerate(names):
        holds = [("bigint", _text(c).rlike(r"^[+-]?\d{1,18}$")), ("double", _text(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), ("boolean", F.lower(_text(c)).isin("true", "false"))]
        tests += [F.bool_and(F.when(F.col(f"`{c}`").isNotNull(), test)).alias(f"{kind}_{i}") for kind, test in holds]
    told = rows.groupBy(F.col("__source_file").alias("file")).agg(*tests)
    kind = lambda i: reduce(lambda rest, k: F.when(F.col(f"{k}_{i}"), k).otherwise(rest), ("boolean", "double", "bigint"), F.lit("string"))
    return told.select("file", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), kind(i).alias("type")) for i, c in enumerate(names)])))


def _unpackable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The reasons why gzip files cannot be read to their end; none for the others."""
    def reason(content: bytes) -> str | None:
        left = content
        while left:
            unpack = zlib.decompressobj(31)
            try:
                rest = unpack.decompress(left, 1 << 20)
                while rest or unpack.unconsumed_tail:
                    rest = unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            except zlib.error as e:
                return f"unreadable: {e}"
            if not unpack.eof:
                return "unreadable: truncated"
            left = unpack.unused_data
        return None

    for batch in batches:
        yield pd.DataFrame({"uri": batch["uri"], "broken": [reason(c) for c in batch["content"]]})


def _listing(spark: SparkSession, path: str) -> list[dict]:
    """Files under the folder, with the reasons known before reading them as text. Only compressed ones are opened; a row a
    file comes to the driver, as in Spark's own listing."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    uri, name = F.col("_metadata.file_path").alias("uri"), F.lower(F.col("_metadata.file_name"))
    early = F.when(~name.endswith(PLAIN) & ~name.endswith(PACKED), "extension").when(name.endswith(PACKED) & (F.col("length") > MAX_PACKED), "too large to unpack")
    files = source.select(uri, "path", F.col("_metadata.file_name").alias("file"), "length", early.alias("early"))
    packed = source.where(name.endswith(PACKED) & (F.col("length") <= MAX_PACKED)).select(uri, "content").mapInPandas(_unpackable, "uri string, broken string")
    told = [r.asDict() for r in files.join(packed, "uri", "left").withColumn("reason", F.coalesce("early", "broken")).drop("early", "broken").collect()]
    plain = lambda uri: re.sub(r":/+", ":/", uri, count=1)  # noqa: E731  one or three slashes, as Spark writes them
    known = {plain(r["uri"]) for r in told}
    for uri in source.inputFiles():  # scans leave out files without bytes
        if plain(uri) not in known:
            file = unquote(uri.rsplit("/", 1)[-1])
            told.append({"uri": uri, "path": uri, "file": file, "length": 0, "reason": "empty" if file.lower().endswith((PLAIN, PACKED)) else "extension"})
    return told


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines that are not blank, and their files."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_name").alias("file"))
    return lines.where(F.trim("value") != "")


def read_directory(spark: SparkSession, path: str) -> Directory:
    """All CSV files under a folder (``.csv``, ``.csv.gz``), whatever their headers.

    A file that is no table is listed with its reason (extension, empty, unreadable, no header, no rows) and stops no other;
    a row with more or fewer cells than its header is refused alone. Blank lines are skipped; a quoted cell may not hold a
    line end. Files of the same header are read together, in file order, and told apart by source and ids."""
    listed = _listing(spark, path)
    good = [r for r in listed if r["reason"] is None]
    heads = {}
    if good:
        lines = _lines(spark, [r["path"] for r in good]).withColumn("at", F.monotonically_increasing_id()).withColumn("start", F.col("_metadata.file_block_start"))
        firsts = lines.groupBy("uri").agg(F.min_by("value", F.struct("start", "at")).alias("header"), F.count("*").alias("n"))
        heads = {r.uri: r for r in firsts.collect()}
    groups: dict[str, list[str]] = {}
    for r in listed:
        head = heads.get(r["uri"])
        r["header"] = head.header.removeprefix("﻿") if head else None
        if r["reason"] is None:
            r["reason"] = "empty" if head is None else "no header" if not any(c.strip() for c in next(csv.reader([r["header"]]), [])) else "no rows" if head.n == 1 else None
            if r["reason"] is None:
                groups.setdefault(r["header"], []).append(r["path"])
    if len(groups) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    files = spark.createDataFrame([tuple(r[c.split()[0]] for c in FILES.split(", ")) for r in listed], FILES)
    tables, refused = [], [spark.createDataFrame([], "file string, row long, line string, reason string")]
    for header, paths in sorted(groups.items()):
        rows = _table(spark, header, paths)
        tables.append(rows.where("__bad is null").drop("__bad", "__line"))
        refused.append(rows.where("__bad is not null").select(F.col("__source_file").alias("file"), F.col("__row_number").alias("row"), F.col("__line").alias("line"), F.lit("cells do not fit the header").alias("reason")))
    return Directory(files, tables, reduce(DataFrame.unionByName, refused))


def _table(spark: SparkSession, header: str, paths: list[str]) -> DataFrame:
    names = clean_headers(next(csv.reader([header])))
    lines = numbered(_lines(spark, paths), "__line_number", within="uri").where("__line_number > 1")
    cells = F.from_csv("value", _ddl(names), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    document = document_id(F.col("file"))
    return lines.select(
        F.col("value").alias("__line"), cells.alias("_c"), F.col("file").alias("__source_file"), document.alias("__document_id"), table_id(document, F.lit(None).cast("string")).alias("__table_id"), (F.col("__line_number") - 1).alias("__row_number"),
    ).select(*[F.col(f"_c.`{n}`") for n in [*names, "__bad"]], "__line", "__source_file", "__document_id", "__table_id", "__row_number")


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, "__bad"])
