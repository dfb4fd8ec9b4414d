"""Corpus: rows and markdown as text, extracted documents as lines, section chunks, the recursive text splitter."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkqa.functions.scalar import is_amount
from sparkqa.plans.plan import INTERNAL


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Adds ``text``: "column: value" lines of the cells that are not null; rows without any are dropped."""
    names = list(columns or [c for c in df.columns if c not in INTERNAL])
    lines = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in names]
    return df.withColumn("text", F.concat_ws("\n", *lines)).where(F.length("text") > 0)


def described_rows(df: DataFrame, description: str, row: str) -> DataFrame:
    """(text, metadata, row): the trimmed description and the other columns as a map of strings; blanks are dropped."""
    others = [c for c in df.columns if c not in (description, row, *INTERNAL)]
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in others]), F.array(*[F.col(f"`{c}`").cast("string") for c in others]))
    return df.select(F.trim(F.col(description)).alias("text"), pairs.alias("metadata"), F.col(row).alias("row")).where("text <> ''")


def flatten_tables(markdown: Column) -> Column:
    """Pipe table lines as text: cells trimmed, empty and dashed ones dropped, equal neighbours joined; a last cell that
    is an amount follows its neighbour after a colon. Lines that come out empty go, other lines stay as they are."""

    def collapse(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: (c != "") & ~c.rlike(r"^[-: ]+$"))
        cells = F.filter(cells, lambda c, i: (i == 0) | (c != F.get(cells, i - 1)))
        n = F.size(cells)
        amount = (n >= 2) & is_amount(F.get(cells, n - 1))
        pair = F.concat(F.get(cells, n - 2), F.lit(": "), F.get(cells, n - 1))
        return F.when(amount, pair).otherwise(F.array_join(cells, " | "))

    lines = F.transform(F.split(markdown, "\n"), lambda x: F.when(F.contains(x, F.lit("|")), F.nullif(collapse(x), F.lit(""))).otherwise(x))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def document_names(items: DataFrame, fields: Sequence[str], position: str) -> DataFrame:
    """Distinct document names in first-seen order; the first of ``fields`` that is not blank names an item."""
    name = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in fields])
    return items.select(name.alias("name"), position).where("name is not null").groupBy("name").agg(F.min(position).alias("first")).orderBy("first")


# Extracted documents

#: Lines that are layout, and the headings that open a section.
IGNORED = [
    "DoclingDocument", "application/pdf", "application/octet-stream", "TOPLEFT", "BOTTOMLEFT", "TOPRIGHT", "BOTTOMRIGHT", "unspecified", "picture",
    "table", "text", "group", "body", "page_footer", "key_value_area", "furniture", "*root*", "rot_0",
]
SECTIONS = {
    "account summary": "account_summary", "deposits": "deposits", "atm withdrawals": "atm_withdrawals", "checks paid": "checks_paid",
    "statement date": "statement_information", "commerce bank": "bank_information", "primary account": "account_information",
}


def string_leaves(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, pos, line): every string of a JSON document in its order, whatever the depth; what is no JSON gives nothing."""

    def leaves(value: object) -> Iterator[str]:
        stack = [value]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif isinstance(x, dict):
                stack.extend(reversed(x.values()))
            elif isinstance(x, list):
                stack.extend(reversed(x))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[content], strict=True):
                try:
                    out.extend((k, i, s) for i, s in enumerate(leaves(json.loads(text))))
                except (TypeError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(out, columns=[key, "pos", "line"])

    return docs.select(key, content).mapInPandas(walk, f"`{key}` {dict(docs.dtypes)[key]}, pos int, line string")


def kept_lines(lines: DataFrame) -> DataFrame:
    """Lines trimmed; without those of one character, layout words and references."""
    line = F.trim(F.col("line"))
    good = (F.length(line) >= 2) & ~line.isin(*IGNORED) & ~line.startswith("#/") & ~line.rlike(r"^texts/\d+$")
    return lines.withColumn("line", line).where(good)


def first_seen(lines: DataFrame, key: str) -> DataFrame:
    """Each line once per document, at its first position. Repeats meet in a min before the shuffle."""
    return lines.groupBy(key, "line").agg(F.min("pos").alias("pos"))


def section_chunks(lines: DataFrame, key: str, document_type: str = "document") -> DataFrame:
    """(key, chunk_no, id, section, document_type, text): a line with a heading opens a chunk of its section, other lines
    join the chunk before; the first section is ``general``. One document's lines are ordered in one task."""
    section = reduce(lambda w, s: w.when(F.contains(F.lower("line"), F.lit(s[0])), s[1]), list(SECTIONS.items())[1:], F.when(F.contains(F.lower("line"), F.lit(next(iter(SECTIONS)))), next(iter(SECTIONS.values()))))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("_section", section).withColumn("_no", F.count("_section").over(order))
    chunks = numbered.groupBy(key, "_no").agg(
        F.coalesce(F.first("_section", ignorenulls=True), F.lit("general")).alias("section"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    number = F.row_number().over(Window.partitionBy(key).orderBy("_no"))
    return chunks.select(key, number.alias("chunk_no"), F.concat(F.lit("chunk_"), number.cast("string")).alias("id"), "section", F.lit(document_type).alias("document_type"), "text")


# Splitter

SEPARATORS, SIZE, OVERLAP = ("\n\n", "\n", " ", ""), 700, 100


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters (a piece that no separator divides may be longer), which repeat at most
    ``overlap`` of what is before. The first separator that occurs divides the text and stays before what follows."""
    at = next(i for i, s in enumerate(separators) if s in text)
    mark, rest = separators[at], separators[at + 1 :]
    parts = text.split(mark) if mark else list(text)
    parts = [p for p in [parts[0], *(mark + p for p in parts[1:])] if p] if mark else parts
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        if len(part) < size:
            held.append(part)
            continue
        out += merge_parts(held, size, overlap)
        held = []
        out += split_text(part, size, overlap, rest) if rest else [part]
    return out + merge_parts(held, size, overlap)


def merge_parts(parts: Sequence[str], size: int, overlap: int) -> list[str]:
    """Neighbouring parts joined up to ``size``; each chunk starts with the last parts of the one before, up to ``overlap``."""
    out, held, total = [], [], 0
    for part in parts:
        if held and total + len(part) > size:
            if chunk := "".join(held).strip():
                out.append(chunk)
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if chunk := "".join(held).strip():
        out.append(chunk)
    return out


def split_documents(docs: DataFrame, key: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, keep: Sequence[str] = ()) -> DataFrame:
    """(key, chunk_no, content and the columns to keep), narrow: a document is split where it lies. Arrow batches are
    bounded by bytes, so a batch of long documents stays small."""
    spark = docs.sparkSession
    bytes_key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(bytes_key).rstrip("b")) > 4 << 20:
        spark.conf.set(bytes_key, str(4 << 20))
    columns = [key, *keep]
    kinds = dict(docs.dtypes)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chunks = [split_text(t, size, overlap) if t else [] for t in batch[text]]
            rows = batch[columns].loc[batch.index.repeat([len(c) for c in chunks])].reset_index(drop=True)
            rows["chunk_no"] = [i for c in chunks for i in range(len(c))]
            rows["content"] = [x for c in chunks for x in c]
            yield rows

    return docs.select(*columns, text).mapInPandas(split, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "chunk_no int, content string"]))


def corpus_chunks(tables: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, content) of both kinds of source: rows of tables stay whole, documents are split."""
    whole = tables.select(F.col("doc_id"), F.lit(0).alias("chunk_no"), F.col("text").alias("content"))
    return whole.unionByName(split_documents(docs, "doc_id"))
