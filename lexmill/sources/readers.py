"""Readers of text collections in the formats they come in (SC01-SC13)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import portable as P
from lexmill.functions import text as X

POSTS = "id string, text string, country string, province string"


def expect(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df``, failing the query where a row breaks the condition. The check is a filter, so that it is never pruned."""
    return df.filter(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit(message)).isNull())


def read_posts(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Posts of several tab-separated files without quoting; a file may lack the last column, a row with fewer than three fields fails."""
    out = None
    for source, path in files.items():
        rows = spark.read.option("sep", "\t").option("quote", "").option("header", True).option("enforceSchema", True).schema(POSTS).csv(path)
        rows = expect(rows, F.col("country").isNotNull(), f"{source}: a row with fewer than three fields").withColumn("source", F.lit(source))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, nadi_source string, train_id string, aldi_score double, " + ", ".join(f"{d} int" for d in P.DIALECTS)
    return spark.read.option("header", True).schema(schema).csv(path)


def read_wide_labels(spark: SparkSession, path: str, text: str = "sentence") -> DataFrame:
    """(text, dialect, valid) of a wide y/n table."""
    rows = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)
    dialects = [c for c in rows.columns if c != text]
    return rows.unpivot([text], dialects, "dialect", "v").select(F.col(text).alias("text"), "dialect", (F.col("v") == "y").cast("int").alias("valid"))


def read_sentiment(spark: SparkSession, path: str, labels: dict[str, str], schema: str, header: bool = True, text: str = "text", label: str = "sentiment") -> DataFrame:
    """A sentiment table in CSV, its labels mapped; an unknown label fails the query, a blank number is NaN, a byte-order mark goes."""
    rows = spark.read.option("header", header).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    mapped = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col(label)]
    rows = expect(rows.withColumn("_label", mapped), F.col("_label").isNotNull(), "an unknown label").withColumn(label, F.col("_label")).drop("_label")
    for name, kind in rows.dtypes:
        if kind == "double":
            rows = rows.withColumn(name, F.coalesce(name, F.lit(float("nan"))))
    return rows.withColumn(text, F.regexp_replace(text, "^\\x{feff}", ""))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines that have a text."""
    return spark.read.schema(schema).json(path).filter("text is not null and text <> ''")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct duplicate keys of a reference set, of JSON lines or of the first column of a tab-separated file."""
    if path.endswith((".jsonl", ".json")):
        rows = spark.read.schema("text string").json(path)
    else:
        rows = spark.read.option("sep", "\t").option("quote", "").csv(path).select(F.col("_c0").alias("text"))
    return rows.select(X.dedup_key("text").alias("key")).filter("key <> ''").distinct()


def read_parallel(df: DataFrame, varieties: list[str], pivot: str) -> DataFrame:
    """(row, variety, text, pivot) of a wide parallel table; empty cells are left out."""
    return df.unpivot([*{pivot, *[c for c in df.columns if c not in varieties]}], [v for v in varieties if v != pivot], "variety", "text").filter("text is not null and trim(text) <> ''")


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(label, text) of lines of a label, a tab and a text; a file in an encoding other than UTF-8 is decoded in one task."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        rows = spark.read.text(path).select(F.col("value").alias("v"))
    else:

        def decoded(batches):
            for b in batches:
                yield pd.DataFrame({"v": [line for c in b["content"] for line in bytes(c).decode(encoding).splitlines()]}, dtype=object)

        rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decoded, "v string")
    return rows.filter("v <> ''").select(F.split("v", "\t", 2)[0].alias("label"), F.split("v", "\t", 2)[1].alias("text"))


def _parts(book: zipfile.ZipFile, name: str, *wanted: str) -> Iterator[ElementTree.Element]:
    """The elements of these names of a part of a workbook, each when it ends and is then dropped, so that large parts aren't held."""
    if name in book.NameToInfo:
        with book.open(name) as part:
            for _, e in ElementTree.iterparse(part):
                e.tag = e.tag.rpartition("}")[2]
                if e.tag in wanted:
                    yield e
                    e.clear()


def _said(e: ElementTree.Element) -> str:
    """The text of a string's runs, without how it is read aloud."""
    return "".join(t.text or "" for child in e if child.tag != "rPh" for t in ([child] if child.tag == "t" else child) if t.tag == "t")


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook, cells as text and missing ones empty, in the order of its sheets."""
    book = zipfile.ZipFile(io.BytesIO(content))
    strings = [_said(e) for e in _parts(book, "xl/sharedStrings.xml", "si")]
    files = {e.get("Id"): PurePosixPath("/xl", e.get("Target")).as_posix()[1:] for e in _parts(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    sheets = [(e.get("name"), next(v for k, v in e.items() if k.endswith("}id"))) for e in _parts(book, "xl/workbook.xml", "sheet")]
    for sheet, key in sheets:
        line, row, value = 0, [], ""
        for e in _parts(book, files[key], "v", "is", "c", "row"):
            if e.tag == "v":
                value = e.text or ""
            elif e.tag == "is":
                value = _said(e)
            elif e.tag == "c":
                letters = e.get("r", "").rstrip("0123456789")
                column = reduce(lambda n, ch: 26 * n + int(ch, 36) - 9, letters, 0) or len(row) + 1
                row += [""] * (column - len(row))
                row[column - 1] = strings[int(value)] if e.get("t") == "s" and value else value
                value = ""
            else:
                yield sheet, line, row
                line, row = line + 1, []


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of workbooks, each read in one task, a row at a time."""

    def parse(batches):
        for b in batches:
            rows = [(p, *r) for p, c in zip(b["path"], b["content"]) for r in workbook_rows(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, sheet string, row int, cells array<string>")


def first_rows(df: DataFrame, ident: str, n: int) -> DataFrame:
    """The rows of a trial run: the first numbers, the same every time."""
    return df.filter(F.col(ident) < n)
