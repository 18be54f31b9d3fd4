"""Sources and sinks: texts with headings, tables with sniffed dialects, Word files, content-addressed blobs."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.documents import map_headers
from strandline.runtime import ship

MAGIC = {"pdf": b"%PDF", "docx": b"PK\x03\x04", "png": b"\x89PNG"}
ALLOWED = ("txt", "md", "csv", "json", "pdf", "docx", "png", "jpg")
MAX_BYTES = 100 << 20


def binary(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length, extension, content) of every file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return f.select("path", "length", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), "content")


def problem(extension: Column, length: Column, content: Column) -> Column:
    """Why a file is refused, or null: extension, emptiness, size, leading bytes, text that is no UTF-8."""
    magic = F.lit(None).cast("string")
    for kind, head in MAGIC.items():
        magic = F.when((extension == kind) & (F.substring(content, 1, len(head)) != F.lit(head)), "content does not match its extension").otherwise(magic)
    return (
        F.when(~extension.isin(*ALLOWED), "extension not allowed").when(length == 0, "empty").when(length > MAX_BYTES, "too large").otherwise(magic)
    )


def accept(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files to ingest: without a problem, not stored yet, one of each content."""
    good = files.filter(problem(F.col("extension"), F.col("length"), F.col("content")).isNull()).withColumn("content_hash", F.sha2("content", 256))
    return good.join(stored.select("content_hash").distinct(), "content_hash", "left_anti").dropDuplicates(["content_hash"])


def decode(content: Column) -> Column:
    """UTF-8 where it is, else Latin-1; a byte order mark goes."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def text_blocks(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, level, section, line) of Markdown or plain text; headings are carried forward, ATX or numbered."""
    lines = files.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("line_no", "line"))
    atx = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    numbered = F.col("line").rlike(r"^\d+(\.\d+)*\.?\s+[A-Z][^.]{3,59}$")
    level = F.when(atx != "", F.length(atx)).when(numbered, F.size(F.split(F.regexp_extract("line", r"^(\d+(?:\.\d+)*)", 1), r"\.")))
    titled = lines.withColumn("level", level).withColumn("title", F.when(F.col("level").isNotNull(), F.trim(F.regexp_replace("line", r"^(#+|\d+(\.\d+)*\.?)\s+", ""))))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    place = {}
    for n in (1, 2, 3):
        # the last heading of a level counts until a higher one comes
        last = F.last(F.when(F.col("level") <= n, F.struct("level", "title")), ignorenulls=True).over(w)
        place[n] = F.when(last["level"] == n, last["title"])
    return titled.select(key, "line_no", "level", F.concat_ws(" > ", place[1], place[2], place[3]).alias("section"), "line")


def sniff(header: str) -> str:
    """The separator that cuts a header line into most fields."""
    return max(",;\t|", key=lambda s: header.count(s))


def records_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files under canonical names; lines that start with # are comments."""
    first = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).first()
    rows = spark.read.option("header", True).option("comment", "#").option("sep", sniff(first["value"] if first else ",")).csv(path)
    return map_headers(rows)


def records_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON file: a list, an object with records, items, rows or data, or one object."""
    rows = spark.read.option("multiLine", True).json(path)
    for name in ("records", "items", "rows", "data"):
        if name in rows.columns:
            return map_headers(rows.select(F.explode(name).alias("r")).select("r.*"))
    return map_headers(rows)


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """(path, n, style, text) of Word files; tables come as one row of cells joined by a bar."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(bytes(content))).read("word/document.xml"))
                except (KeyError, zipfile.BadZipFile, ET.ParseError) as e:
                    rows.append((path, -1, "warning", f"not readable: {type(e).__name__}"))
                    continue
                n = 0
                for node in root.find(f"{word}body"):
                    if node.tag == f"{word}p":
                        style = node.find(f"{word}pPr/{word}pStyle")
                        rows.append((path, n, style.get(f"{word}val") if style is not None else "", "".join(t.text or "" for t in node.iter(f"{word}t"))))
                        n += 1
                    elif node.tag == f"{word}tbl":
                        for tr in node.iter(f"{word}tr"):
                            rows.append((path, n, "table", " | ".join("".join(t.text or "" for t in tc.iter(f"{word}t")) for tc in tr.iter(f"{word}tc"))))
                            n += 1
            yield pd.DataFrame(rows, columns=["path", "n", "style", "text"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, n int, style string, text string")


def store(blobs: DataFrame, path: str) -> None:
    """Content-addressed write: one folder a hash prefix, one row a content."""
    out = blobs.withColumn("prefix", F.substring("content_hash", 1, 2)).dropDuplicates(["content_hash"])
    out.write.mode("append").partitionBy("prefix").parquet(path)


def capabilities(spark: SparkSession) -> DataFrame:
    """What optional stages can run here; a missing one says what it needs."""
    import importlib.util

    needs = [("pdf", "pdfplumber"), ("ocr", "pytesseract"), ("drawing_raster", "cv2"), ("embedding_model", "onnxruntime"), ("docx", "zipfile")]
    rows = []
    for name, module in needs:
        there = importlib.util.find_spec(module) is not None
        state = "available" if there and name != "embedding_model" else "not_configured"
        rows.append((name, state, "" if state == "available" else f"needs {module}" + (" and a model file" if name == "embedding_model" else "")))
    return spark.createDataFrame(rows, "capability string, state string, requires string")


def heading_level(style: str) -> int:
    m = re.match(r"[Hh]eading\s*(\d)", style or "")
    return int(m.group(1)) if m else 0
