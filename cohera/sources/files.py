"""Readers of whole binary files and of text reports; a file is one task's work, many files are spread."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 4096


def _sheet(content: bytes, number: int) -> list[dict[int, str]]:
    """Rows of a sheet as maps from column number to text."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{number}.xml")).iter(f"{ns}row"):
            cells = {}
            for cell in row.iter(f"{ns}c"):
                col = 0
                for letter in re.match("[A-Z]+", cell.get("r"))[0]:
                    col = col * 26 + ord(letter) - 64
                text = "".join(t.text or "" for t in [*cell.iter(f"{ns}v"), *cell.iter(f"{ns}t")])
                cells[col] = shared[int(text)] if cell.get("t") == "s" else text
            rows.append(cells)
    return rows


def workbook(spark: SparkSession, path: str, header_cell: str, sheet: int = 1) -> DataFrame:
    """path, row (from 1 below the header), column, value of .xlsx files. The header is the first row with header_cell in it; without one a file has no rows; empty cells are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                rows = _sheet(content, sheet)
                top = next((k for k, r in enumerate(rows) if header_cell in r.values()), len(rows))
                out = [(p, k - top, rows[top][c], v) for k, r in enumerate(rows) if k > top for c, v in r.items() if v != "" and c in rows[top]]
                yield pd.DataFrame(out, columns=["path", "row", "column", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, row int, column string, value string")


def array_rows(spark: SparkSession, path: str, columns: list[int] | None = None) -> DataFrame:
    """path, row (from 0), values of two-dimensional .npy files, or of some of their columns."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                x = x if columns is None else x[:, columns]
                for at in range(0, len(x), CHUNK):
                    part = x[at : at + CHUNK].astype(float)
                    yield pd.DataFrame({"path": p, "row": np.arange(at, at + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, row long, values array<double>")


def report_fields(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """The groups of a pattern, by name, of every line of text reports that it matches."""
    t = spark.read.text(path).where(F.col("value").rlike(pattern))
    return t.select(*[F.regexp_extract("value", pattern, k + 1).alias(n) for k, n in enumerate(names)])
