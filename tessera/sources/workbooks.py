"""Workbooks as sparse relations: XLSX files read as binary rows and opened inside tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CELLS = "path string, sheet string, row int, col int, value_type string, raw string, formula string, status string"
_REF = re.compile(r"([A-Z]+)([0-9]+)")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def cells_of(path: str, content: bytes) -> Iterator[tuple]:
    """Filled cells of all sheets; a file that cannot be opened is one row with its status."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_texts(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
        for s in sheets:
            target = rels[next(v for k, v in s.attrib.items() if _local(k) == "id")]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for _, c in ElementTree.iterparse(io.BytesIO(book.read(part))):
                if _local(c.tag) != "c":
                    continue
                kind, raw, formula = c.get("t", "n"), None, None
                for x in c:
                    if _local(x.tag) == "v":
                        raw = x.text
                    elif _local(x.tag) == "f":
                        formula = x.text or ""
                    elif _local(x.tag) == "is":
                        raw = _texts(x)
                if kind == "s" and raw is not None:
                    raw = shared[int(raw)]
                if raw is None and formula is None:
                    continue
                letters, number = _REF.fullmatch(c.get("r")).groups()
                name = {"b": "boolean", "e": "error", "n": "decimal"}.get(kind, "string")
                yield path, s.get("name"), int(number), column_number(letters), "blank" if raw is None else name, raw, formula, "ok"
                c.clear()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError, AttributeError, StopIteration) as e:
        yield path, None, None, None, None, None, None, f"unreadable: {type(e).__name__}"


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, col, value_type, raw, formula, status of every filled cell of every XLSX file below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
        names = [x.split()[0] for x in CELLS.split(", ")]
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = list(cells_of(p, content.as_py()))
                for lo in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 20_000], strict=True), types, strict=True)], names=names)

    return files.mapInArrow(run, CELLS)
