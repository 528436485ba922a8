"""Workbooks: one file per task, first sheet, plain cell values."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def first_sheet(content: bytes) -> list[list[str | None]]:
    """Rows of the first sheet as text, header row first."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(MAIN + "si"):
                shared.append("".join(t.text or "" for t in item.iter(MAIN + "t")))
        sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f".//{MAIN}sheet")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links[sheet.get(RELATION)].lstrip("/")
        target = target if target.startswith("xl/") else "xl/" + target
        rows = []
        for row in ElementTree.fromstring(book.read(target)).iter(MAIN + "row"):
            cells: list[str | None] = []
            for cell in row.iter(MAIN + "c"):
                at = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, value = cell.get("t"), cell.find(MAIN + "v")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(MAIN + "t"))
                elif value is not None and value.text is not None:
                    text = value.text
                    cells[at] = shared[int(text)] if kind == "s" else {"1": "true", "0": "false"}[text] if kind == "b" else text
            rows.append(cells)
    return rows


def _header(sheet: list[list[str | None]]) -> list[str]:
    """Names of the first row, as many as the widest row has cells."""
    width, names = max(map(len, sheet), default=0), []
    for i in range(width):
        name = sheet[0][i] if i < len(sheet[0]) and sheet[0][i] is not None else f"column_{i}"
        names.append(name if name not in names else f"{name}_{i}")
    return names


def read_excel(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """First sheet of every workbook matching ``path``, columns matched by name.

    The columns are those of all files, in the order of the files; a name that one sheet repeats gets its position, and so do cells beyond
    the header. Only names reach the driver.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def headers(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                names = _header(first_sheet(bytes(content)))
                yield pd.DataFrame({"path": name, "position": range(len(names)), "name": names})

    seen = files.mapInPandas(headers, "path string, position int, name string")
    found = seen.groupBy("name").agg(F.min(F.struct("path", "position")).alias("at")).orderBy("at").collect()
    if not found:
        raise ValueError(f"No filled workbook at {path}.")
    header = [r["name"] for r in found]
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])

    def rows(batches):
        for batch in batches:
            for content in batch["content"]:
                sheet = first_sheet(bytes(content))
                names = _header(sheet)
                body = pd.DataFrame([r + [None] * (len(names) - len(r)) for r in sheet[1:]], columns=names, dtype=object)
                yield body.reindex(columns=header).astype(object).where(lambda x: x.notna(), None)

    texts = files.mapInPandas(rows, schema)
    if not infer:
        return texts
    from tabloom.sources.coerce import coerce_numbers

    return coerce_numbers(texts)
