"""Excel workbooks (.xlsx) as sheet catalogues and typed datasets.

Files are loaded with the ``binaryFile`` source and each workbook is parsed
inside ``mapInPandas`` with the standard library (zip + XML): a directory of
workbooks is read in parallel, one task per file.  Cells come out as long
rows ``(path, sheet, row, col, value, formula_uncached)``; Spark pivots them
into ``f1..fn`` for one sheet.  Values are text, typed later like CSV cells.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import re
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.dataset import Dataset, DatasetError

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
# Built-in number formats that display dates, the limits of
# the import path and the preview shape (they must equal the reference's).
DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}
MAX_COLUMNS = 1000
EXPANSION_FACTOR = 20
PREVIEW_ROWS, PREVIEW_COLS, PREVIEW_CHARS = 5, 8, 120
DEFAULT_UPLOAD_BYTES = 50 * 1024 * 1024
EPOCH = dt.datetime(1899, 12, 30)

CATALOG_SCHEMA = ("path string, sheet string, position int, rows int, columns int, hidden boolean, "
                  "expanded_bytes long, preview string")
CELL_SCHEMA = "path string, sheet string, row int, col int, value string, formula_uncached boolean"


def _col_index(ref: str) -> tuple[int, int]:
    m = re.match(r"([A-Z]+)(\d+)", ref)
    letters, row = m.group(1), int(m.group(2))
    col = 0
    for ch in letters:
        col = col * 26 + (ord(ch) - 64)
    return row, col


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{NS['m']}}}t"))


class _Book:
    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        self.expanded = sum(i.file_size for i in self.zip.infolist())
        names = set(self.zip.namelist())
        self.shared = []
        if "xl/sharedStrings.xml" in names:
            root = ET.fromstring(self.zip.read("xl/sharedStrings.xml"))
            self.shared = [_text(si) for si in root.findall("m:si", NS)]
        self.date_styles = set()
        if "xl/styles.xml" in names:
            st = ET.fromstring(self.zip.read("xl/styles.xml"))
            custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in st.findall("m:numFmts/m:numFmt", NS)}
            for i, xf in enumerate(st.findall("m:cellXfs/m:xf", NS)):
                fid = int(xf.get("numFmtId", "0"))
                code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(fid, "")).lower()
                if fid in DATE_FORMAT_IDS or (fid in custom and re.search(r"[ymdhs]", code)):
                    self.date_styles.add(i)
        wb = ET.fromstring(self.zip.read("xl/workbook.xml"))
        rels = ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target") for r in rels.findall("pr:Relationship", NS)}
        self.sheets = []
        for s in wb.findall("m:sheets/m:sheet", NS):
            target = targets[s.get(f"{{{NS['r']}}}id")].lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            self.sheets.append((s.get("name"), path, s.get("state", "visible") != "visible"))

    def cells(self, sheet_path: str):
        root = ET.fromstring(self.zip.read(sheet_path))
        for c in root.iter(f"{{{NS['m']}}}c"):
            row, col = _col_index(c.get("r"))
            kind, style = c.get("t", "n"), int(c.get("s", "0"))
            v, f = c.find("m:v", NS), c.find("m:f", NS)
            if kind == "inlineStr":
                value = _text(c.find("m:is", NS)) if c.find("m:is", NS) is not None else None
            elif v is None or v.text is None:
                value = None
            elif kind == "s":
                value = self.shared[int(v.text)]
            elif kind == "b":
                value = "true" if v.text == "1" else "false"
            elif kind in ("str", "e"):
                value = v.text
            elif style in self.date_styles:
                value = (EPOCH + dt.timedelta(days=float(v.text))).isoformat(sep=" ")
            else:
                value = v.text
            if value == "":
                value = None
            yield row, col, value, f is not None and value is None



def _catalog(batches, upload_limit: int):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            book = _Book(bytes(content))
            if len(content) > upload_limit or book.expanded > upload_limit * EXPANSION_FACTOR:
                raise ValueError(f"{path}: workbook exceeds the configured safety limit")
            for pos, (name, sheet_path, hidden) in enumerate(book.sheets):
                grid, rows, cols = {}, 0, 0
                for r, c, v, _ in book.cells(sheet_path):
                    rows, cols = max(rows, r), max(cols, c)
                    if r <= PREVIEW_ROWS and c <= PREVIEW_COLS:
                        grid[(r, c)] = "" if v is None else str(v)[:PREVIEW_CHARS]
                preview = [[grid.get((r, c), "") for c in range(1, min(max(cols, 1), PREVIEW_COLS) + 1)]
                           for r in range(1, min(rows, PREVIEW_ROWS) + 1)]
                out.append((path, name, pos, rows, cols, hidden, book.expanded, json.dumps(preview, ensure_ascii=False)))
        yield pd.DataFrame(out, columns=["path", "sheet", "position", "rows", "columns", "hidden",
                                         "expanded_bytes", "preview"])


def _cells(batches, sheet: str | None, upload_limit: int):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            book = _Book(bytes(content))
            if len(content) > upload_limit or book.expanded > upload_limit * EXPANSION_FACTOR:
                raise ValueError(f"{path}: workbook exceeds the configured safety limit")
            for name, sheet_path, _ in book.sheets:
                if sheet is not None and name != sheet:
                    continue
                out += [(path, name, r, c, v, u) for r, c, v, u in book.cells(sheet_path)]
        yield pd.DataFrame(out, columns=["path", "sheet", "row", "col", "value", "formula_uncached"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def sheet_catalog(spark: SparkSession, path: str, upload_limit: int = DEFAULT_UPLOAD_BYTES) -> DataFrame:
    """One row per (workbook, sheet): size, hidden flag, 5x8 preview."""
    return _files(spark, path).mapInPandas(lambda it: _catalog(it, upload_limit), CATALOG_SCHEMA)


def workbook_cells(spark: SparkSession, path: str, sheet: str | None = None,
                   upload_limit: int = DEFAULT_UPLOAD_BYTES) -> DataFrame:
    return _files(spark, path).mapInPandas(lambda it: _cells(it, sheet, upload_limit), CELL_SCHEMA)


def read_workbook(spark: SparkSession, path: str, sheet: str, header_row: int = 1,
                  upload_limit: int = DEFAULT_UPLOAD_BYTES) -> Dataset:
    """One named sheet of one workbook as a text dataset (``f1..fn``).

    Rows above the header row are dropped; blank rows inside the range stay
    as all-null rows; uncached formula cells become warnings.
    """
    if not sheet:
        raise DatasetError("Name the worksheet to import")
    if header_row < 1:
        raise DatasetError("Header row starts at 1")
    cat = sheet_catalog(spark, path, upload_limit).filter(F.col("sheet") == sheet).collect()
    if len(cat) != 1:
        raise DatasetError("Worksheet not found" if not cat else "Name one workbook file")
    n_rows, n_cols = cat[0]["rows"], cat[0]["columns"]
    if n_cols > MAX_COLUMNS:
        raise DatasetError(f"Workbook exceeds {MAX_COLUMNS} columns; select a narrower source")
    cells = workbook_cells(spark, path, sheet, upload_limit).filter(F.col("row") >= header_row)
    header = {r["col"]: r["value"] for r in cells.filter(F.col("row") == header_row).select("col", "value").collect()}
    if not any(v is not None for v in header.values()):
        raise DatasetError("the header has no names")
    names = [header.get(c) if header.get(c) is not None else "Unnamed" for c in range(1, n_cols + 1)]
    body = cells.filter(F.col("row") > header_row)
    uncached = body.filter("formula_uncached").select("row", "col").orderBy("row", "col").collect()  # at most the cells of one sheet
    wide = body.groupBy("row").pivot("col", list(range(1, n_cols + 1))).agg(F.first("value"))
    spine = spark.range(header_row + 1, n_rows + 1).select(F.col("id").cast("int").alias("row"))
    df = spine.join(wide, "row", "left").orderBy("row").select(
        *[F.col(str(c)).cast("string").alias(f"f{c}") for c in range(1, n_cols + 1)])
    ds = Dataset.from_frame(df, names=names, source=f"{path}#{sheet}")
    warnings = list(ds.warnings) + [f"row {r['row']}, column {r['col']}: the formula has no stored value; recalculate the workbook"
                                    for r in uncached]
    return ds.with_frame(ds.df, {"operation": "import", "source": path, "sheet": sheet, "header_row": header_row},
                         warnings=tuple(warnings))
