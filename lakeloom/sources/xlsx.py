"""Spreadsheets: one sheet of a workbook, read and written with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str | None = None) -> list[list]:
    book = zipfile.ZipFile(io.BytesIO(data))
    names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
    number = names.index(sheet) + 1 if sheet else 1
    shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in book.namelist() else []
    rows = []
    for r in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{number}.xml")).iter(f"{_MAIN}row"):
        row: dict[int, object] = {}
        for c in r.iter(f"{_MAIN}c"):
            v, kind = c.find(f"{_MAIN}v"), c.get("t")
            if kind == "inlineStr":
                value: object = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif v is None:
                continue
            elif kind == "s":
                value = shared[int(v.text)]
            elif kind == "b":
                value = v.text == "1"
            elif kind == "str":
                value = v.text
            else:
                value = float(v.text)
            row[_column(c.get("r"))] = value
        rows.append([row.get(k) for k in range(max(row, default=-1) + 1)])
    return rows


def _inside(rows: list[list], cells: str) -> list[list]:
    """The rows and columns of a range such as B2:D10, B2:D (to the last row) or B2 (to the end of the sheet)."""
    m = re.fullmatch(r"([A-Za-z]+)(\d+)(?::([A-Za-z]+)(\d+)?)?", cells)
    if not m:
        raise ValueError(f"not a range of cells: {cells}")
    first, top = _column(m[1].upper()), int(m[2]) - 1
    last, bottom = _column(m[3].upper()) + 1 if m[3] else None, int(m[4]) if m[4] else None
    return [row[first:last] for row in rows[top:bottom]]


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, header: bool = True, all_varchar: bool = False, cells: str | None = None) -> DataFrame:
    """A sheet, or a range of its cells, as a DataFrame; a workbook is one file and is read by one task's worth of memory, on the driver."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    rows = sheet_rows(bytes(data), sheet)
    rows = _inside(rows, cells) if cells else rows
    width = max(map(len, rows), default=0)
    rows = [r + [None] * (width - len(r)) for r in rows]
    names = [str(x) for x in rows[0]] if header and rows else [f"column{k}" for k in range(width)]
    body = rows[1:] if header else rows
    kinds = []
    for k in range(width):
        values = [r[k] for r in body if r[k] is not None]
        kinds.append("string" if all_varchar or not values or any(isinstance(v, str) for v in values) else "boolean" if all(isinstance(v, bool) for v in values) else "double")
    cast = {"string": lambda v: v if isinstance(v, str) else f"{v:g}" if isinstance(v, float) else str(v).lower(), "boolean": bool, "double": float}
    typed = [tuple(None if v is None else cast[t](v) for v, t in zip(r, kinds, strict=True)) for r in body]
    return spark.createDataFrame(typed, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=True)))


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1", limit: int = 1_048_575) -> None:
    """A workbook of one sheet; raises ValueError above the format's number of rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a sheet")

    def cell(k: int, n: int, v) -> str:
        name, at = "", k + 1
        while at:
            at, rest = divmod(at - 1, 26)
            name = chr(65 + rest) + name
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{name}{n}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{name}{n}"><v>{v!r}</v></c>'
        return f'<c r="{name}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    lines = [df.columns, *rows]
    body = "".join(f'<row r="{n}">{"".join(cell(k, n, v) for k, v in enumerate(r))}</row>' for n, r in enumerate(lines, 1))
    head, ns = '<?xml version="1.0" encoding="UTF-8"?>', "http://schemas.openxmlformats.org"
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(out.getvalue()))
    stream.close()
