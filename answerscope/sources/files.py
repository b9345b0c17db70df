"""Readers and writers for the model's tables."""

from __future__ import annotations

import json
import re
import zipfile
from io import BytesIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.entities import Brand, checked
from ..plans.config import Config
from ..plans.schemas import SCHEMAS


def read_csv(spark: SparkSession, path: str, table: str | None = None, schema=None) -> DataFrame:
    """Only an empty cell is null. With a schema, or a table's name for that of the model, the header must match it."""
    options = {"header": True, "multiLine": True, "escape": '"', "nullValue": "", "emptyValue": "", "enforceSchema": False}
    reader = spark.read.options(**options)
    schema = SCHEMAS[table] if table else schema
    return reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for tables that people read; large results belong in Parquet."""
    df.coalesce(1).write.mode("overwrite").options(header=True, escape='"', emptyValue="", lineSep="\n").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def records_json(df: DataFrame) -> str:
    """An array of records with 10-digit doubles, for small tables."""
    rounded = df.select(*[F.round(c, 10).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    return json.dumps([r.asDict(recursive=True) for r in rounded.collect()], ensure_ascii=False, indent=1, default=str)


def read_config(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return Config.of(yaml.safe_load(f))


def brands_of(text: str) -> list[Brand]:
    """The dictionary that a YAML text says."""
    import yaml

    entries = yaml.safe_load(text) or []
    return checked([Brand(e["brand"], e.get("parent"), e["type"], tuple(e["aliases"]), bool(e.get("case_sensitive")), tuple(e.get("ambiguous_aliases") or ())) for e in entries])


def read_brands(path: str) -> list[Brand]:
    with open(path, encoding="utf-8") as f:
        return brands_of(f.read())


def brands_frame(spark: SparkSession, brands: list[Brand]) -> DataFrame:
    return spark.createDataFrame([(b.brand, b.parent, b.type, list(b.aliases), b.case_sensitive, b.ambiguous, list(b.ambiguous_aliases)) for b in brands], SCHEMAS["brands"])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """key (file name without suffixes), suffix, body."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.substring_index(name, ".", 1).alias("key"), F.regexp_extract(name, r"^[^.]*(.*)$", 1).alias("suffix"), F.col("content").alias("body"))


def sheet_bytes(header: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet of texts; nulls are left out."""
    out = BytesIO()
    place = lambda c: chr(65 + c) if c < 26 else chr(64 + c // 26) + chr(65 + c % 26)
    cell = lambda r, c, v: f'<c r="{place(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v), {chr(13): "&#13;"})}</t></is></c>'
    lines = ["".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) for r, row in enumerate([header, *rows], 1)]
    body = "".join(f'<row r="{r}">{line}</row>' for r, line in enumerate(lines, 1))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def sheet_rows(path: str | BytesIO) -> list[dict[str, str]]:
    """Rows of a workbook's first sheet by its header, with the standard library."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        first = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        sheet = ElementTree.fromstring(z.read(first))

    def place(ref: str) -> int:
        n = 0
        for c in re.match(r"[A-Z]+", ref)[0]:
            n = n * 26 + ord(c) - 64
        return n - 1

    rows = []
    for row in sheet.iterfind(".//m:row", ns):
        cells: dict[int, str] = {}
        for k, c in enumerate(row.findall("m:c", ns)):
            v, inline = c.find("m:v", ns), c.find("m:is", ns)
            text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else v.text or "" if v is not None else ""
            cells[place(c.get("r")) if c.get("r") else k] = shared[int(text)] if c.get("t") == "s" and text else text
        rows.append(cells)
    header = rows[0] if rows else {}
    return [{name: r.get(k, "") for k, name in header.items()} for r in rows[1:]]


def read_sheet(spark: SparkSession, path: str | BytesIO) -> DataFrame:
    rows = sheet_rows(path)
    names = list(rows[0]) if rows else []
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names) or "empty string")
