"""Writers: JSON lines, append-only tables, snapshots with versions, sheets as files or as one workbook, a page with the data inside."""

from __future__ import annotations

import html
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a report that may come to the driver.
MOST_ROWS = 100_000


def json_lines(df: DataFrame, path: str) -> None:
    """Records as JSON lines; the commit protocol makes the folder appear whole or not at all."""
    df.write.mode("overwrite").json(path)


def failures(df: DataFrame, path: str) -> None:
    """Append failure rows, with their five known columns only."""
    df.select("community", "post_id", "stage", "message", "created_at").write.mode("append").parquet(path)


def snapshot(df: DataFrame, folder: str, version: int) -> str:
    """A new version of a cumulative table; readers take the highest, so a run never sees its own discoveries."""
    path = f"{folder}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.parquet(folder)
    top = df.agg(F.max("version")).first()[0]
    return df.filter(F.col("version") == top)


def sheets(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a CSV folder."""
    for name, df in tables.items():
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def _column(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _few(name: str, df: DataFrame, most: int) -> list:
    """The rows of a table of a report; more than ``most`` is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{name} has more than {most} rows; write it with sheets()")
    return rows


def workbook(tables: dict[str, DataFrame], path: str, most: int = MOST_ROWS) -> None:
    """One workbook (OOXML) with a sheet for each table, for reports that fit a driver: more than ``most`` rows is an error."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(tables)
        for k, (name, df) in enumerate(tables.items(), 1):
            rows = _few(name, df, most)
            lines = []
            for i, row in enumerate([df.columns, *rows], 1):
                cells = "".join(f'<c r="{_column(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for j, v in enumerate(row))
                lines.append(f'<row r="{i}">{cells}</row>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<?xml version="1.0"?><worksheet {ns}><sheetData>{"".join(lines)}</sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)[:31]}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(names) + 1)) + "</Types>")


def page(title: str, tables: dict[str, DataFrame], most: int = 5_000) -> str:
    """A page that holds the tables' rows, for reports that fit a driver: more than ``most`` rows of a table is an error.  <, > and & in them can't end the script."""
    data = {n: [r.asDict(True) for r in _few(n, df, most)] for n, df in tables.items()}
    inside = json.dumps(data, default=str, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><script id="data" type="application/json">{inside}</script>'
