"""Sinks: ordered single-file CSV, partitioned parquet with a manifest, small reports, metadata."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_ROWS = 10_000  # reports are formatted on the driver up to this number of rows


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, single: bool = False, bom: bool = False) -> None:
    """CSV with a header; in global order and as one file only on request, as both cost a shuffle."""
    if order:
        df = df.orderBy(*order)
    if single:
        df = df.coalesce(1)
    if bom:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_splits(df: DataFrame, path: str, split: str) -> DataFrame:
    """One folder a split, and the manifest (split, rows) of what was written."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(split).agg(F.count("*").alias("rows"))


def _bounded(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; write the table instead")
    return rows


def markdown(df: DataFrame) -> str:
    """A small result as a Markdown table, pipes escaped."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in _bounded(df)]) + "\n"


def write_report(parts: dict[str, DataFrame], folder: str) -> None:
    """report.json and report.md of small results."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    data = {k: [r.asDict(recursive=True) for r in _bounded(df)] for k, df in parts.items()}
    Path(folder, "report.json").write_text(json.dumps(data, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    Path(folder, "report.md").write_text("\n".join(f"## {k}\n\n{markdown(df)}" for k, df in parts.items()), encoding="utf-8")


def write_workbook(df: DataFrame, path: str, text_columns: list[str]) -> bool:
    """A spreadsheet with frozen header, filter and ids as text; False where no writer is installed."""
    try:
        from openpyxl import Workbook
    except ImportError:
        return False
    book = Workbook()
    sheet = book.active
    sheet.append(df.columns)
    for r in _bounded(df):
        sheet.append([str(v) if c in text_columns and v is not None else v for c, v in zip(df.columns, r)])
    sheet.freeze_panes, sheet.auto_filter.ref = "A2", sheet.dimensions
    book.save(path)
    return True


def enrich(meta: dict, renamed: dict[str, str], extra: dict, expected: dict) -> dict:
    """Metadata with renamed keys and additions; an error where it disagrees with what is expected."""
    out = {renamed.get(k, k): v for k, v in meta.items()} | extra
    wrong = {k: (out.get(k), v) for k, v in expected.items() if out.get(k) != v}
    if wrong:
        raise ValueError(f"metadata disagrees: {wrong}")
    return out
