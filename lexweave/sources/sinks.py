"""Writers. Outputs go to a fresh version beside the old one, never over what is read."""

from __future__ import annotations

import html
import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_documents(rows: DataFrame, path: str) -> str:
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)
    return path


def next_version(rows: DataFrame, folder: str, version: int) -> str:
    """Write a version of a table that may be computed from an earlier one."""
    path = f"{folder.rstrip('/')}/v{version}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def batch_files(rows: DataFrame, path: str) -> str:
    """A folder per ``batch_id``, and an index of the batches with their sizes beside them."""
    rows.repartition("batch_id").write.mode("overwrite").partitionBy("batch_id").json(path)
    rows.groupBy("batch_id").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path.rstrip('/')}-index")
    return path


def page_files(pages: DataFrame, folder: str) -> int:
    """One file per row of (path, content), written by the tasks into a folder that all
    executors mount. Folders of other file systems than the mounted one are refused."""
    url = urlparse(folder)
    if url.scheme not in ("", "file") or url.netloc not in ("", "localhost"):
        raise ValueError(f"pages can only be written into a mounted folder, not to {folder}")
    root = url.path

    def write(batches):
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                to = os.path.join(root, p)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                tmp = f"{to}.tmp{os.getpid()}"
                with open(tmp, "w", encoding="utf-8") as f:
                    f.write(c)
                os.replace(tmp, to)  # a task that runs again leaves the same file
            yield b.assign(n=1)[["n"]].agg({"n": "sum"}).to_frame().T.astype("int64")

    return pages.select("path", "content").mapInPandas(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def html_report(tables: dict[str, DataFrame], path: str) -> str:
    """A static report of result tables, all their rows, written as they come. A column
    named ``pct`` is shown as a bar besides."""

    def cell(name: str, value) -> str:
        bar = f"<div style='background:#4c78a8;height:8px;width:{int(value * 3.5)}px'></div>" if name == "pct" and value is not None else ""
        return f"<td>{html.escape('' if value is None else str(value))}{bar}</td>"

    with open(path, "w", encoding="utf-8") as f:
        f.write("<!doctype html><meta charset='utf-8'><title>Report</title>\n")
        for title, rows in tables.items():
            f.write(f"<h2>{html.escape(title)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns) + "</tr>\n")
            for r in rows.toLocalIterator():
                f.write("<tr>" + "".join(map(cell, rows.columns, r)) + "</tr>\n")
            f.write("</table>\n")
    return path
