"""Readers. Each gives rows with an explicit position, since order carries meaning."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import QUESTION


def _whole(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def json_arrays(spark: SparkSession, glob: str, schema: str = QUESTION) -> DataFrame:
    """Records of JSON-array files, with file and pos. Files that hold no array
    (or no JSON) give no rows; a record that doesn't fit has null fields."""
    rows = _whole(spark, glob).select("file", F.from_json("value", f"array<struct<{_struct(schema)}>>").alias("a"))
    return rows.select("file", F.posexplode("a").alias("pos", "r")).where("r is not null").select("file", "pos", "r.*")


def _struct(schema: str) -> str:
    """``name type, ...`` as struct fields ``name: type, ...``."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = schema[start:i].strip().split(" ", 1)
            out.append(f"{name}: {kind.replace(' ', ': ') if 'struct<' in kind else kind}")
            start = i + 1
    return ", ".join(out)


def volume_of(rows: DataFrame) -> DataFrame:
    """Adds the volume that the file's name tells (null if none)."""
    return rows.withColumn("file_volume", F.expr(r"try_cast(nullif(regexp_extract(file, 'vol([0-9]+)', 1), '') as int)"))


def keyed_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, key, value) of JSON documents whose root is a map or a list of
    records; value is JSON text. A list's key is the record's ``word`` or ``id``, else null."""

    def walk(batches):
        for b in batches:
            out = []
            for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    root = json.loads(v)
                except ValueError:
                    continue
                pairs = root.items() if isinstance(root, dict) else [(x.get("word") or x.get("id") if isinstance(x, dict) else None, x) for x in root] if isinstance(root, list) else []
                out.extend((f, i, k, json.dumps(x, ensure_ascii=False)) for i, (k, x) in enumerate(pairs))
            if out:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["file", "pos", "key", "value"])

    return _whole(spark, path).mapInArrow(walk, "file string, pos bigint, key string, value string")


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, page, text) of ``page_NNNN.txt`` files below a folder."""
    rows = _whole(spark, folder, pathGlobFilter="page_*.txt", recursiveFileLookup=True)
    return rows.select("file", F.expr("try_cast(nullif(regexp_extract(file, 'page_([0-9]+)', 1), '') as int)").alias("page"), F.col("value").alias("text"))


def markdown_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(file, front, body) of Markdown files; front is the map of the front matter, empty if there is none."""
    rows = _whole(spark, folder, pathGlobFilter="*.md", recursiveFileLookup=True)
    block = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---\s*", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\w+:"))
    front = F.map_from_entries(
        F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1).alias("k"), F.trim(F.regexp_extract(x, r"^\w+: ?(.*)$", 1)).alias("v")))
    )
    body = F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*", "")
    return rows.select("file", F.when(F.size(pairs) > 0, front).otherwise(F.create_map().cast("map<string,string>")).alias("front"), body.alias("body"))


def typed_front(pages: DataFrame, ints: list[str], lists: list[str]) -> DataFrame:
    """Adds maps ``ints`` and ``lists``: the front matter's values under these keys as numbers, and as
    arrays of the items between brackets and commas. What isn't one is null; a missing list is empty."""
    number = lambda k: F.expr(f"try_cast(trim(front['{k}']) as int)")
    inner = lambda k: F.regexp_replace(F.coalesce(F.col("front")[k], F.lit("")), r"^\s*\[|\]\s*$", "")
    items = lambda k: F.filter(F.transform(F.split(inner(k), ","), lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")), lambda x: x != "")
    as_map = lambda keys, f: F.create_map(*(c for k in keys for c in (F.lit(k), f(k))))
    return pages.withColumns({"ints": as_map(ints, number), "lists": as_map(lists, items)})


def config(spark: SparkSession, path: str) -> dict[str, str]:
    """Settings of a YAML file of nested mappings and plain lists, keyed by their path:
    ``vocab.total_days`` or ``ets.volumes.0``. Values are text without quotes and comments.
    Read by the driver; a setting that is given twice keeps the last value."""
    out: dict[str, str] = {}
    stack: list[tuple[int, str]] = []
    places: dict[str, int] = {}
    for row in spark.read.option("wholetext", True).text(path).collect():
        for line in row[0].splitlines():
            body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
            if not body.strip():
                continue
            depth = len(body) - len(body.lstrip())
            body = body.strip()
            item = body.startswith("- ")
            while stack and (stack[-1][0] > depth or stack[-1][0] == depth and not item):
                stack.pop()
            prefix = ".".join(k for _, k in stack)
            if item:
                n = places[prefix] = places.get(prefix, -1) + 1
                out[f"{prefix}.{n}"] = _plain(body[2:])
                continue
            key, _, value = body.partition(":")
            name = f"{prefix}.{key.strip()}" if prefix else key.strip()
            value = value.strip()
            if value.startswith("[") and value.endswith("]"):
                out |= {f"{name}.{i}": _plain(v) for i, v in enumerate(value[1:-1].split(",")) if v.strip()}
            elif value:
                out[name] = _plain(value)
            else:
                stack.append((depth, key.strip()))
    return out


def _plain(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def sections(pages: DataFrame, headings: list[str]) -> DataFrame:
    """(file, pos, heading, text) of the second-level sections whose heading is listed."""
    parts = pages.select("file", F.posexplode(F.split("body", r"(?m)^## ")).alias("pos", "part")).where("pos > 0")
    head = F.trim(F.split("part", "\n", 2)[0])
    return parts.select("file", "pos", head.alias("heading"), strip(F.coalesce(F.get(F.split("part", "\n", 2), 1), F.lit(""))).alias("text")).where(F.col("heading").isin(*headings))


def word_sheets(spark: SparkSession, path: str, groups: int = 2) -> DataFrame:
    """(file, day, word, meaning) of CSV sheets with a day and ``groups`` pairs of word and meaning per row."""
    cols = ", ".join(f"w{i} string, m{i} string" for i in range(groups))
    rows = spark.read.schema(f"day string, {cols}").csv(path).withColumn("file", F.input_file_name())
    stack = ", ".join(f"w{i}, m{i}" for i in range(groups))
    return rows.selectExpr("file", "try_cast(regexp_extract(day, '([0-9]+)', 1) as int) as day", f"stack({groups}, {stack}) as (word, meaning)").where("trim(word) <> ''")


def answer_key(spark: SparkSession, path: str) -> DataFrame:
    """(id, answer) of a flat JSON map; an empty frame if the file isn't one."""
    rows = _whole(spark, path).select(F.from_json("value", "map<string,string>").alias("m"))
    return rows.select(F.explode("m").alias("id", "answer"))
