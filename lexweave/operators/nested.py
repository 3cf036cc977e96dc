"""Deeply nested records to flat, linked tables by one depth-first pass."""

from __future__ import annotations

import json
import math
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_table_path

#: Keys by which a JSON object is told to be a word record (fixed values).
WORD_FIELDS = ("vocab_id", "examples", "parts_appeared", "total_count", "chapter")

TAGGED = "doc_id bigint, tag string, pk string, parent string, word string, pos bigint, payload string"
#: Columns of the flat tables, read from the payload of their tag.
SCHEMAS = {
    "word": "vocab_id string, chapter int, total_count int",
    "example": "ex_id bigint, sentence string, source string, volume int, test int, page int, question_number int, part int, matched_form string",
    "part": "part int, number string",
    "error": "message string",
}


TAGS = tuple(SCHEMAS)


def _finite(text: str) -> float | None:
    value = float(text)
    return value if math.isfinite(value) else None


def _parse(text: str):
    """JSON to Python; numbers that JSON can't hold (NaN, infinities) are null."""
    return json.loads(text, parse_constant=lambda _: None, parse_float=_finite)


def _dump(value) -> str:
    """Python to JSON that is valid UTF-8: half a character is replaced."""
    return json.dumps(value, ensure_ascii=False).encode("utf-8", "replace").decode()


def _as_list(value) -> list:
    """Children of an optional field in any shape: list, one object, object keyed
    by place (its values in the order given), JSON text of these, scalar, null.
    An empty object has no children; text that isn't JSON, or is nested too
    deep to be read, is a child itself."""
    if isinstance(value, str):
        try:
            inner = _parse(value)
        except (ValueError, RecursionError):
            return [value] if value.strip() else []
        return _as_list(inner) if not isinstance(inner, (int, float, bool)) else [inner]
    if value is None:
        return []
    if isinstance(value, dict) and all(k.isdigit() for k in value):
        return list(value.values())
    return value if isinstance(value, list) else [value]


def _part_number(value) -> str | None:
    """The digits of a part, without leading zeros; null where there are none."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, float) and value == int(value):
        value = int(value)
    digits = "".join(c for c in str(value) if c in "0123456789")
    return (digits.lstrip("0") or "0") if digits else None


def _is_word(node: dict) -> bool:
    return "word" in node or any(k in node for k in WORD_FIELDS)


def visit(node, key: str | None = None) -> Iterator[tuple[str, dict]]:
    """Depth-first: (word, record) for every word record below ``node``, in document order.

    A mapping without a record's fields is an envelope or a map keyed by word;
    an envelope's own scalar metadata yields nothing. The walk keeps its own
    stack, so depth can't overflow it.
    """
    stack = [(node, key)]
    while stack:
        x, k = stack.pop()
        if isinstance(x, dict):
            if _is_word(x) and (k is not None or "word" in x):
                w = x.get("word")
                yield (w if isinstance(w, str) else k) or "", x
            else:
                stack.extend((v, name) for name, v in reversed(list(x.items())) if isinstance(v, (dict, list)))
        elif isinstance(x, list):
            stack.extend((v, k if isinstance(v, list) else None) for v in reversed(x) if isinstance(v, (dict, list)))


def _emit(doc_id: int, payload: str | None, tags: Collection[str]) -> list[tuple]:
    """The tagged rows of a document, or a single ``error`` row if anything in it can't be read."""
    if payload is None or not payload.strip():
        return []
    try:
        return [r for r in _walk(doc_id, _parse(payload)) if r[1] in tags]
    except (ValueError, TypeError, ArithmeticError, RecursionError) as e:
        return [(doc_id, "error", f"r{doc_id}/error", None, None, 1, _dump({"message": f"{type(e).__name__}: {e}"}))] if "error" in tags else []


def _walk(doc_id: int, root) -> Iterator[tuple]:
    for n, (word, rec) in enumerate(visit(root), 1):
        pk, word = f"r{doc_id}/w{n}", word.encode("utf-8", "replace").decode()
        own = {k: v for k, v in rec.items() if k not in ("examples", "parts_appeared", "word")}
        yield doc_id, "word", pk, None, word, n, _dump(own)
        pos = 0
        for ex in _as_list(rec.get("examples")):
            if isinstance(ex, str):
                ex = {"sentence": ex}
            if isinstance(ex, dict):
                pos += 1
                yield doc_id, "example", f"{pk}/e{pos}", pk, word, pos, _dump(ex)
        pos = 0
        for part in _as_list(rec.get("parts_appeared")):
            number = _part_number(part)
            if number is not None:
                pos += 1
                yield doc_id, "part", f"{pk}/p{pos}", pk, word, pos, _dump({"part": number, "number": number})


def flatten_payloads(raw: DataFrame, doc_id: str = "raw_id", payload: str = "payload", tags: Collection[str] = TAGS) -> DataFrame:
    """Single-pass tagged emission from JSON payloads (schema ``TAGGED``).

    Each payload is parsed once and walked once; a row is emitted for each
    word, example and part among ``tags`` with its key, its parent's key and
    its position. Null and blank payloads give no rows, an unreadable one gives
    a row with tag ``error`` and nothing else; unknown extra fields stay in the
    payload. Numbers that JSON can't hold are null, half a character is
    replaced.
    """
    tags = frozenset(tags)

    def walk(batches):
        for b in batches:
            rows: list[tuple] = []
            for d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.extend(_emit(d, p, tags))
                if len(rows) >= 5000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return raw.select(F.col(doc_id).cast("bigint"), F.col(payload)).mapInArrow(walk, TAGGED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["doc_id", "tag", "pk", "parent", "word", "pos", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def delivered_once(rows: DataFrame, key: str) -> DataFrame:
    """One row of each ``key``. Only rows whose key recurs are shuffled whole; of all
    others just the key is, to be counted. Rows without a key are all kept."""
    again = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates([key]))


def flatten_entries(entries: DataFrame, tags: Collection[str] = TAGS) -> DataFrame:
    """The same tagged rows from typed word-to-examples rows, all in the JVM.

    One ``explode`` over the tagged children of a row is the single pass; the
    row's exact repeats are dropped first by entry_id. Null and empty arrays
    give the word row alone; null elements are skipped and not counted. A row
    without entry_id is a document of its own without keys.
    """
    pk = F.concat(F.lit("e"), F.col("entry_id").cast("string"), F.lit("/w1"))
    exs = F.filter("examples", lambda e: e.isNotNull())
    pts = F.filter("parts_appeared", lambda p: p.isNotNull())
    node = lambda tag, key, parent, pos, payload: F.struct(
        F.lit(tag).alias("tag"), key.alias("pk"), parent.alias("parent"), pos.cast("bigint").alias("pos"), payload.alias("payload")
    )
    none = F.lit(None).cast("string")
    number = lambda p: F.struct(p.alias("part"), p.cast("string").alias("number"))
    nodes = {
        "word": F.array(node("word", pk, none, F.lit(1), F.to_json(F.struct("vocab_id", "chapter", "total_count")))),
        "example": F.coalesce(F.transform(exs, lambda e, i: node("example", F.concat(pk, F.lit("/e"), i + 1), pk, i + 1, F.to_json(e))), F.array()),
        "part": F.coalesce(F.transform(pts, lambda p, i: node("part", F.concat(pk, F.lit("/p"), i + 1), pk, i + 1, F.to_json(number(p)))), F.array()),
    }
    chosen = [n for tag, n in nodes.items() if tag in tags]
    needed = ["entry_id", "word", *(["vocab_id", "chapter", "total_count"] if "word" in tags else []), *(["examples"] if "example" in tags else []), *(["parts_appeared"] if "part" in tags else [])]
    once = delivered_once(entries.select(*needed), "entry_id")
    return once.select(F.col("entry_id").alias("doc_id"), "word", F.explode(F.concat(*chosen)).alias("n")).select(
        "doc_id", "n.tag", "n.pk", "n.parent", "word", "n.pos", "n.payload"
    )


def write_tagged(tagged: DataFrame, path: str | None = None) -> str:
    """Write tagged rows once, partitioned by tag; returns the path."""
    path = path or shared_table_path(tagged.sparkSession, "flat")
    tagged.write.partitionBy("tag").parquet(path)
    return path


def read_flat(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One flat table of a written emission (reads only its tag's files), with its schema applied."""
    rows = spark.read.schema(TAGGED).parquet(path).where(F.col("tag") == tag)
    return apply_schema(rows, tag)


def apply_schema(tagged: DataFrame, tag: str) -> DataFrame:
    """Typed columns of one tag. A value that doesn't fit its type is null."""
    fields = [f.split() for f in SCHEMAS[tag].split(", ")]
    own = [F.expr(f"try_cast(get_json_object(payload, '$.{n}') as {t})").alias(n) for n, t in fields]
    return tagged.where(F.col("tag") == tag).select("doc_id", "pk", "parent", "word", "pos", *own)


def children(spark: SparkSession, path: str) -> DataFrame:
    """(raw_id, word, child_kind, pos, child_text) of a written emission: an example's source without outer blanks, or the part's number."""
    row = lambda tag, text: read_flat(spark, path, tag).select(F.col("doc_id").alias("raw_id"), "word", F.lit(tag).alias("child_kind"), "pos", text.alias("child_text"))
    source = F.regexp_replace(F.coalesce("source", F.lit("")), r"(?U)^\s+|(?<!\s)\s+$", "")
    return row("example", source).unionByName(row("part", F.col("number"))).distinct()
