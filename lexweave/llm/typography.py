"""Duplicates hidden by formatting: canonical keys, Bloom filters, exact groups (problem 3)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach_by_key
from ..session import materialise

#: Bits of the filters per record, their number of probes, and the size of one
#: filter. More records than one filter takes are told into shards by their
#: hashes, with a filter each: filters are never fuller than ``BITS_PER_RECORD``
#: allows, however many records there are.
BITS_PER_RECORD = 12
PROBES = 4
SHARD_BITS = 1 << 26
#: Shards whose filters are built and probed by one job, which bounds what the
#: driver holds: this many times ``SHARD_BITS`` / 8 bytes.
SHARDS_AT_ONCE = 16
_CHUNK = 1 << 16  # bits
_KEYS = "kind string, id bigint, h1 bigint, h2 bigint"


def canonical_text(text: Column) -> Column:
    """Letters and digits alone, in lower case; null where there are none."""
    return F.nullif(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")), F.lit(""))


def _letters(text: str) -> str:
    return "".join(c for c in text if c.isalnum()).lower()


def _canonical(value, key: str | None = None):
    if isinstance(value, dict):
        return {k: _canonical(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [_canonical(v, key) for v in value]
    if isinstance(value, str):
        if key == "sentence":
            return _letters(value)
        if value[:1] in "[{" and value[-1:] in "]}":
            try:
                return {"\0json": _canonical(json.loads(value), key)}
            except (ValueError, RecursionError):
                return value
    return value


def canonical_json(payload: str | None) -> str | None:
    """Payload with sorted keys and without spacing, its sentences reduced to
    letters and digits. Text that isn't JSON is its own canonical form."""
    if payload is None or not payload.strip():
        return None
    try:
        # escapes keep half characters from breaking the column
        return json.dumps(_canonical(json.loads(payload)), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return payload.strip()


def record_keys(entries: DataFrame, raw: DataFrame) -> DataFrame:
    """(kind, id, h1, h2): a 128-bit hash of each record's canonical form.

    Records without any letter or digit, null ones included, have no key.
    """

    def canon(batches):
        for b in batches:
            texts = [canonical_json(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    ex = entries.select(F.explode("examples").alias("e")).select(
        F.lit("example").alias("kind"), F.col("e.ex_id").cast("bigint").alias("id"), canonical_text(F.col("e.sentence")).alias("text")
    )
    files = raw.select(F.col("raw_id").cast("bigint").alias("id"), "payload").mapInArrow(canon, "id bigint, text string")
    rows = ex.unionByName(files.select(F.lit("raw").alias("kind"), "id", "text")).where("text is not null and id is not null")
    digest = F.md5(F.concat_ws("\x00", "kind", "text"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint")
    return rows.select("kind", "id", half(1).alias("h1"), half(17).alias("h2"))


def _probe_bits(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def _merge(once: np.ndarray, rep: np.ndarray, once2: np.ndarray, rep2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters of two parts together: seen in both parts is seen repeatedly."""
    return once | once2, rep | rep2 | (once & once2)


def repeat_filters(shards: dict[int, DataFrame], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, packed Bloom filter of ``bits`` / 8 bytes) of the hashes seen more than once.

    Each partition builds a filter of once-seen and one of repeatedly-seen
    hashes; the parts are merged chunk by chunk in two levels. A filter may
    hold hashes seen once (false positives), never misses a repeated one. One
    job serves all ``shards``; the driver gets one filter after the other.
    """

    def build_of(shard: int):
        def build(batches):
            once, rep = np.zeros(bits, bool), np.zeros(bits, bool)
            part = 0
            for b in batches:
                h1, h2 = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
                if not len(h1):
                    continue
                part = int(h1[0]) & 0x3F
                pos = _probe_bits(h1, h2, bits)
                # seen in an earlier batch, or twice in this one
                seen = once[pos].all(axis=0)
                pair = h1.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ h2.astype(np.uint64)
                order = np.argsort(pair, kind="stable")
                same = np.zeros(len(pair), bool)
                same[order[1:]] = pair[order[1:]] == pair[order[:-1]]
                rep[pos[:, seen | same]] = True
                once[pos] = True
            po, pr = np.packbits(once), np.packbits(rep)
            step = _CHUNK // 8
            for c in range(0, bits // 8, step):
                o, r = po[c : c + step], pr[c : c + step]
                if o.any():
                    yield pa.RecordBatch.from_pydict(
                        {"shard": pa.array([shard], pa.int32()), "chunk": pa.array([c // step], pa.int32()), "slot": pa.array([part], pa.int32()), "once": [o.tobytes()], "rep": [r.tobytes()]}
                    )

        return build

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        once = rep = None
        for o, r in zip(pdf["once"], pdf["rep"]):
            o, r = np.frombuffer(o, np.uint8), np.frombuffer(r, np.uint8)
            once, rep = (o, r) if once is None else _merge(once, rep, o, r)
        return pdf.iloc[:1].assign(once=[once.tobytes()], rep=[rep.tobytes()])

    schema = "shard int, chunk int, slot int, once binary, rep binary"
    parts = reduce(DataFrame.unionByName, (rows.mapInArrow(build_of(s), schema) for s, rows in shards.items()))
    level1 = parts.groupBy("shard", "chunk", "slot").applyInPandas(fold, schema)
    level2 = level1.groupBy("shard", "chunk").applyInPandas(fold, schema).select("shard", "chunk", "rep")
    out = {s: np.zeros(bits // 8, np.uint8) for s in shards}
    for row in level2.toLocalIterator():
        at = row["chunk"] * (_CHUNK // 8)
        out[row["shard"]][at : at + _CHUNK // 8] = np.frombuffer(row["rep"], np.uint8)
    while out:
        yield out.popitem()


def filter_bits(n: int) -> int:
    """Bits of a filter for ``n`` records, a power of two."""
    bits = _CHUNK
    while bits < n * BITS_PER_RECORD:
        bits *= 2
    return bits


def stored_keys(entries: DataFrame, raw: DataFrame) -> tuple[DataFrame, int, int]:
    """(keys, number of shards, bits of a filter): the records' keys, written once.

    More records than one filter takes are written in folders by shard, each
    task its own files, so that every shard can be read alone without a
    shuffle. How many records there can be is counted from lengths alone.
    """
    sizes = entries.agg(F.coalesce(F.sum(F.when(F.col("examples").isNotNull(), F.size("examples.ex_id"))), F.lit(0)).alias("n"))
    n = sizes.first()["n"] + raw.count()
    shards = -(-n * BITS_PER_RECORD // SHARD_BITS) or 1
    keys = record_keys(entries, raw)
    if shards == 1:
        return materialise(keys, "p3-keys"), 1, filter_bits(n)
    shard = F.pmod(F.shiftrightunsigned("h2", 36), F.lit(shards)).cast("int")
    # few tasks write into many folders: fewer and larger files
    few = keys.coalesce(max(1, keys.sparkSession.sparkContext.defaultParallelism))
    # shards differ a little in size: a filter of the next power of two has room for it
    return materialise(few.withColumn("shard", shard), "p3-keys", by="shard"), shards, filter_bits(-(-n // shards))


def split_possible_repeats(keys: DataFrame, shards: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(possible repeats, singletons): what the repeat filters hold, and the rest, which is unique for certain."""

    def probe_of(shared):
        def probe(batches):
            rep = shared.value
            for b in batches:
                h1, h2 = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
                pos = _probe_bits(h1, h2, bits)
                hit = ((rep[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1).all(axis=0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit, pa.bool_())], names=[*b.schema.names, "maybe"])

        return probe

    sc, cols = keys.sparkSession.sparkContext, ["kind", "id", "h1", "h2"]
    of = {s: (keys.where(F.col("shard") == s) if shards > 1 else keys).select(*cols) for s in range(shards)}
    groups = []
    for at in range(0, shards, SHARDS_AT_ONCE):
        some = {s: of[s] for s in range(at, min(at + SHARDS_AT_ONCE, shards))}
        # bits / 8 bytes each; only the tasks of a shard fetch its filter
        tagged = [some[s].mapInArrow(probe_of(sc.broadcast(packed)), _KEYS + ", maybe boolean") for s, packed in repeat_filters(some, bits)]
        rows = reduce(DataFrame.unionByName, tagged)
        groups.append(rows if shards <= SHARDS_AT_ONCE else materialise(rows, "p3-split"))
    rows = reduce(DataFrame.unionByName, groups)
    return rows.where("maybe").drop("maybe"), rows.where("not maybe").drop("maybe")


_HASH = ["kind", "h1", "h2"]


def exact_groups(repeats: DataFrame) -> DataFrame:
    """(kind, h1, h2, id_a, n_copies) of hashes with two distinct ids or more."""
    return (
        repeats.groupBy(*_HASH, "id").agg(F.lit(1).alias("_one"))
        .groupBy(*_HASH).agg(F.min("id").alias("id_a"), F.count("*").alias("n_copies"))
    )


def duplicate_pairs(entries: DataFrame, raw: DataFrame) -> DataFrame:
    """(kind, id_a, id_b): id_a is the smallest id of the group, id_b each other one.

    Only possible repeats are shuffled, as hashes and ids. A record delivered
    again under the same id is no copy. Records without letters and digits
    have none; empty tables give no rows.
    """
    repeats, _ = split_possible_repeats(*stored_keys(entries, raw))
    groups = exact_groups(repeats).where("n_copies > 1")
    rows = repeats.groupBy(*_HASH, "id").agg(F.lit(1).alias("_one")).drop("_one")
    return attach_by_key(rows, groups, _HASH, "n_copies").where("id <> id_a").select("kind", "id_a", F.col("id").alias("id_b"))


def collapsed(entries: DataFrame, raw: DataFrame) -> DataFrame:
    """(kind, id, n_copies): one record per distinct text or file, named by its smallest id."""
    repeats, singles = split_possible_repeats(*stored_keys(entries, raw))
    groups = exact_groups(repeats).select("kind", F.col("id_a").alias("id"), "n_copies")
    return groups.unionByName(singles.select("kind", "id", F.lit(1).cast("bigint").alias("n_copies")))
