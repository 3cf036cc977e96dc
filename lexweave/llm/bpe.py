"""Encoding of the corpus with a public byte-level BPE tokenizer (problem 8)."""

from __future__ import annotations

import json
import os
from heapq import heapify, heappop, heappush

import duckdb
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("LEXWEAVE_TOKENIZERS", "/opt/tokenizers")
#: How the public byte-level vocabulary cuts text into words (fixed value).
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a partition encodes in one recursive query, and the most it keeps.
WORDS_PER_QUERY = 20_000
WORDS_KEPT = 400_000
#: A step of the query looks at every token of its words, and a word takes as
#: many steps as it has distinct merges: runs of more bytes than this without a
#: break (encoded data, not words) are contracted with a queue instead.
QUERY_BYTES = 2_000


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary file: printable
    bytes for themselves, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def load_merges(path: str) -> tuple[list[int], pa.Table]:
    """(id of each byte, table of merges: a, b, rank, merged id)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = pa.table(
        {
            "a": pa.array([vocab[x] for x, _ in pairs], pa.int32()),
            "b": pa.array([vocab[y] for _, y in pairs], pa.int32()),
            "rank": pa.array(range(len(pairs)), pa.int32()),
            "merged": pa.array([vocab[x + y] for x, y in pairs], pa.int32()),
        }
    )
    symbols = byte_symbols()
    return [vocab[symbols[b]] for b in range(256)], merges


#: State: one row per unfinished word with its list of ids. A step lays the
#: lists out as token-position rows, joins neighbours with the merge table,
#: contracts every word's minimum-rank pair at its leftmost places that don't
#: overlap (later merges always rank behind, so contracting all places of the
#: pair at once equals doing so one by one), and gathers the lists in order.
#: A word without a mergeable pair gives no row, which ends its recursion.
CONTRACT = """
WITH RECURSIVE st(w, toks) USING KEY (w) AS (
  SELECT w, toks FROM fresh
  UNION
  SELECT w, list(tok ORDER BY pos) AS toks FROM (
    SELECT w, pos, CASE WHEN here THEN merged ELSE tok END AS tok,
           coalesce(lag(here) OVER (PARTITION BY w ORDER BY pos), false) AS eaten
    FROM (
      SELECT w, pos, tok, merged, best AND (pos - max(CASE WHEN best THEN NULL ELSE pos END)
               OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING)) % 2 = 1 AS here
      FROM (
        SELECT p.w, p.pos, p.tok, m.merged,
               m.rank IS NOT NULL AND m.rank = min(m.rank) OVER (PARTITION BY p.w) AS best,
               min(m.rank) OVER (PARTITION BY p.w) IS NOT NULL AS alive
        FROM (SELECT w, toks, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM st
              UNION ALL SELECT w, toks, NULL, 0 FROM st) p
        LEFT JOIN merges m ON m.a = p.tok AND m.b = p.toks[p.pos + 1]
      ) WHERE alive
    )
  ) WHERE NOT eaten AND pos > 0 GROUP BY w
)
SELECT w, toks FROM st
"""


def contract(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same contraction of one list of ids with a queue of its pairs: least rank
    first, then leftmost. Its work grows with the length times its logarithm."""
    n = len(ids)
    token: list[int | None] = list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
    queue = [(rank, i, a, b, merged) for rank, merged, i, a, b in queue]
    heapify(queue)
    while queue:
        _, i, a, b, merged = heappop(queue)
        j = after[i]
        if j >= n or token[i] != a or token[j] != b:
            continue  # one of the two was merged with another neighbour
        token[i], token[j] = merged, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (m := merges.get((token[left], token[right]))):
                heappush(queue, (m[0], left, token[left], token[right], m[1]))
    return [t for t in token if t is not None]


class PartitionEncoder:
    """Words to ids in one DuckDB database in memory, for one partition."""

    def __init__(self, path: str):
        self.bytes_to_id, merges = load_merges(path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB"})
        self.db.execute("SET preserve_insertion_order = false")
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.merges, self.pairs = merges, None
        self.known: dict[str, list[int]] = {}
        self.word = regex.compile(WORD_PATTERN)

    def _contract_long(self, data: bytes) -> list[int]:
        if self.pairs is None:
            a, b, rank, merged = (self.merges.column(c).to_pylist() for c in ("a", "b", "rank", "merged"))
            self.pairs = dict(zip(zip(a, b), zip(rank, merged)))
        return contract([self.bytes_to_id[x] for x in data], self.pairs)

    def learn(self, words: list[str]) -> None:
        for w in [w for w in words if len(w) * 4 > QUERY_BYTES]:
            data = w.encode("utf-8", "surrogatepass")
            if len(data) > QUERY_BYTES:
                self.known[w] = self._contract_long(data)
        words = [w for w in words if w not in self.known]
        for i in range(0, len(words), WORDS_PER_QUERY):
            block = words[i : i + WORDS_PER_QUERY]
            toks = [[self.bytes_to_id[b] for b in w.encode("utf-8", "surrogatepass")] for w in block]
            fresh = pa.table({"w": pa.array(range(len(block)), pa.int32()), "toks": pa.array(toks, pa.list_(pa.int32()))})
            self.db.register("fresh", fresh)
            out = self.db.sql(CONTRACT).to_arrow_table()
            self.db.unregister("fresh")
            for w, ids in zip(out.column("w").to_pylist(), out.column("toks").to_pylist()):
                self.known[block[w]] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for null and empty ones."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        cut = [self.word.findall(t) if t else [] for t in texts]
        new = {w for ws in cut for w in ws if w not in self.known}
        self.learn(sorted(new, key=len))
        known = self.known
        return [[i for w in ws for i in known[w]] for ws in cut]


def encode_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids): the ids of each document's text, without special tokens.

    Encoding needs no shuffle: each partition cuts its texts into words and
    encodes each distinct word once, by a recursive query that contracts the
    leftmost pair of minimum rank until none is left. Null and empty texts
    give an empty list; the tokens' names in a text are ordinary text. Every
    row of the table gives a row.
    """
    path = os.path.join(folder, tokenizer)

    def run(batches):
        enc = None
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                enc = enc or PartitionEncoder(path)
                ids = enc.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(encoded: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, n_docs, n_tokens, n_empty) of encoded documents."""
    n = encoded.select("doc_id", F.size("ids").alias("n"))
    return documents.select("doc_id", "source").join(n, "doc_id").groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n").cast("bigint").alias("n_tokens"), F.count_if(F.col("n") == 0).alias("n_empty")
    )
