import os
import random

import pytest

from lexweave.llm import bpe
from lexweave.session import table

tokenizers = pytest.importorskip("tokenizers")
PATH = os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TEXTS = [None, "", " ", "\n\n  \t x", "<|endoftext|>", "we're I'LL 'twas", "가나다 漢字 Жук", "á ​ x", "😀👍🏽", "aaa bbbbb aaaa", "a" * 2500, "=" * 777, " " * 900 + "x", "1234567 12.5e-3", "word " * 3000]


def test_edge_texts(spark, library):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_documents(df).collect()}
    assert got == dict(enumerate(library(TEXTS)))


def test_whole_corpus_and_round_trip(spark, library):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_documents(docs).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], library([r["text"] for r in rows])))
    t = tokenizers.Tokenizer.from_file(PATH)
    for r in rows[:50]:
        assert t.decode(got[r["doc_id"]], skip_special_tokens=False) == (r["text"] or "")


def test_long_runs_without_a_break(library):
    """Half a million letters in a row, and the same way for short words."""
    rng = random.Random(1)
    enc = bpe.PartitionEncoder(PATH)
    long = ["".join(rng.choice("etaoinshrdlu") for _ in range(500_000)), "a" * 100_001, "가" * 5000, "=" * 3001]
    assert enc.encode(long) == library(long)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    data = [w.encode() for w in words]
    assert [enc._contract_long(d) for d in data] == library(words)


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
