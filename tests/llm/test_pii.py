import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import pii
from lexweave.session import table

from .heldout import TEXTS

#: Measured on ``heldout``, see README.
LEAST_RECALL, LEAST_RECALL_ALONE, LEAST_PRECISION = 0.9, 0.9, 0.9


def found(text):
    return {(k, text[a:z]) for k, a, z in pii.spans(text)}


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("Write to a.b+c@d-e.example, or ask.", "email", "a.b+c@d-e.example"),
        ("reply-to=x_y [at] post.v.example;status", "email", "x_y [at] post.v.example"),
        ("go to <q(at)club(dot)example> only", "email", "q(at)club(dot)example"),
        ("Meet at gate 7 @ noon.", "email", None),
        ("Call +44 20 7946 0550 to", "phone", "+44 20 7946 0550"),
        ("Call (202) 555-0177 to", "phone", "(202) 555-0177"),
        ("연락처 01000003679 (문자", "phone", "01000003679"),
        ("Fax/phone: 01632 960818, weekdays", "phone", "01632 960818"),
        ("code 000-1-23456-78 is", "phone", None),
        ("Prices start at $1,250.00 per seat", "phone", None),
        ("주민등록번호 331403-3386570 을", "id_number", "331403-3386570"),
        ("number (000 51 9668) was", "id_number", "000 51 9668"),
        ("Passport No. ZZ6742817 was", "id_number", "ZZ6742817"),
        ("여권번호: X0411957Q", "id_number", "X0411957Q"),
        ("100000000000000000000 3.14", "id_number", None),
        ("lives at 4841 Marrowgate Road, Suite 914, Brakenford 00219 and", "address", "4841 Marrowgate Road, Suite 914, Brakenford 00219"),
        ("to 2474 Greywick St. #11 (ring", "address", "2474 Greywick St. #11"),
        ("Maple Avenue is open", "address", None),
        ("교재는 가람시 물빛구 참새로 23-14 으로", "address", "가람시 물빛구 참새로 23-14"),
        ("주소: 미르시 노을동 은하수길 42 113동 849호", "address", "미르시 노을동 은하수길 42 113동 849호"),
        ("by O. Lindlino last night", "name", "O. Lindlino"),
        ("Dear Ms. Quenez, your", "name", "Quenez"),
        ("Hi Sabira, thanks", "name", "Sabira"),
        ("Examinee: Vedin, Yardel", "name", "Vedin, Yardel"),
        ("is Luwyn L. Pashkov again", "name", "Luwyn L. Pashkov"),
        ("담당자 표새론결 님께", "name", "표새론결"),
        ("담당자 미정, 주소 미정", "name", None),
        ("CANDIDATE NAME: AMAKA MOONRECHT", "name", "AMAKA MOONRECHT"),
    ],
)
def test_forms(text, kind, want):
    got = {t for k, t in found(text) if k == kind}
    assert (want in got) if want else not got


def test_model_separates_by_votes():
    patterns = [((1, 1, 0, 0, 0, 0), 50), ((1, 0, 0, 1, 0, 0), 30), ((0, 0, -1, 0, -1, 0), 900), ((0, 0, -1, 0, 0, 0), 100)]
    post = pii.weigh(patterns, 0.5)
    p = pii.fit([(v, 6 if v[0] else 0, n) for v, n in patterns], post)
    assert (p[:2] > 0.5).all() and (p[2:] < 0.5).all() and np.isfinite(p).all()
    many = pii.weigh([(v, n * 1000) for v, n in patterns], 0.5)
    assert np.allclose(post, many)


def test_words_around_tell_what_no_labeler_knows(spark):
    """Names of two unknown words are told by the words that stand beside introduced ones."""
    first, last = ["Amber", "Boris", "Celia", "Doran", "Esme", "Farid", "Gitte", "Hanno"], ["Kolm", "Lorve", "Munt", "Nask", "Orrel", "Prenn", "Quast", "Rilk"]
    rows = [(i, f"The tall winner was Ms. {first[i % 8]} {last[i // 8 % 8]} from upstairs again. Old {last[i % 8]}ia Harbour Fair opened.", "x") for i in range(64)]
    rows += [(100 + i, f"The tall winner was {a}ka {b}ov from upstairs again.", "x") for i, (a, b) in enumerate(zip(first, last))]
    got = {(r["doc_id"], r["found_text"]) for r in pii.found(spark.createDataFrame(rows, DOC)).collect() if r["doc_id"] >= 100}
    assert got == {(100 + i, f"{a}ka {b}ov") for i, (a, b) in enumerate(zip(first, last))}


def _score(found, want):
    hit = len(found & want)
    return hit / max(1, len(want)), hit / max(1, len(found))


def test_unlike_sentences(spark):
    """Recall and precision on sentences that have nothing of the corpus, beside it and alone."""
    own = [(10**6 + i, t, "x") for i, (t, _) in enumerate(TEXTS)]
    want = {(10**6 + i, k, f) for i, (_, fs) in enumerate(TEXTS) for k, f in fs}
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", F.lit("x").alias("kind"))
    frame = spark.createDataFrame(own, DOC)
    for rows, recall, precision in ((docs.unionByName(frame), LEAST_RECALL, LEAST_PRECISION), (frame, LEAST_RECALL_ALONE, LEAST_PRECISION)):
        got = {tuple(r) for r in pii.found(rows).collect() if r["doc_id"] >= 10**6}
        r, p = _score(got, want)
        print("recall", r, "precision", p, "missed", sorted(want - got), "wrong", sorted(got - want))
        assert r >= recall and p >= precision


def test_copies_of_the_corpus_change_no_verdict(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    many = docs.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("_n")
    assert sorted(map(tuple, pii.found(docs).collect())) == sorted(map(tuple, pii.found(many).collect()))


def test_same_id_with_different_texts(spark):
    rows = [*BASE, (1, "Call 010-0000-1234 to change.", "x"), (1, "Mail a.bcdefghijklm@c.example now.", "x")]
    got = {(r["kind"], r["found_text"]) for r in pii.found(spark.createDataFrame(rows, DOC)).collect() if r["doc_id"] == 1}
    assert got == {("phone", "010-0000-1234"), ("email", "a.bcdefghijklm@c.example")}


def test_many_spans_in_one_text(spark):
    text = "Call 010-0000-1234 or mail a.b@c.example. " * 20_000
    rows = pii.find_spans(spark.createDataFrame([*BASE, (1, text, "x")], DOC)).where("doc_id = 1")
    assert rows.count() == 40_000


def test_nothing_found_is_stored(spark, tmp_path):
    stored = pii.candidates(spark.createDataFrame([(1, "Mail velna.korima@c.example, Ms. Korima.", "x")], DOC))
    assert not any("orima" in str(v) for r in stored.collect() for v in r)


DOC = "doc_id long, text string, kind string"
BASE = [(100 + i, f"Please ask for Velna Korim{'abcdefghij'[i % 10]} at the counter. Call 010-0000-{1000 + i} to change. The harbor office met. Late Sone Foods sold tickets.", "x") for i in range(60)]


def test_redaction_keeps_the_rest(spark):
    rows = [*BASE, (1, None, "x"), (2, "", "x"), (3, "Nothing here.", "x"), (4, "Write to a.b@c.example, or ask. " * 500, "x"), (5, "Order 202-118-4471 ships.", "x")]
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, DOC)).collect()}
    assert len(out) == len(rows)
    assert out[1] is None and out[2] == "" and out[3] == "Nothing here."
    assert out[4] == "Write to [EMAIL], or ask. " * 500
    assert out[100] == "Please ask for [NAME] at the counter. Call [PHONE] to change. The harbor office met. Late Sone Foods sold tickets."


def test_found_is_in_the_text(spark, sf):
    docs = table(spark, sf, "documents")
    rows = pii.found(docs)
    assert rows.count() == rows.distinct().count() > 0
    assert rows.join(docs.select("doc_id", "text"), "doc_id").where("instr(text, found_text) = 0").count() == 0


def test_empty_table(spark):
    assert pii.found(spark.createDataFrame([], DOC)).count() == 0
