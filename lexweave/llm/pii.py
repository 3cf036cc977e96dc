"""Personal information in free text: labelers vote, EM weighs them, a span classifier decides (problem 10)."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

KINDS = ("email", "id_number", "phone", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "id_number": "[ID]", "phone": "[PHONE]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Rounds of expectation-maximisation and of the classifier's training.
EM_ROUNDS = 25
FIT_ROUNDS = 400
#: Words around a span that the classifier sees, by place, and the buckets their
#: hashes fall into per kind and place: the bound of what it learns about words.
SLOTS = (-2, -1, 1, 2)
BUCKETS = 1 << 14
#: Steps of the score of these words.
SCORE_STEPS = (-3.0, -1.5, -0.5, 0.5, 1.5, 3.0)

# -- fixed values: general words that organisations, places, labels and times are told by ---
ORGANISATIONS = [
    "Agency", "Airlines", "Airways", "Associates", "Association", "Authority", "Bank", "Bakery", "Books", "Brothers", "Bureau", "Cafe", "Center", "Centre", "Church", "Clinic", "Club", "College",
    "Committee", "Company", "Consulting", "Co", "Corp", "Corporation", "Council", "Department", "Electric", "Electronics", "Energy", "Enterprises", "Farm", "Farms", "Finance", "Financial", "Foods",
    "Foundation", "Furniture", "Garage", "Group", "Hardware", "Holdings", "Hospital", "Hotel", "Hotels", "Inc", "Industries", "Institute", "Insurance", "International", "Laboratories", "Library",
    "Limited", "LLC", "Logistics", "Ltd", "Manufacturing", "Market", "Media", "Ministry", "Motors", "Museum", "Office", "Partners", "Pharmacy", "Plc", "Press", "Printing", "Publishing", "Restaurant",
    "School", "Services", "Shop", "Society", "Software", "Solutions", "Store", "Stores", "Studio", "Supply", "Systems", "Technologies", "Textiles", "Theater", "Theatre", "Trading", "Travel", "Union", "University",
]
PLACES = [
    "Airport", "Ave", "Avenue", "Bay", "Beach", "Blvd", "Boulevard", "Bridge", "Building", "Castle", "City", "County", "Court", "District", "Drive", "Edition", "Festival", "Garden", "Gardens", "Gate", "Hall", "Harbor", "Hill",
    "Island", "Lake", "Lane", "Mountain", "Palace", "Park", "Plaza", "Rd", "River", "Road", "Square", "St", "Station", "Street", "Tower", "Town", "Valley", "Village", "Way",
]
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Mx", "Dr", "Prof", "Professor", "Sir", "Madam"]
NOT_NAMES = [
    "The", "This", "That", "These", "Those", "Dear", "Hi", "Hello", "Hey", "Please", "Sincerely", "Regards", "Members", "Member", "Everyone", "Someone", "Anyone", "Everybody", "Somebody", "Anybody", "Nobody", "All", "Team",
    "Customer", "Reader", "Readers", "Student", "Students", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
]
NOT_NAMES_KO = ["미정", "없음", "미상", "익명", "여러분", "고객", "회원", "선생", "담당", "전원"]
#: Labels that a person's name follows (fixed values).
NAME_LABELS = ["name", "full name", "candidate", "examinee", "applicant", "author", "teacher", "tutor", "student", "signed", "attn", "attention", "contact person", "recipient", "sender", "passenger", "patient", "owner"]
NAME_LABELS_KO = ["작성자", "담당자", "응시자", "이름", "성명", "학생", "강사", "저자", "신청자", "수신자", "발신자", "대표"]

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?"
_AT = r"(?:@|\s?[\[(<{]\s?at\s?[\])>}]\s?|\s+at\s+(?=[A-Za-z0-9\-]+\s+dot\s))"
_DOT = r"(?:\.|\s?[\[(<{]\s?dot\s?[\])>}]\s?|\s+dot\s+)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+\-]){_LOCAL}{_AT}[A-Za-z0-9][A-Za-z0-9\-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9\-]*)+", re.I)
_MAY_MAIL = re.compile(r"@|[\[(<{]\s?at\s?[\])>}]|\sdot\s", re.I)
PHONE = re.compile(
    r"(?<![\w.+\-/])(?:\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,5}|\(0?\d{1,4}\)[ \-]?\d{3,4}[ .\-]?\d{4}|0\d{1,3}[\-. ]\d{3,4}[\-. ]\d{4}|\d{3}[\-.]\d{3}[\-.]\d{4}|\d{3} \d{3} \d{4}|0\d{4} \d{6}|0\d{9,10})(?![\w]|[\-.]\d)"
)
ID_NUMBER = re.compile(r"(?<![\w\-.+])(?:\d{6}-\d{7}|\d{13}|\d{3}[\- ]\d{2}[\- ]\d{4}|[A-Z]{2}\d{7}|[A-Z]\d{7,8}[A-Z]?|[A-Z]\d{3}[A-Z]\d{4})(?![\w]|[\-.]\d)")
ADDRESS = re.compile(
    r"(?<![\w\-.,#$])\d{1,5}[A-Za-z]? (?:[A-Z][a-z]+ ){1,3}(?:Street|Avenue|Road|Lane|Way|Boulevard|Drive|Court|Place|Square|Rd|Ave|Dr|Ln|St\.|Blvd\.|Rd\.|Ave\.|Dr\.|Ln\.|St|Blvd)(?![\w])"
    r"(?:,?\s(?:Apt|Apartment|Suite|Ste|Unit|Floor|Fl|Room|No)\.?\s#?\d+[A-Za-z]?|,?\s#\s?\d+[A-Za-z]?|,?\s\d+(?:st|nd|rd|th) [Ff]loor){0,2}"
    r"(?:,\s[A-Z][a-z]+(?:[ \-][A-Z][a-z]+)?(?:,?\s[A-Z]{2})?(?:\s\d{5}(?:-\d{4})?(?!\d))?|,?\s\d{5}(?!\d))?"
)
ADDRESS_KO = re.compile(
    r"(?<![가-힣])(?:[가-힣]+(?:특별시|광역시|시|도|군)\s)(?:[가-힣]+(?:시|군|구|읍|면|동|리)\s){0,3}[가-힣\d]+(?:대로|로|길)\s?\d+(?:-\d+)?(?:번지)?"
    r"(?:,?\s?\d+동(?![가-힣]))?(?:,?\s?\d+층(?![가-힣]))?(?:,?\s?\d+호(?![가-힣]))?(?:\s?\(?\d{5}\)?(?!\d))?"
)
_U, _L = "A-ZÀ-ÖØ-ÞĀ-ſА-ЯЁ", "a-zß-öø-ÿĀ-ſа-яё"
_WORD = rf"[{_U}](?:['’][{_U}])?[{_L}]+(?:['’\-][{_U}]?[{_L}]+)?"
_INI = rf"[{_U}]\."
NAME = re.compile(
    rf"(?<![\w@.+\-])(?:{_WORD}, {_WORD}(?![\w@])|{_WORD} {_INI} {_WORD}|(?:{_INI} ?){{1,2}}{_WORD}|{_WORD} {_WORD}|{_WORD})(?![\w@]|[\-+_.]\w)"
)
_LABEL = rf"(?:(?:{'|'.join(NAME_LABELS)})\s*:|(?:{'|'.join(NAME_LABELS_KO)})\s*:?)\s*"
NAME_CAPS = re.compile(rf"(?i:name|candidate|examinee|applicant|passenger)\s*:\s*([{_U}]{{2,}}(?: [{_U}]\.)? [{_U}]{{3,}}|[{_U}]{{3,}}(?! [{_U}]))(?![\w])")
NAME_KO = re.compile(rf"(?<![가-힣])[가-힣]{{2,5}}(?=\s?(?:님|씨|군|양|선생)(?![가-힣]{{2}})|\s*(?:\n|$))|(?:{'|'.join(NAME_LABELS_KO)})(?:\s*:)?\s+([가-힣]{{2,5}})(?![가-힣])")

_TITLE = rf"(?:{'|'.join(TITLES)})\.?\s+"
#: General words before and after each kind; a labeler each (fixed values).
BEFORE = {
    "email": r"(?:e-?mails?|mailto|mail|contact|write to|reply[- ]to|send .{0,30} to|이메일|메일|문의는|문의)\W*$",
    "phone": r"(?:call|text|tel|telephone|phone|fax|mobile|cell|dial|reach(?:ed)? (?:\w+ )?at|연락처|전화|휴대폰|팩스)\W*$",
    "id_number": r"(?:social security(?: number| no)?|ssn|passport(?: number| no)?|registration(?: number| no)?|national id|license no|주민등록번호|외국인등록번호|여권번호|\bid(?: number| no)?)\W*$",
    "address": r"(?:address|lives? at|living at|resid(?:es|ing) at|moved to|located at|(?:deliver|ship|mail|send|sent)(?:ed|ped)?\b.{0,25} to|주소|배송지|거주지)\W*$",
    "name": rf"(?:{_TITLE}|(?:Dear|Hi|Hello)\s+(?:{_TITLE})?|(?i:sincerely|regards|yours truly|best wishes),\s*\n\s*|\b(?:made|written|checked|graded|corrected|signed|prepared|taught|taken|approved|reviewed|edited|presented|sent) by\s+|\bask for\s+|\b(?:name is|named|I am)\s+|(?i:{_LABEL}))$",
}
AFTER = {
    "email": r"^\W*(?:으로|로 보내)",
    "phone": r"^\W*(?:ext|mobile|home|work|weekdays|문자|번으로|으로 전화)",
    "id_number": r"^\W*(?:을|를|was|is)\b",
    "address": r"^\W*(?:으로 보내|로 보내|에 사는|에 거주)",
    "name": r"^(?:\s?(?:님|씨)|,? (?:said|says|wrote|writes|told|asked|replied|added|explained|signed|called|presented|thanked)\b|,\s*\n|['’]s )",
}
AGAINST = {
    "email": r"(?!)",
    "phone": r"(?:order|isbn(?:-like)?|item(?: no)?|version|score|bus|code|model|serial|invoice|number|no|q|page|security|등록번호)\W*$",
    "id_number": r"(?:order|isbn(?:-like)?|item(?: no)?|version|score|code|model|serial|invoice|room|flight|call|text|tel|phone|연락처)\W*$",
    "address": r"(?:room|bus|gate|q|page|order|open|version)\W*$",
}
#: A word right before a name that speaks against one (fixed values).
_NAME_AGAINST = {"the", "a", "an", "from", "about", "at", "in", "of", "through", "beside", "near", "behind"}
_re = {d: {k: re.compile(v, re.I if k != "name" else 0) for k, v in t.items()} for d, t in (("b", BEFORE), ("a", AFTER), ("x", AGAINST))}
#: Last words of what stands before a name, in the case they have there: others needn't be looked at.
_last_word = re.compile(r"(\w+|[^\w\s])\W?\s*$")
_NAME_LEADS = {*TITLES, "Dear", "Hi", "Hello", "by", "for", "is", "named", "am", *NAME_LABELS_KO}
_ORG = set(ORGANISATIONS) | set(PLACES)
_STOP = set(NOT_NAMES) | set(TITLES) | set(ORGANISATIONS) | set(PLACES)
_NO_PART = set(NOT_NAMES) | set(TITLES)
_last = re.compile(rf",? ([{_U}{_L}]+)$")
_opens = re.compile(r"(?:^|[.!?:;]['\"”’)]*\s|\n)\s*$")
_part = re.compile(r"[^\W\d_]{2,}")
_lead = re.compile(rf"([{_U}{_L}]+)[.,]?\s+(?=\S)")
_first = re.compile(rf"[{_U}{_L}]+")


def _parts(name: str) -> list[str]:
    return _part.findall(name)


def _may_label(tail: str) -> bool:
    return ":" in tail or "," in tail or "\n" in tail


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    """A name's span without a title, greeting or other known word before it."""
    while True:
        m = _lead.match(text, start, end)
        if m and m[1].capitalize() in _STOP:
            start = m.end()
        else:
            return start, end


def spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidate spans (kind, start, end) by form alone."""
    if _MAY_MAIL.search(text):
        for m in EMAIL.finditer(text):
            yield "email", m.start(), m.end()
    if _may_number.search(text):
        for kind, p in (("phone", PHONE), ("id_number", ID_NUMBER), ("address", ADDRESS), ("address", ADDRESS_KO)):
            for m in p.finditer(text):
                yield kind, m.start(), m.end()
    yield from name_spans(text)


_may_number = re.compile(r"\d")
_hangul = re.compile("[가-힣]")


def name_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidate names."""
    at = 0
    while m := NAME.search(text, at):  # a known word before a name is dropped, and the search goes on behind it
        a, z = _trim(text, m.start(), m.end())
        first = _first.match(text, a, z)
        if first and first[0] in _STOP:
            at = a + len(first[0])
            continue
        if a != m.start():
            at = a
            continue
        last = _last.search(text, a, z)
        if last and last[1] in _NO_PART:  # a greeting or title behind a name belongs to what follows
            z = last.start()
        yield "name", a, z
        at = z
    for m in NAME_CAPS.finditer(text):
        yield "name", *m.span(1)
    if _hangul.search(text):
        for m in NAME_KO.finditer(text):
            a, z = m.span(1) if m[1] else m.span()
            if text[a:z] not in NOT_NAMES_KO:
                yield "name", a, z


def _resident_number(digits: str) -> bool:
    """Month, day and century mark of a resident registration number."""
    return 1 <= int(digits[2:4]) <= 12 and 1 <= int(digits[4:6]) <= 31 and digits[6] in "1234567890"


def _line(text: str, start: int, end: int) -> str:
    return text[text.rfind("\n", 0, start) + 1 : (text.find("\n", end) + 1 or len(text) + 1) - 1].strip()


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """One vote per labeler that looks at the text alone: 1 for, -1 against, 0 none.

    Context before, context after, context against, gazetteer, dictionary,
    form. Names get their votes of gazetteer and dictionary from the corpus
    (``with_corpus_votes``).
    """
    before, after, found = text[max(0, start - 60) : start], text[end : end + 30], text[start:end]
    near = before[-24:]
    last = _last_word.search(near) if kind == "name" else None
    last = last[1] if last else ""
    b = 1 if (kind != "name" or last in _NAME_LEADS or not last.isalpha() or _may_label(near[-6:])) and _re["b"][kind].search(before) else 0
    a = 1 if _re["a"][kind].match(after) else 0
    x = -1 if not b and (last in _NAME_AGAINST and before[-1:].isspace() if kind == "name" else _re["x"][kind].search(before)) else 0
    gaz = dic = form = 0
    if kind == "name":
        parts = _parts(found)
        if _hangul.search(found):
            form = 1 if 3 <= len(found) <= 5 else 0
        else:
            nxt = _next_word.match(after)
            if nxt and nxt[1] in _ORG or parts and parts[-1] in _ORG:
                x = -1
            elif not b and len(parts) == 1 and _opens.search(near[-8:]):
                x = -1  # the sentence begins here, which explains the capital
            if any(p in _STOP for p in parts):
                dic = -1
            form = 1 if _initial.search(found) or len(parts) == 2 and found == _line(text, start, end) else 0
        return b, a, x, gaz, dic, form
    line = _line(text, start, end)
    if kind == "phone":
        digits = sum(c.isdigit() for c in found)
        gaz = 1 if found[0] in "+(0" else 0
        dic = -1 if not 9 <= digits <= 14 else 0
        form = 1 if line == found else 0
    elif kind == "email":
        gaz = 1 if "@" in found else 0
        form = 1 if re.search(r"(?i)\.[a-z]{2,}$|dot", found) else 0
        dic = -1 if re.search(r"\s", found) and "dot" not in found.lower() and "at" not in found.lower() else 0
    elif kind == "id_number":
        gaz = 1 if re.fullmatch(r"\d{6}-\d{7}|\d{3}-\d{2}-\d{4}", found) else 0
        form = 1 if line == found else 0
        dic = -1 if not b and not a and re.fullmatch(r"\d{13}|[A-Z]\d{3}[A-Z]\d{4}", found) else 0
    else:
        gaz = 1 if re.search(r",|#|\d{5}$|층|호$|[가-힣]", found[5:]) else 0
        dic = -1 if re.match(r"\s+(?:Festival|Edition|Station|School|Market|Tickets)", after) else 0
        form = 1 if line.endswith(found) else 0
    return b, a, x, gaz, dic, form


_next_word = re.compile(rf"\s+([{_U}][{_L}]+)")
_initial = re.compile(rf"{_INI}|, ")
_context = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|\n")


def context(text: str, start: int, end: int) -> tuple[int, ...]:
    """Buckets of the two words or marks before and after a span, numbers made alike."""
    before, after = _context.findall(text[max(0, start - 32) : start])[-2:], _context.findall(text[end : end + 32])[:2]
    words = [""] * (2 - len(before)) + before + after + [""] * (2 - len(after))
    return tuple(map(_bucket, words))


@lru_cache(100_000)
def _bucket(word: str) -> int:
    return crc32(b"#" if word.isdigit() else word.lower().encode("utf-8", "replace")) % BUCKETS


@lru_cache(100_000)
def _word_key(word: str) -> int:
    """64 bits of a word, in place of the word itself."""
    data = word.lower().encode("utf-8", "replace")
    return (crc32(data) << 32 | crc32(data, 0x9E3779B9)) - (1 << 63)


#: Candidates as they are stored: no text, but places, votes, and hashes of words.
STORED = "doc_id bigint, text_id bigint, kind string, start int, end int, votes array<int>, hangul boolean, strong boolean, p1 bigint, p2 bigint, p3 bigint, around array<int>"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
_NAMES = [c.split()[0] for c in STORED.split(", ")]


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_id"), "text").where("text is not null and text <> ''")


def candidates(documents: DataFrame) -> DataFrame:
    """All candidate spans (``STORED``), each with the votes of the labelers that look at the text alone.

    Every text is read by Python once, here. No candidate is dropped.
    """

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, text_id, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                for kind, s, e in spans(t):
                    v, parts = votes(kind, t, s, e), ()
                    if kind == "name":
                        found = t[s:e]
                        hangul = _hangul.search(found) is not None
                        parts = [found] if hangul else _parts(found)
                    keys = [_word_key(w) for w in dict.fromkeys(parts)][:3] + [None] * 3
                    out.append((doc, text_id, kind, s, e, v, bool(parts) and hangul, v[0] > 0, *keys[:3], context(t, s, e)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _TYPES)], names=_NAMES)

    return _texts(documents).mapInArrow(run, STORED)


def _words(documents: DataFrame) -> DataFrame:
    """(word, w): in how many texts a word stands in lower case or Hangul."""
    pattern = r"(?<![A-Za-z'’@.\-_+=0-9])\p{Ll}{2,}(?![A-Za-z@\-_+0-9]|\.[a-z]|\s?[\[(]at)|[가-힣]+"
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    return documents.where("text is not null").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("w"))


def part_counts(cands: DataFrame, documents: DataFrame) -> DataFrame:
    """(part, w, c, names, others) of each part of a candidate name: texts with it as
    an ordinary word, candidates with it, and the unlike texts that have it behind
    words that introduce a name, or elsewhere."""

    def keyed(batches):
        for b in batches:
            keys = [_word_key(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(1)], names=["part", "w"])

    words = _words(documents).mapInArrow(keyed, "part bigint, w bigint")
    parts = cands.where("kind = 'name'").select("text_id", "strong", F.explode(F.array_compact(F.array("p1", "p2", "p3"))).alias("part"))
    texts = parts.groupBy("part", "strong", "text_id").agg(F.count("*").alias("c"))
    seen = texts.groupBy("part").agg(F.sum("c").alias("c"), F.count_if("strong").alias("names"), F.count_if(~F.col("strong")).alias("others"))
    return seen.join(words, "part", "left").select("part", F.coalesce("w", F.lit(0)).alias("w"), "c", "names", "others")


def with_corpus_votes(cands: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates with ``votes`` as text, gazetteer and dictionary of names told by the whole corpus.

    All parts of a name known from other texts speak for it; a part that is an
    ordinary word, or mostly stands where names are not introduced, against.
    """
    rows = cands
    for i in (1, 2, 3):
        own = counts.select(F.col("part").alias(f"p{i}"), F.struct("w", "c", "names", "others").alias(f"s{i}"))
        rows = rows.join(own, f"p{i}", "left")
    stats = F.array_compact(F.array("s1", "s2", "s3"))
    here = F.when(F.col("strong"), 1).otherwise(0)
    known = (F.size(stats) > 0) & F.forall(stats, lambda s: s["names"] - here >= 1)
    plain = F.when(F.col("hangul"), F.exists(stats, lambda s: s["w"] > 3 * s["c"])).otherwise(
        F.exists(stats, lambda s: (s["w"] >= s["c"]) | (s["others"] > 5 * s["names"] + 5))
    )
    v = F.col("votes")
    named = F.array(v[0], v[1], v[2], F.when(known, 1).otherwise(0), F.when((v[4] < 0) | plain, -1).otherwise(0), v[5])
    final = F.when(F.col("kind") == "name", named).otherwise(v)
    return rows.select("doc_id", "text_id", "kind", "start", "end", F.array_join(final.cast("array<string>"), ",").alias("votes"), "around")


#: Share of true spans that is assumed at first, per kind.
PRIOR = {"email": 0.9, "phone": 0.7, "id_number": 0.7, "address": 0.8, "name": 0.5}


def weigh(patterns: list[tuple[tuple[int, ...], int]], prior: float) -> np.ndarray:
    """Posterior of each vote pattern by expectation-maximisation over two classes.

    Each labeler has for either class its own probabilities of voting for,
    against or not at all; they start from the plain sum of votes.
    """
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    little = n.sum() / 1000  # smoothing in proportion, so copies of all texts change nothing
    post = 1 / (1 + np.exp(-(2.0 * v.sum(axis=1) + np.log(prior / (1 - prior)))))
    for _ in range(EM_ROUNDS):
        share = (n @ post + little) / (n.sum() + 2 * little)
        score = np.full(len(n), np.log(share) - np.log(1 - share))
        for j in range(v.shape[1]):
            for vote in (-1, 0, 1):
                here = v[:, j] == vote
                yes, no = (n * post)[here].sum() + little, (n * (1 - post))[here].sum() + little
                # a vote for never counts against, nor one against for
                gain = np.log(yes / ((n @ post) + 3 * little)) - np.log(no / ((n @ (1 - post)) + 3 * little))
                score[here] += max(gain, 0) if vote > 0 else min(gain, 0) if vote < 0 else np.clip(gain, -1, 1)
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return post


def word_gains(cands: DataFrame, post: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """(kind, place) -> by bucket, the log-odds that the word there speaks for a true span.

    Counted over all candidates, weighed by their posterior, the copies of a text
    as one; at most ``BUCKETS`` numbers come back per kind and place.
    """
    rows = cands.select("kind", "votes", "share", F.posexplode("around").alias("slot", "bucket"))
    yes, no = F.col("share") * F.col("p"), F.col("share") * (1 - F.col("p"))
    sums = rows.join(F.broadcast(post), ["kind", "votes"]).groupBy("kind", "slot", "bucket").agg(F.sum(yes).alias("yes"), F.sum(no).alias("no"))  # few patterns
    told = sums.toArrow()
    kinds, slots = np.array(told["kind"].to_pylist(), object), told["slot"].to_numpy()
    places, all_yes, all_no = (told[c].to_numpy() for c in ("bucket", "yes", "no"))
    out = {}
    for key in sorted(set(zip(kinds.tolist(), slots.tolist()))):
        own = (kinds == key[0]) & (slots == key[1])
        at, yes, no = places[own], all_yes[own], all_no[own]
        base = np.log((yes.sum() + 1) / (no.sum() + 1))
        gains = np.zeros(BUCKETS)
        # a word must be seen to speak: two pseudo-spans with the kind's own odds
        prior = yes.sum() / (yes.sum() + no.sum())
        gains[at] = np.log((yes + 2 * prior) / (no + 2 * (1 - prior))) - base
        out[key] = np.clip(gains, -4, 4)
    return out


def _scored(cands: DataFrame, gains: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """Candidates with ``score``, the step of the sum of their words' log-odds."""
    shared = cands.sparkSession.sparkContext.broadcast(gains)
    none = np.zeros(BUCKETS)

    def run(batches):
        for b in batches:
            kinds = np.array(b.column("kind").to_pylist(), object)
            around = b.column("around").flatten().to_numpy().reshape(b.num_rows, len(SLOTS))
            total = np.zeros(b.num_rows)
            for kind in set(kinds.tolist()):
                here = kinds == kind
                for slot in range(len(SLOTS)):
                    total[here] += shared.value.get((kind, slot), none)[around[here, slot]]
            score = pa.array(np.digitize(total, SCORE_STEPS).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _PLACED), score], names=[*_PLACED, "score"])

    return cands.mapInArrow(run, "doc_id bigint, text_id bigint, kind string, start int, end int, votes string, score int")


_PLACED = ["doc_id", "text_id", "kind", "start", "end", "votes"]


def fit(patterns: list[tuple[tuple[int, ...], int, int]], post: np.ndarray) -> np.ndarray:
    """Span classifier: logistic regression on the votes and the score of the words
    around, trained on the weighed labels; the probability of each pattern
    (votes, score, number of spans)."""
    v = np.array([p for p, _, _ in patterns])
    words = np.array([s for _, s, _ in patterns], float) - len(SCORE_STEPS) / 2
    x = np.concatenate([v > 0, v < 0, np.ones((len(v), 1)), words[:, None] / len(SCORE_STEPS) * 2], axis=1).astype(float)
    n = np.array([c for _, _, c in patterns], float)
    n = np.sqrt(n) / np.sqrt(n).sum()
    w = np.zeros(x.shape[1])
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 4.0 * (x.T @ (n * (p - post)) + 1e-4 * w)
    return 1 / (1 + np.exp(-x @ w))


def _patterns(rows: DataFrame, *by: str) -> dict[str, list]:
    """kind -> [(votes, ..., number)]: few rows, as there are at most 3 to the number of labelers, times the steps of the score."""
    seen: dict[str, list] = {}
    for r in rows.groupBy("kind", "votes", *by).agg(F.count("*").alias("n")).orderBy("kind", "votes", *by).collect():
        seen.setdefault(r["kind"], []).append((tuple(map(int, r["votes"].split(","))), *(r[c] for c in by), r["n"]))
    return seen


def _vote_of(score: int) -> int:
    """The vote of the words around a span: for in the two highest steps, against in the two lowest."""
    return 1 if score > len(SCORE_STEPS) - 2 else -1 if score < 2 else 0


def _text(v: tuple[int, ...]) -> str:
    return ",".join(map(str, v))


def find_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, text_id, kind, start, end) of personal information, ``text_id`` a hash of the text.

    The labelers' votes are weighed by expectation-maximisation over all
    candidates of a kind; the posteriors tell which words around a span speak
    for it; a classifier trained on both decides. Overlapping spans are settled
    within a text in the order of ``KINDS``. Null and empty texts hold none. What
    is stored on the way are places and hashes, no text.
    """
    spark = documents.sparkSession
    stored = materialise(candidates(documents), "p10-candidates")
    copies = _texts(documents).groupBy("text_id").agg((1 / F.count("*")).alias("share"))
    counts = materialise(part_counts(stored, documents), "p10-parts")  # read once per part of a name
    cands = materialise(with_corpus_votes(stored, counts).join(copies, "text_id"), "p10-votes")
    posts = [(k, _text(v), float(q)) for k, own in _patterns(cands).items() for (v, _), q in zip(own, weigh(own, PRIOR[k]))]
    if not posts:
        return cands.select("doc_id", "text_id", "kind", "start", "end")
    post = spark.createDataFrame(posts, "kind string, votes string, p double")
    scored = materialise(_scored(cands, word_gains(cands, post)), "p10-scored")
    yes = []
    for k, own in _patterns(scored, "score").items():
        # what the words around say is one more labeler, weighed anew with the others
        label = weigh([((*v, _vote_of(s)), n) for v, s, n in own], PRIOR[k])
        yes += [(k, _text(v), s) for (v, s, _), q in zip(own, fit(own, label)) if q >= 0.5]
    good = F.broadcast(spark.createDataFrame(yes, "kind string, votes string, score int"))  # at most as many as there are patterns
    return _settled(scored.join(good, ["kind", "votes", "score"], "left_semi"))


def _settled(found: DataFrame) -> DataFrame:
    """Spans that overlap none before them in the order of ``KINDS``, then of place."""

    def settle(batches):
        for b in batches:
            out = []
            for doc, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                out += [(doc, text, *s) for s in _free([(x["kind"], x["start"], x["end"]) for x in own])]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "text_id", "kind", "start", "end"])

    # the spans of one text, as places
    rows = found.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("kind", "start", "end")).alias("spans"))
    return rows.mapInArrow(settle, "doc_id bigint, text_id bigint, kind string, start int, end int")


def _free(spans_of_text: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that overlap none before them in the order of ``KINDS``, then of place."""
    kept: list[tuple[int, int, str]] = []  # in order of place
    for kind, s, e in sorted(set(spans_of_text), key=lambda x: (KINDS.index(x[0]), x[1], x[2])):
        at = bisect(kept, (s, e, ""))
        if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or e <= kept[at][0]):
            kept.insert(at, (s, e, kind))
    return [(kind, s, e) for s, e, kind in kept]


def _with_text(documents: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """(doc_id, text, spans): documents beside their spans in order of place."""
    own = found.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    docs = documents.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_id"))
    return docs.join(own, ["doc_id", "text_id"], how).select("doc_id", "text", "spans")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, found_text), each once per document.

    Texts meet their spans by id and hash; only texts with spans can match, so
    a filter of the spans' ids goes before the shuffle.
    """
    rows = _with_text(documents, find_spans(documents), "inner").select("doc_id", "text", F.explode("spans").alias("s"))
    return rows.select("doc_id", "s.kind", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("found_text")).distinct()


def redact(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with typed placeholders in place of personal information.

    Documents without any keep their text; null stays null.
    """

    def run(batches):
        for b in batches:
            out = []
            for t, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if own:
                    pieces, at = [], 0
                    for s in own:
                        pieces += [t[at : s["start"]], PLACEHOLDERS[s["kind"]]]
                        at = s["end"]
                    t = "".join([*pieces, t[at:]])
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return _with_text(documents, find_spans(documents), "left").mapInArrow(run, "doc_id bigint, text string")
