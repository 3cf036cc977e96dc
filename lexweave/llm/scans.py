"""Noise of scanned pages: broken words, misread characters, running heads, page numbers (problem 6)."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Characters that recognition puts for letters (fixed values).
LOOKALIKES = {"0": "o", "1": "l", "5": "s", "9": "g", "€": "e", "†": "t", "口": "o", "卜": "h", "丨": "l", "|": "l", "¡": "i", "¢": "c", "£": "e", "§": "s", "@": "a", "$": "s", "8": "b", "6": "b"}
#: Letter pairs that it puts for one letter (fixed values).
PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"))
#: Hyphens at a line's end: hyphen-minus, hyphen, non-breaking hyphen, soft hyphen.
_HYPHENS = "-\u2010\u2011\u00ad"
#: The most words and running heads that are sent to every executor, the most
#: frequent ones. All others are looked up by a join (``look_up``), so these
#: bounds change how a word is found, never whether.
WORDS_SENT = 100_000
HEADS_SENT = 2_000
#: Known words with a suspicious pair that the prefilter tells apart, the most
#: frequent ones; texts with another such word are looked at in Python.
PREFILTER_WORDS = 200
#: A misread word is this many times rarer than the word it stands for.
RARER = 5
#: A joined word outweighs its two halves, where both are words, from this share of the rarer half on.
JOIN_SHARE = 1 / 50
#: Least likeness of a line to a known running head.
HEAD_LIKENESS = 0.85
#: A running head stands above or below at least so many unlike texts, none of
#: which makes up more than a share of its lines; a share of its lines stands at
#: an edge; and one of its words stands in lines of this form for a share of all
#: its occurrences.
HEAD_TEXTS = 5
HEAD_TOP = 0.5
HEAD_EDGE = 0.15
HEAD_WORD = 0.2

_SYMBOL = "€†口卜丨¡¢£§"
_EXPLICIT = r"(?:\d{1,4} ?/ ?\d{1,4}|page \d{1,4}(?: of \d{1,4})?|\[ ?\d{1,4} ?\]|[-–—] ?\d{1,4} ?[-–—]|pp?\. ?\d{1,4})"
_page_line = re.compile(_EXPLICIT, re.I)
_bare_number = re.compile(r"\d{1,4}")
_newline = re.compile(r"\r\n|\r|\n")
_break = regex.compile(rf"(?<![\p{{L}}{_SYMBOL}0-9|])([\p{{L}}{_SYMBOL}0-9|]++)([{_HYPHENS}])\s+([\p{{L}}{_SYMBOL}0-9|]+)")
#: Words with a look-alike beside a letter, or with a suspicious pair (Java and Python).
SUSPECT = rf"(?i)(?<![A-Za-z0-9{_SYMBOL}|])[A-Za-z0-9{_SYMBOL}|]*(?:rn|cl|vv|[0-9{_SYMBOL}|][A-Za-z]|[A-Za-z][0-9{_SYMBOL}|])[A-Za-z0-9{_SYMBOL}|]*"
_suspect = re.compile(SUSPECT)


@dataclass
class Noise:
    """What was learned from the whole corpus and is sent to every executor: counts
    of the most frequent words, the most frequent running heads, the last page
    number and the length of the longest word that others can be misread from.
    ``rare`` and ``rare_heads`` are what was looked up for the text at hand."""

    vocabulary: Mapping[str, int] = field(default_factory=dict)
    heads: Sequence[str] = ()
    last_page: int = 0
    longest: int = 64
    rare: Mapping[str, int] = field(default_factory=dict)
    rare_heads: frozenset[str] = frozenset()
    #: There are running heads beyond ``heads``; ``inline_heads`` are those that may stand inside the text at hand.
    more_heads: bool = False
    inline_heads: frozenset[str] = frozenset()

    def __post_init__(self):
        self._head_set = set(self.heads)
        self._head_runs = [(h, _runs(h)) for h in self.heads] if self.more_heads else []
        self._inline = self._any(self.heads)

    @classmethod
    def _any(cls, heads: Iterable[str]) -> re.Pattern | None:
        return re.compile("|".join(cls._pattern(h) for h in sorted(heads, key=lambda h: (-len(h), h))), re.I) if heads else None

    def _inline_of(self, text: str) -> re.Pattern | None:
        """All heads that may stand inside a text, as one pattern."""
        if not self.inline_heads:
            return self._inline
        runs = _runs(text)
        return self._any([*(h for h, own in self._head_runs if own <= runs), *self.inline_heads])

    @staticmethod
    def _pattern(head: str) -> str:
        return r"(?<!\w)" + r"\s+".join(re.escape(w).replace(r"\#", r"\d+").replace("#", r"\d+") for w in head.split()) + r"(?!\w)"

    def java_heads(self) -> str | None:
        """The running heads as one Java pattern."""
        words = lambda h: r"\s+".join(r"\Q" + w.replace("#", r"\E\d+\Q") + r"\E" for w in h.split())
        return r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(words(h) for h in sorted(self.heads, key=len, reverse=True)) + ")" if self.heads else None

    def count(self, word: str) -> int:
        return self.vocabulary.get(word) or self.rare.get(word, 0)

    # -- parts of a text ---------------------------------------------------

    def pages(self, lines: Sequence[str]) -> set[int]:
        """Places of the page-number lines: those in a form of their own, bare
        numbers within the corpus's run of pages, and bare numbers that count
        the pages of this text."""
        if len(lines) < 2:
            return set()
        bare = [(i, int(x)) for i, x in enumerate(x.strip() for x in lines) if _bare_number.fullmatch(x)]
        found = {i for i, v in bare if 0 < v <= self.last_page}
        rising = len(bare) >= 3 and all(b == a + 1 for (_, a), (_, b) in zip(bare, bare[1:]))
        return found | ({i for i, _ in bare} if rising else set()) | {i for i, x in enumerate(lines) if _page_line.fullmatch(x.strip())}

    def is_head(self, line: str) -> bool:
        form = line_form(line)
        if not form or len(form) < 4:
            return False
        return form in self._head_set or form in self.rare_heads or alike(form, self.heads)

    def reading(self, token: str) -> str | None:
        """The word that a token was misread from, or None if it stands for itself."""
        low = token.lower()
        letters = sum(c.isalpha() and c not in LOOKALIKES for c in low)
        if not letters:
            return None
        plain = _plain(low)
        if plain != low:
            known = self._known(plain) if len(plain) <= self.longest + 1 else None
            if letters >= 2 and any(c in _SYMBOL for c in low):
                return known or plain
            return known if known and len(plain) > 2 and self.count(known) >= RARER * max(1, self.count(low)) else None
        known = self._pair(low) if 3 < len(low) <= self.longest + 1 else None
        return known if known and self.count(known) >= RARER * max(1, self.count(low)) else None

    def _known(self, word: str) -> str | None:
        if self.count(word):
            return word
        return next((w for w in _with_i(word) if self.count(w)), None) or self._pair(word)

    def _pair(self, word: str) -> str | None:
        best = max(_without_pairs(word), key=self.count, default=None)
        return best if best is not None and self.count(best) else None

    def joins(self, left: str, hyphen: str, right: str) -> str | None:
        """The word that ``left``-``right`` was before a line end split it, or None for a true hyphen."""
        a, b = left.lower(), right.lower()
        joined = self.fold(a + b)
        if hyphen != "-":
            return left + right
        if self.count(f"{a}-{b}") > self.count(joined):
            return None
        # words are counted away from line ends, so a half is known only if it is a word of its own
        both = min(self.count(a), self.count(b))
        return left + right if self.count(joined) >= both * JOIN_SHARE else None

    def fold(self, word: str) -> str:
        """Word with its misread characters put right, if that gives a known word."""
        if self.count(word) or len(word) > self.longest + 1:
            return word
        return self._known(_plain(word)) or word

    # -- whole texts -------------------------------------------------------

    def questions(self, text: str) -> list[str]:
        """The words and line forms (marked) that ``inspect`` may look up and that weren't sent."""
        asked: set[str] = set()

        def ask(token: str) -> None:
            low = token.lower()
            asked.add(low)
            if len(low) <= self.longest + 1:
                plain = _plain(low)
                asked.update((plain, *_with_i(plain), *_without_pairs(plain), *_without_pairs(low)))

        lines = _newline.split(text)
        if len(lines) > 1:
            asked.update(_FORM + f for f in map(line_form, lines) if len(f) >= 4 and f not in self._head_set)
        if self.more_heads:
            asked.update(_RUN + w for w in ("", *_runs(text)))
        for m in _suspect.finditer(text):
            ask(m[0])
        # a break may reach over lines that turn out to be heads or page numbers
        tails = [(i, m) for i, x in enumerate(lines) if (m := _tail.search(x))]
        firsts = [m[0] if (m := _first.search(x)) else None for x in lines] if tails else []
        pairs = {(m[1], w) for i, m in tails for w in firsts[i + 1 : i + 4] if w} | {(m[1], m[3]) for m in _break.finditer(text)}
        for a, b in pairs:
            a, b = a.lower(), b.lower()
            asked.update((a, b, f"{a}-{b}"))
            ask(a + b)
        return sorted(w for w in asked if w not in self.vocabulary)

    def inspect(self, text: str) -> tuple[set[str], str]:
        """(kinds of damage, repaired text)."""
        kinds: set[str] = set()
        body: list[str] = []
        lines = _newline.split(text)
        pages = self.pages(lines)
        for i, line in enumerate(lines):
            if i in pages:
                kinds.add("page_number")
            elif len(lines) > 1 and self.is_head(line):
                kinds.add("running_head")
            else:
                body.append(line)
        if not body or not any(x.strip() for x in body):
            return kinds, ""
        joined = "\n".join(body)
        if inline := self._inline_of(joined):
            cut = inline.sub(" ", joined)
            if cut != joined:
                kinds.add("running_head")
                joined = cut

        def mend(m) -> str:
            whole = self.joins(m[1], m[2], m[3])
            if whole is None:
                return m[0]
            kinds.add("broken_word")
            return whole

        joined = _break.sub(mend, joined)

        def read(m) -> str:
            word = self.reading(m[0])
            if word is None:
                return m[0]
            kinds.add("misread")
            return word.capitalize() if m[0][:1].isupper() else word

        joined = _suspect.sub(read, joined)
        return kinds, re.sub(r"\s+", " ", joined).strip() if kinds else text


#: Marks of a line form, of a run of letters and of a head inside a text among looked-up words.
_FORM, _RUN, _INSIDE = "\n", "\r", "\v"
_tail = regex.compile(rf"([\p{{L}}{_SYMBOL}0-9|]+)[{_HYPHENS}]\s*$")
_first = regex.compile(rf"[\p{{L}}{_SYMBOL}0-9|]+")


def _plain(word: str) -> str:
    return "".join(LOOKALIKES.get(c, c) for c in word)


def _with_i(word: str) -> Iterator[str]:
    """A bar or one stands for i as well as for l."""
    return (word[:i] + "i" + word[i + 1 :] for i, c in enumerate(word) if c == "l")


def _without_pairs(word: str) -> Iterator[str]:
    for pair, one in PAIRS:
        at = word.find(pair)
        while at >= 0:
            yield word[:at] + one + word[at + 2 :]
            at = word.find(pair, at + 1)


def line_form(line: str) -> str:
    """A line with its numbers and spacing made alike."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "#", line.strip().lower()))


#: Letters that match a Latin one if case is ignored.
_ODD_CASE = ("İıſ\u212a", "iisk")
_odd_case = str.maketrans(*_ODD_CASE)
_LETTERS = "[a-z]+|[가-힣]+"
_AFTER_NUMBER = "(?<!#)[가-힣]+"


def _runs(text: str) -> set[str]:
    """The runs of letters of a text. A head stands inside a text only if its own word is one of them."""
    low = re.sub(r"\d+", "#", text.translate(_odd_case).lower())
    return {*re.findall(_LETTERS, low), *re.findall(_AFTER_NUMBER, low)}


def _run_keys(text: Column) -> Column:
    """``_runs`` in the JVM."""
    low = F.regexp_replace(F.lower(F.translate(text, *_ODD_CASE)), r"(?U)\d+", "#")
    return F.array_union(F.regexp_extract_all(low, F.lit(_LETTERS), F.lit(0)), F.regexp_extract_all(low, F.lit(_AFTER_NUMBER), F.lit(0)))


def alike(form: str, heads: Iterable[str]) -> bool:
    """Whether a line form is like one of the heads."""
    like = difflib.SequenceMatcher()
    like.set_seq2(form)
    for h in heads:
        if abs(len(h) - len(form)) <= 4:
            like.set_seq1(h)
            # the quick ones are never less than the ratio
            if like.real_quick_ratio() >= HEAD_LIKENESS and like.quick_ratio() >= HEAD_LIKENESS and like.ratio() >= HEAD_LIKENESS:
                return True
    return False


def head_pieces(head: str) -> list[str]:
    """Pieces of a head of which any line form that is like it holds one unchanged.

    Forms whose lengths differ by 4 at most and whose likeness is reached differ
    by so many letters put in or left out, each of which breaks one piece at most.
    """
    n = len(head)
    k = min(n, int((1 - HEAD_LIKENESS) * (2 * n + 4) + 1e-9) + 1)
    return [head[n * i // k : n * (i + 1) // k] for i in range(k)]


def _all_pieces(form: str, sizes: Iterable[int]) -> set[str]:
    return {form[i : i + g] for g in sizes for i in range(len(form) - g + 1)}


def like_forms(forms: DataFrame, heads: DataFrame) -> DataFrame:
    """(form): the line forms that are like one of ``heads`` (form). They meet by pieces and lengths, then each pair is compared."""
    lengths = lambda n: range(max(0, n - 4) // 9, (n + 4) // 9 + 1)

    def of_heads(batches):
        for b in batches:
            rows = [(h, len(h) // 9, p) for h in b.column(0).to_pylist() for p in dict.fromkeys(head_pieces(h))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["head", "size", "piece"])

    pieces = materialise(heads.select("form").mapInArrow(of_heads, "head string, size int, piece string"), "p6-pieces")
    sizes = [r[0] for r in pieces.select(F.length("piece")).distinct().collect()]  # a few numbers

    def of_forms(batches):
        for b in batches:
            rows = [(f, s, p) for f in b.column(0).to_pylist() for s in lengths(len(f)) for p in _all_pieces(f, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["form", "size", "piece"])

    def compare(batches):
        for b in batches:
            kept = [f for f, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if alike(f, (h,))]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["form"])

    asked = forms.select("form").distinct().mapInArrow(of_forms, "form string, size int, piece string")
    near = asked.join(pieces, ["size", "piece"]).where(F.abs(F.length("form") - F.length("head")) <= 4).select("form", "head").distinct()
    return near.mapInArrow(compare, "form string").distinct()


def scan_texts(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """(field_name, record_id, text) of the fields that come from scanned pages."""
    ex = entries.select(F.explode("examples").alias("e")).select(
        F.lit("examples.sentence").alias("field_name"), F.col("e.ex_id").cast("string").alias("record_id"), F.col("e.sentence").alias("text")
    )
    q = questions.select(
        F.explode(F.array(F.struct(F.lit("questions.sentence").alias("f"), F.col("sentence").alias("t")), F.struct(F.lit("questions.explanation").alias("f"), F.col("explanation").alias("t")))).alias("x"),
        F.col("id").alias("record_id"),
    ).select(F.col("x.f").alias("field_name"), "record_id", F.col("x.t").alias("text"))
    return ex.unionByName(q).where("text is not null and record_id is not null")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts: words, compounds with hyphens, words with digits,
    words of Hangul. The halves of a word at a line-end hyphen aren't counted."""
    broken = rf"[^\s]*[{_HYPHENS}]\s+[^\s]*"
    text = F.col("text")
    text = F.when((text.contains("-") | ~_ascii(text)) & text.rlike(rf"[{_HYPHENS}]\s"), F.regexp_replace(text, broken, " ")).otherwise(text)
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]*(?:-[a-z0-9]+)*|[가-힣]+"), F.lit(0))
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _lines(texts: DataFrame) -> DataFrame:
    """(form, line, first, last, around): lines of texts of several lines. ``around``
    names the rest of the text by its least word hash, which copies of the same
    text share even if some of their words are damaged. Lines that begin with
    the rest of a broken word have no form."""
    several = texts.where(F.col("text").contains("\n")).select(F.split("text", r"\r?\n").alias("l"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("w"))
    lines = several.select("w", "l", F.size("l").alias("k"), F.posexplode("l").alias("i", "line"))
    form = F.trim(F.regexp_replace(F.regexp_replace(F.lower("line"), r"\d+", "#"), r"\s+", " "))
    halved = (F.col("i") > 0) & F.element_at("l", F.greatest(F.col("i"), F.lit(1))).rlike(rf"[{_HYPHENS}]\s*$")
    rest = F.array_except("w", F.regexp_extract_all(F.lower("line"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    return lines.select(
        F.when(~halved, form).alias("form"), F.trim("line").alias("line"), (F.col("i") == 0).cast("int").alias("first"), (F.col("i") == F.col("k") - 1).cast("int").alias("last"),
        F.array_min(F.transform(rest, lambda w: F.xxhash64(w))).alias("around"),
    )


def head_lines(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(form, n, word) of the running heads among ``lines``, ``word`` being the one most its own, told by measures that don't
    depend on how large the corpus is: see ``HEAD_TEXTS`` and those beside it.

    Lines of a text that was delivered many times have the same text around
    them; lines of ordinary words are sentence ends and beginnings.
    """
    page = r"(?U)[-‐\u00ad]$|^\W*(?:page |pp?\. ?)?#\W*(?:(?:of|/) ?#)?\W*$"
    per_text = lines.where((F.length("form") >= 4) & ~F.col("form").rlike(page)).groupBy("form", "around").agg(
        F.count("*").alias("n"), F.sum("first").alias("first"), F.sum("last").alias("last")
    )
    forms = per_text.groupBy("form").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count("around").alias("texts"), (F.sum("first") + F.sum("last")).alias("edges"))
    some = forms.where((F.col("texts") >= HEAD_TEXTS) & (F.col("top") <= HEAD_TOP * F.col("n")) & (F.col("edges") >= HEAD_EDGE * F.col("n")))
    parts = some.select("form", "n", F.explode_outer(F.array_distinct(F.regexp_extract_all("form", F.lit("(?<![a-z0-9#-])[a-z]+(?![a-z0-9#-])|(?<!#)[가-힣]+"), F.lit(0)))).alias("word"))  # words as they are counted
    own = parts.join(words.withColumnRenamed("n", "all"), "word", "left")
    share = F.when(F.col("word").isNull(), 1.0).otherwise(F.coalesce(F.col("n") / F.col("all"), F.lit(1.0)))
    most = F.max(F.struct(share.alias("share"), "word"))
    return own.groupBy("form", "n").agg(most.alias("m")).where(F.col("m.share") >= HEAD_WORD).select("form", "n", "m.word")


def last_page(explicit: Sequence[int], bare: Sequence[int]) -> int:
    """End of the corpus's run of page numbers: from those in a form of their own, then
    as far as bare numbers follow without a gap much larger than those before."""
    end = 0
    for v in sorted(set(explicit)):
        if v > 2 * end + 50:
            break
        end = v
    for seen, v in enumerate(sorted(set(bare)), 1):
        if v > end:
            if v - end > max(5, 10 * v / seen) or v > 50 and seen < 10:
                break
            end = v
    return end


def _page_range(lines: DataFrame) -> int:
    """``last_page`` of all lines; what is collected are at most 20,000 distinct numbers."""
    line = F.lower("line")
    value = F.array_max(F.transform(F.regexp_extract_all(line, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int")))
    rows = lines.where(line.rlike(rf"^(?:{_EXPLICIT}|\d{{1,4}})$")).groupBy(line.rlike(r"^\d{1,4}$").alias("bare"), value.alias("v")).agg(F.lit(1).alias("o")).collect()
    return last_page([r["v"] for r in rows if not r["bare"]], [r["v"] for r in rows if r["bare"]])


@dataclass
class Learned:
    """``noise`` is sent to the executors, ``rest`` (key, n) holds the rarer words and
    heads (marked) to be looked up, None if there are none; ``heads`` (form, word)
    holds these heads with the word by which they are found inside texts."""

    noise: Noise
    rest: DataFrame | None
    heads: DataFrame | None = None


def learn_noise(texts: DataFrame) -> Learned:
    """Vocabulary, running heads and page numbers from all texts.

    All words and heads are kept. The driver and the executors get the
    ``WORDS_SENT`` most frequent words and ``HEADS_SENT`` heads at most, the
    others stay in a table.
    """
    words = materialise(word_counts(texts), "p6-words")
    lines = materialise(_lines(texts), "p6-lines")
    heads = materialise(head_lines(lines, words), "p6-heads")
    # words by the power of two of their number: a few rows
    sizes = words.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("words"), F.max(F.when(F.col("n") >= RARER, F.length("word"))).alias("longest")).collect()
    longest = max((r["longest"] or 0 for r in sizes), default=0)
    least, room = 1, WORDS_SENT
    for r in sorted(sizes, key=lambda r: -r["p"]):
        room -= r["words"]
        if room < 0:
            least = 2 ** (r["p"] + 1)
            break
    sent = words.where(F.col("n") >= least).toArrow()  # WORDS_SENT at most
    top = heads.orderBy(F.desc("n"), "form").limit(HEADS_SENT).collect()
    noise = Noise(dict(zip(sent["word"].to_pylist(), sent["n"].to_pylist())), [r["form"] for r in top], _page_range(lines), longest)
    rest, more = [], None
    if least > 1:
        rest.append(words.where(F.col("n") < least).select(F.col("word").alias("key"), "n"))
    if len(top) == HEADS_SENT:
        edge = (top[-1]["n"], top[-1]["form"])
        beyond = heads.where((F.col("n") < edge[0]) | (F.col("n") == edge[0]) & (F.col("form") > edge[1]))
        if not beyond.isEmpty():
            noise, more = replace(noise, more_heads=True), beyond.select("form", F.coalesce("word", F.lit("")).alias("word"))
            rest.append(beyond.select(F.concat(F.lit(_FORM), "form").alias("key"), "n"))
    return Learned(noise, rest[0].unionByName(rest[1]) if len(rest) == 2 else rest[0] if rest else None, more)


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def suspicious(text: Column, noise: Noise) -> Column:
    """Whether a text can hold damage; decided in the JVM, so clean texts never reach Python.

    Each pattern starts at a rare character or pair and looks at every
    character a few times at most; the most frequent known words with a
    suspicious pair are told apart where the pair is found.
    """
    own = [w for w in noise.vocabulary if _suspect.fullmatch(w) and noise.reading(w) is None]
    around = []
    for w in sorted(own, key=lambda w: (-noise.vocabulary[w], w))[:PREFILTER_WORDS]:
        for m in re.finditer(r"(?=(rn|cl|vv|[0-9|][a-z]|[a-z][0-9|]))", w):
            at = m.start() + 2
            around.append(rf"(?<=(?<![A-Za-z0-9|]){w[:at]}){w[at:]}(?![A-Za-z0-9|])")
    known = rf"(?i:(?!{'|'.join(around)}))" if around else ""
    odd = rf"(?=[rRcCvV0-9|])(?:[rR][nN]|[cC][lL]|[vV][vV]|[0-9|][A-Za-z]|[0-9|](?<=[A-Za-z][0-9|])){known}"
    test = (
        text.contains("\n") | text.contains("\r")
        | ~_ascii(text) & text.rlike(rf"[\u00ad\u2010\u2011{_SYMBOL}]")
        | text.rlike(r"-(?<=[\p{L}\d|]-)\s+(?=[\p{L}\d|])")
        | text.rlike(odd)
    )
    heads = noise.java_heads()
    return test | text.rlike(heads) if heads else test


def look_up(texts: DataFrame, learned: Learned) -> DataFrame:
    """``texts`` with a column ``rare``: what ``learned.rest`` holds of the words and line forms that each text asks for.

    Each text tells what it may need; the distinct words meet the table once,
    and only those found go back to their texts.
    """
    if learned.rest is None:
        return texts.withColumn("rare", F.lit(None).cast("map<string,bigint>"))
    shared = texts.sparkSession.sparkContext.broadcast(learned.noise)

    def ask(batches):
        for b in batches:
            asked = [shared.value.questions(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(asked, pa.list_(pa.string()))], names=["text", "asked"])

    rows = texts.select("text").distinct().mapInArrow(ask, "text string, asked array<string>")
    rows = materialise(rows.select(F.md5("text").alias("id"), "asked"), "p6-asked")
    keys = rows.select("id", F.explode("asked").alias("key"))
    found = learned.rest.join(keys.select("key").distinct(), "key")
    if learned.heads is not None:
        forms = keys.where(F.col("key").startswith(_FORM)).select(F.substr("key", F.lit(2)).alias("form"))
        like = like_forms(forms, learned.heads).select(F.concat(F.lit(_FORM), "form").alias("key"), F.lit(1).cast("bigint").alias("n"))
        # a head has a fifth of its own word's places at least, so a word brings five heads at most
        inside = learned.heads.select(F.concat(F.lit(_RUN), "word").alias("key"), F.concat(F.lit(_INSIDE), "form").alias("head"))
        inside = keys.join(inside, "key").select("id", F.col("head").alias("key"), F.lit(1).cast("bigint").alias("n"))
        rows = keys.join(found.unionByName(like).groupBy("key").agg(F.max("n").alias("n")), "key").select("id", "key", "n").unionByName(inside)
    else:
        rows = keys.join(found, "key")
    rare = rows.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("key", "n"))).alias("rare"))
    return texts.withColumn("_id", F.md5("text")).join(rare.withColumnRenamed("id", "_id"), "_id", "left").drop("_id")


def inspect_texts(texts: DataFrame, learned: Learned) -> DataFrame:
    """The columns of ``texts`` with kinds and repaired, the damage of ``text`` and the text without it."""
    shared = texts.sparkSession.sparkContext.broadcast(learned.noise)
    schema = texts.schema

    def run(batches):
        own = shared.value
        for b in batches:
            seen = []
            for t, rare in zip(b.column("text").to_pylist(), b.column("rare").to_pylist()):
                found = dict(rare or ())
                own.rare_heads = frozenset(k[len(_FORM) :] for k in found if k.startswith(_FORM))
                own.inline_heads = frozenset(k[len(_INSIDE) :] for k in found if k.startswith(_INSIDE))
                own.rare = found
                seen.append(own.inspect(t))
            cols = [b.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([sorted(k) for k, _ in seen], pa.list_(pa.string())), pa.array([t for _, t in seen], pa.string())],
                names=[*schema.names, "kinds", "repaired"],
            )

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return look_up(texts, learned).mapInArrow(run, columns + ", kinds array<string>, repaired string")


def _inspected(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """The texts that can hold damage, inspected."""
    texts = scan_texts(entries, questions)
    learned = learn_noise(texts)
    test = suspicious(F.col("text"), learned.noise)
    some = texts.where(test)
    if learned.heads is not None:
        runs = texts.where(~test).select(F.md5("text").alias("_id"), F.explode(F.array_union(F.array(F.lit("")), _run_keys(F.col("text")))).alias("word"))
        held = runs.join(learned.heads.select("word").distinct(), "word").select("_id").distinct()
        some = some.unionByName(texts.where(~test).withColumn("_id", F.md5("text")).join(held, "_id", "left_semi").drop("_id"))
    # told once: texts with words to be looked up are read twice
    return inspect_texts(some if learned.rest is None else materialise(some, "p6-suspicious"), learned)


def damaged(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """(field_name, record_id, kind): the texts with scan damage, one row per kind.

    Null texts have none; empty ones neither. Repeated rows count once.
    """
    return _inspected(entries, questions).select("field_name", "record_id", F.explode("kinds").alias("kind")).distinct()


def repaired(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """(field_name, record_id, kinds, text): damaged texts as continuous text, heads and page numbers removed."""
    rows = _inspected(entries, questions).where(F.size("kinds") > 0)
    return rows.groupBy("field_name", "record_id").agg(F.min(F.array_join("kinds", ",")).alias("kinds"), F.min("repaired").alias("text"))
