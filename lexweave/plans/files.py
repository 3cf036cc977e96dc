"""Queries over files: tables are written as the files that a source holds, read again and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip as strip_text
from ..operators import markdown, passages
from ..operators import reports as r
from ..session import shared_table_path, table
from ..sources import files, sinks
from .reports import vocab
from .sql import P, Q, V, strip


def _all(s, d, name):
    return r.first_copy(table(s, d, name), "id", "loaded_at")


def _folder(s, pages, name):
    """A folder with a file per row of (path, content)."""
    folder = shared_table_path(s, name)
    sinks.page_files(pages, folder)
    return folder


def _json_arrays(s, d):
    """Questions as JSON arrays, a file per volume and test."""
    q = _all(s, d, "questions").where("volume is not null and test is not null")
    rec = F.to_json(F.struct("id", "volume", "test", "question_number", "sentence", "choices", "answer"))
    pages = q.groupBy("volume", "test").agg(F.array_join(F.sort_array(F.collect_list(rec)), ",").alias("a"))  # a test's questions
    path = F.format_string("vol%d_test%02d_part5.json", "volume", "test")
    rows = files.volume_of(files.json_arrays(s, _folder(s, pages.select(path.alias("path"), F.concat(F.lit("["), "a", F.lit("]")).alias("content")), "json") + "/vol*.json"))
    return rows.select("id", "file_volume", "question_number", "sentence", "answer", F.col("choices")["A"].alias("choice_a"))


def _keyed(s, d):
    """Raw payloads, a document each: the entries of those that are maps or lists of words."""
    raw = table(s, d, "word_ets_examples_raw").dropDuplicates(["raw_id"])
    folder = _folder(s, raw.select(F.format_string("raw_%d.json", "raw_id").alias("path"), F.col("payload").alias("content")), "docs")
    rows = files.keyed_documents(s, folder)
    return rows.groupBy(F.expr("cast(regexp_extract(file, 'raw_([0-9]+)', 1) as bigint)").alias("raw_id")).agg(F.count("*").alias("n"))


def _page_texts(s, d):
    """Passages as numbered text pages."""
    p = _all(s, d, "passages").where("volume is not null and test is not null and raw_text is not null")
    path = F.format_string("vol%d/part%d/page_%04d.txt", "volume", "part", "test")
    once = p.groupBy(path.alias("path")).agg(F.min_by("raw_text", "id").alias("content"))
    rows = files.page_texts(s, _folder(s, once, "pages"))
    return rows.select(F.regexp_extract("file", "(vol[0-9]+/part[0-9]+)/", 1).alias("folder"), "page", F.length("text").alias("n_chars"))


def _vault(s, d):
    """Entries as Markdown pages with front matter and two sections."""
    word = strip_text(F.col("word"))
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("word: "), word), F.concat(F.lit("day: "), F.coalesce(F.col("day").cast("string"), F.lit(""))), F.concat(F.lit("related: ["), F.array_join(F.coalesce("related_words", F.array().cast("array<string>")), ", "), F.lit("]")), F.lit("---"))
    one_line = F.coalesce(F.regexp_replace("example_sentence", r"[\r\n]+", " "), F.lit(""))
    body = F.concat_ws("\n", front, F.concat(F.lit("# "), word), F.lit("## Example"), one_line, F.lit("## Notes"), F.lit("none"))
    return files.markdown_pages(s, _folder(s, vocab(s, d).select(F.format_string("%s.md", "id").alias("path"), body.alias("content")), "vault"))


def _typed_front(s, d):
    rows = files.typed_front(_vault(s, d), ints=["day"], lists=["related"])
    return rows.select(F.regexp_extract("file", "(hw_[0-9]+)", 1).alias("id"), F.col("front.word").alias("word"), F.col("ints.day").alias("day"), F.size("lists.related").cast("bigint").alias("n_related"))


def _sections(s, d):
    rows = files.sections(_vault(s, d), ["Example"])
    return rows.select(F.regexp_extract("file", "(hw_[0-9]+)", 1).alias("id"), "heading", "text")


def _sheets(s, d):
    """Words of a day in sheets with two pairs of columns a row."""
    v = vocab(s, d).where("day is not null").select("day", "id", F.regexp_replace(strip_text(F.col("word")), '"', "").alias("w"), F.regexp_replace(F.coalesce("meaning_en", F.lit("")), r'["\r\n]', "").alias("m"))
    pair = F.concat_ws(",", F.concat(F.lit('"'), "w", F.lit('"')), F.concat(F.lit('"'), "m", F.lit('"')))
    lines = v.groupBy("day", F.expr("substring(id, 1, length(id) - 1)").alias("ten")).agg(F.sort_array(F.collect_list(pair)).alias("p"))
    two = lines.select("day", F.explode(F.transform(F.sequence(F.lit(1), F.size("p"), F.lit(2)), lambda i: F.array_join(F.slice("p", i, F.lit(2)), ","))).alias("x"))
    folder = shared_table_path(s, "sheets")
    two.select(F.concat(F.lit("Day "), "day", F.lit(","), "x")).write.text(folder)
    return files.word_sheets(s, folder).select("day", "word", F.coalesce("meaning", F.lit("")).alias("meaning"))


def _answers(s, d):
    """Answers as a flat map in one file per volume."""
    q = _all(s, d, "questions").where("answer is not null and volume is not null")
    pair = F.concat(F.lit('"'), "id", F.lit('":"'), "answer", F.lit('"'))
    rows = q.groupBy("volume").agg(F.array_join(F.sort_array(F.collect_list(pair)), ",").alias("a"))
    pages = rows.select(F.format_string("answers_%d.json", "volume").alias("path"), F.concat(F.lit("{"), "a", F.lit("}")).alias("content"))
    return files.answer_key(s, _folder(s, pages, "keys"))


def _markdown(s, d):
    """Study notes of each entry, with every kind of block."""
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    parts = [F.concat(F.lit("### "), c("word")), F.concat(F.lit("- "), c("meaning_kr")), F.concat(F.lit("- **"), c("meaning_en"), F.lit("**")), F.lit("> [!note] left out"), F.concat(F.lit("1. "), c("level")),
             F.lit("| day | level |"), F.lit("|---|---|"), F.concat(F.lit("| "), c("day"), F.lit(" | `"), c("level"), F.lit("` |")), F.lit("```text"), F.concat(c("example_sentence"), F.lit(" <&>")), F.lit("```"), F.lit(""),
             F.concat(F.lit("> "), c("example_translation")), F.concat(F.lit("[["), c("word"), F.lit("]]")), F.lit("  - last")]
    return markdown.page_html(vocab(s, d).select("id", F.concat_ws("\n", *parts).alias("body")))


def queries() -> dict:
    return {
        "json_array_files": _json_arrays,
        "keyed_documents": _keyed,
        "page_text_files": _page_texts,
        "front_matter_typed": _typed_front,
        "heading_sections": _sections,
        "word_sheet_files": _sheets,
        "answer_key_files": _answers,
        "markdown_html": _markdown,
        "reading_order": _reading_order,
    }


def _reading_order(s, d):
    """Events as text blocks on pages of two columns."""
    ev = table(s, d, "events").where("value is not null")
    blocks = ev.select((F.col("event_id") % 97).alias("page"), (F.col("value") * 13 % 560).alias("x0"), (F.col("event_id") % 31).cast("double").alias("y0"), F.col("event_id").cast("string").alias("text"))
    return passages.reading_order(blocks)


_esc = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_inline = lambda x: rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({_esc(x)}, '\*\*([^*]+)\*\*', '<strong>\1</strong>', 'g'), '\*([^*]+)\*', '<em>\1</em>', 'g'), '`([^`]+)`', '<code>\1</code>', 'g'), '\[\[([^\]|]+)\]\]', '<span class="wikilink">\1</span>', 'g')"""
_tag = lambda c, i: "CASE " + c + "".join(f" WHEN '{k}' THEN '{v[i].replace(chr(39), chr(39) * 2)}'" for k, v in markdown.BLOCKS.items()) + " END"


def _markdown_sql() -> str:
    t = lambda x: f"coalesce({x}::VARCHAR, '')"
    parts = [f"'### ' || {t('word')}", f"'- ' || {t('meaning_kr')}", f"'- **' || {t('meaning_en')} || '**'", "'> [!note] left out'", f"'1. ' || {t('level')}", "'| day | level |'", "'|---|---|'", f"'| ' || {t('day')} || ' | `' || {t('level')} || '` |'",
             "'```text'", f"{t('example_sentence')} || ' <&>'", "'```'", "''", f"'> ' || {t('example_translation')}", f"'[[' || {t('word')} || ']]'", "'  - last'"]
    bare = strip("line")
    item = lambda p: f"'<li>' || {_inline(f'regexp_replace(line, {p}, {chr(39) * 2})')} || '</li>'"
    cells = f"list_transform(string_split(regexp_replace(bare, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: '<td>' || {_inline(strip('c'))} || '</td>')"
    return rf"""WITH b AS (SELECT id, concat_ws(chr(10), {', '.join(parts)}) AS body FROM {V}), l AS (SELECT id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS n FROM b),
      f AS (SELECT *, {bare} AS bare, coalesce(sum(CASE WHEN starts_with({bare}, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_code FROM l),
      k AS (SELECT *, CASE WHEN starts_with(bare, '```') THEN 'fence' WHEN in_code THEN 'code' WHEN regexp_matches(line, '^>\s*\[!') THEN 'callout' WHEN starts_with(line, '> ') THEN 'quote' WHEN starts_with(bare, '|') THEN CASE WHEN regexp_matches(bare, '^\|[\s\-|:]+\|$') THEN 'rule' ELSE 'row' END
        WHEN regexp_matches(line, '^#{{3,5}}\s+\S') THEN 'heading' WHEN regexp_matches(line, '^\s*[-*]\s+') THEN 'ul' WHEN regexp_matches(line, '^\s*\d+\.\s+') THEN 'ol' WHEN bare = '' THEN 'blank' ELSE 'p' END AS kind FROM f),
      c AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('row', 'rule') THEN 'table' WHEN kind IN ('ul', 'ol') THEN kind WHEN kind <> 'callout' THEN '' END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING), '') AS block FROM k),
      w AS (SELECT *, coalesce(lag(block) OVER (PARTITION BY id ORDER BY n), '') AS was FROM c),
      o AS (SELECT id, n, block, list_filter([CASE WHEN block <> was THEN {_tag('was', 1)} END, CASE WHEN block <> was THEN {_tag('block', 0)} END,
        CASE kind WHEN 'fence' THEN CASE WHEN in_code THEN '</code></pre>' ELSE '<pre class="vcode"><code class="lang-' || {strip('substr(bare, 4)')} || '">' END WHEN 'code' THEN {_esc('line')} WHEN 'quote' THEN '<blockquote>' || {_inline('substr(line, 3)')} || '</blockquote>'
          WHEN 'row' THEN '<tr>' || array_to_string({cells}, '') || '</tr>' WHEN 'heading' THEN '<h' || least(length(regexp_extract(line, '^(#+)', 1)) + 1, 6) || ' class=''vsub''>' || {_inline(r"regexp_replace(line, '^#+\s+', '')")} || '</h' || least(length(regexp_extract(line, '^(#+)', 1)) + 1, 6) || '>'
          WHEN 'ul' THEN {item(r"'^\s*[-*]\s+'")} WHEN 'ol' THEN {item(r"'^\s*\d+\.\s+'")} WHEN 'p' THEN '<p>' || {_inline('line')} || '</p>' END], lambda x: x IS NOT NULL) AS out, in_code <> (kind = 'fence') AS op FROM w)
      SELECT id, array_to_string(flatten(list(out ORDER BY n)) || list_filter([{_tag('arg_max(block, n)', 1)}, CASE WHEN arg_max(op, n) THEN '</code></pre>' END], lambda x: x IS NOT NULL), chr(10)) AS html FROM o GROUP BY id"""


def oracle_sql() -> dict[str, str]:
    one_line = r"regexp_replace(example_sentence, '[\r\n]+', ' ', 'g')"
    return {
        "json_array_files": f"SELECT id, volume AS file_volume, question_number, sentence, answer, choices['A'] AS choice_a FROM {Q} WHERE volume IS NOT NULL AND test IS NOT NULL",
        "keyed_documents": "SELECT raw_id, max(CASE json_type(payload::JSON) WHEN 'OBJECT' THEN len(json_keys(payload::JSON)) ELSE json_array_length(payload::JSON) END)::BIGINT AS n FROM word_ets_examples_raw GROUP BY raw_id",
        "page_text_files": f"SELECT 'vol' || volume || '/part' || part AS folder, test AS page, length(arg_min(raw_text, id))::INT AS n_chars FROM {P} WHERE volume IS NOT NULL AND test IS NOT NULL AND raw_text IS NOT NULL GROUP BY volume, part, test",
        "front_matter_typed": f"SELECT id, {strip('word')} AS word, day, len(list_filter(string_split(array_to_string(coalesce(related_words, []), ', '), ','), lambda x: trim(x) <> '')) AS n_related FROM {V}",
        "heading_sections": f"SELECT id, 'Example' AS heading, {strip(f'coalesce({one_line}, {chr(39) * 2})')} AS text FROM {V}",
        "word_sheet_files": rf"SELECT day, replace({strip('word')}, '\"', '') AS word, regexp_replace(coalesce(meaning_en, ''), '[\"\r\n]', '', 'g') AS meaning FROM {V} WHERE day IS NOT NULL AND trim(word) <> ''",
        "answer_key_files": f"SELECT id, answer FROM {Q} WHERE answer IS NOT NULL AND volume IS NOT NULL",
        "markdown_html": _markdown_sql(),
        "reading_order": "SELECT event_id % 97 AS page, row_number() OVER (PARTITION BY event_id % 97 ORDER BY (value * 13 % 560) >= 280, event_id % 31, value * 13 % 560, event_id::VARCHAR) AS place, event_id::VARCHAR AS text FROM events WHERE value IS NOT NULL",
    }
