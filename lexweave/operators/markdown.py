"""Markdown pages to HTML: lines are told apart, runs of a kind become one block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_html, inline_html, strip

#: Opening and closing tags of the blocks that hold several lines (fixed values).
BLOCKS = {"ul": ("<ul class='vlist'>", "</ul>"), "ol": ("<ol class='vlist'>", "</ol>"), "table": ('<table class="vtable"><tbody>', "</tbody></table>")}


def line_kind(line: Column, in_code: Column) -> Column:
    """Kind of a line by its beginning; code decides first, then callouts, quotes, tables, headings, lists."""
    bare = strip(line)
    return (
        F.when(bare.startswith("```"), "fence").when(in_code, "code").when(line.rlike(r"^>\s*\[!"), "callout").when(line.startswith("> "), "quote")
        .when(bare.startswith("|"), F.when(bare.rlike(r"^\|[\s\-|:]+\|$"), "rule").otherwise("row")).when(line.rlike(r"^#{3,5}\s+\S"), "heading")
        .when(line.rlike(r"^\s*[-*]\s+"), "ul").when(line.rlike(r"^\s*\d+\.\s+"), "ol").when(bare == "", "blank").otherwise("p")
    )


def page_html(pages: DataFrame) -> DataFrame:
    """(id, html) of pages (id, body): headings from the third level, quotes, lists, tables,
    fenced code, paragraphs and inline marks; callouts are left out.

    A list or table is a run of its lines: whatever else comes closes it, and so
    does the page's end; an unfinished fence is closed too. Windows run within a
    page. A null body gives null, an empty one an empty text.
    """
    of_page = Window.partitionBy("id").orderBy("at")
    so_far = of_page.rowsBetween(Window.unboundedPreceding, -1)
    lines = pages.where("body is not null").select("id", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    fence = strip(F.col("line")).startswith("```")
    told = lines.withColumn("in_code", F.coalesce(F.sum(fence.cast("int")).over(so_far), F.lit(0)) % 2 == 1)
    told = told.withColumn("kind", line_kind(F.col("line"), F.col("in_code")))
    # a callout leaves the block before it open
    block = F.when(F.col("kind").isin("row", "rule"), "table").when(F.col("kind").isin("ul", "ol"), F.col("kind")).when(F.col("kind") != "callout", "")
    told = told.withColumn("block", F.coalesce(F.last(block, True).over(of_page.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    told = told.withColumn("was", F.coalesce(F.lag("block").over(of_page), F.lit("")))
    tag = lambda name, i: F.element_at(F.create_map(*(F.lit(x) for k, v in BLOCKS.items() for x in (k, v[i]))), name)
    changed = F.col("block") != F.col("was")
    item = lambda pattern: F.concat(F.lit("<li>"), inline_html(F.regexp_replace("line", pattern, "")), F.lit("</li>"))
    cells = F.split(F.regexp_replace(strip(F.col("line")), r"^\|+|\|+$", ""), r"\|")
    level = F.least(F.length(F.regexp_extract("line", "^(#+)", 1)) + 1, F.lit(6)).cast("string")
    own = (
        F.when((F.col("kind") == "fence") & ~F.col("in_code"), F.concat(F.lit('<pre class="vcode"><code class="lang-'), strip(F.substring(strip(F.col("line")), 4, 100_000)), F.lit('">')))
        .when(F.col("kind") == "fence", "</code></pre>").when(F.col("kind") == "code", escape_html(F.col("line")))
        .when(F.col("kind") == "quote", F.concat(F.lit("<blockquote>"), inline_html(F.expr("substring(line, 3)")), F.lit("</blockquote>")))
        .when(F.col("kind") == "row", F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), inline_html(strip(c)), F.lit("</td>"))), ""), F.lit("</tr>")))
        .when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(" class='vsub'>"), inline_html(F.regexp_replace("line", r"^#+\s+", "")), F.lit("</h"), level, F.lit(">")))
        .when(F.col("kind") == "ul", item(r"^\s*[-*]\s+")).when(F.col("kind") == "ol", item(r"^\s*\d+\.\s+"))
        .when(F.col("kind") == "p", F.concat(F.lit("<p>"), inline_html(F.col("line")), F.lit("</p>")))
    )
    parts = told.select("id", "at", F.array_compact(F.array(F.when(changed, tag(F.col("was"), 1)), F.when(changed, tag(F.col("block"), 0)), own)).alias("out"), "block", (F.col("in_code") != (F.col("kind") == "fence")).alias("open"))
    whole = parts.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "out"))), lambda x: x["out"])).alias("out"), F.max_by(F.struct("block", "open"), "at").alias("end"))
    end = F.array_compact(F.array(tag(F.col("end.block"), 1), F.when(F.col("end.open"), "</code></pre>")))
    html = whole.select("id", F.array_join(F.concat("out", end), "\n").alias("html"))
    return html.unionByName(pages.where("body is null").select("id", F.lit(None).cast("string").alias("html")))
