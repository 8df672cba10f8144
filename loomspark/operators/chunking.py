"""Markdown to sections: headings, breadcrumbs, and parts of what is too long, all by windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import NO_HEADING
from loomspark.functions.tokens import token_count, trim_all

MOST_TOKENS = 800
#: Lines that are scanned as one stretch.
STRETCH = 10_000
HEADING = r"^(#{1,6})\s+(.*)$"
CHUNKS = "file_id, id, ord, breadcrumb, text, tokens"


def lines(docs: DataFrame, markdown: str = "markdown") -> DataFrame:
    """(file_id, pos, line)"""
    return docs.select("file_id", F.posexplode(F.split(F.coalesce(markdown, F.lit("")), r"\r?\n")).alias("pos", "line"))


def blank(line: Column) -> Column:
    return trim_all(line) == ""


def table_line(line: Column) -> Column:
    """Begins and ends with a bar, two bars at least."""
    s = trim_all(line)
    return s.startswith("|") & s.endswith("|") & (F.length(s) >= 2)


def sections(found: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """lines with level and title of headings, the section's number (0: before the first heading) and its breadcrumb.

    A heading ends all open ones of its level or deeper.  Of the levels above it, one is open if its last heading stands behind
    the last ones of all levels above that.  So what a line needs of those before it is, for each level, the last heading, and
    their number: facts that add up.  A file is scanned in stretches of lines; each stretch is summed up, the sums are scanned,
    and a stretch goes on from the sum of those before it, so one long file is the work of many tasks.
    """
    marked = found.withColumn("level", F.length(F.regexp_extract("line", HEADING, 1))).withColumn("stretch", F.floor(F.col("pos") / stretch).cast("int"))
    marked = marked.withColumn("title", F.when(F.col("level") > 0, trim_all(F.regexp_extract("line", HEADING, 2))))
    heading, at = F.col("level") > 0, F.struct("pos", "title")
    levels = range(1, 7)
    of = lambda k, x: F.when(F.col("level") == k, x)
    sums = marked.filter(heading).groupBy("file_id", "stretch").agg(F.count("*").alias("n"), F.max(F.struct("pos", "level")).alias("own"), *[F.max(of(k, at)).alias(f"h{k}") for k in levels])
    before = Window.partitionBy("file_id").orderBy("stretch")
    last_of = lambda c: F.last(c, ignorenulls=True).over(before)
    # What a stretch leaves is what those behind it begin with, up to the next one that has a heading.
    left = sums.select("file_id", "stretch", F.lead("stretch").over(before).alias("next"), F.sum("n").over(before).alias("n0"), last_of(F.col("own"))["level"].alias("own0"), *[last_of(F.col(f"h{k}")).alias(f"s{k}") for k in levels])
    ends = marked.groupBy("file_id").agg(F.max("stretch").alias("end"))
    upto = F.coalesce("next", "end")
    given = left.join(ends, "file_id").filter(F.col("stretch") < upto).withColumn("stretch", F.explode(F.sequence(F.col("stretch") + 1, upto))).drop("next", "end")
    begun = marked.join(given, ["file_id", "stretch"], "left")

    scan = Window.partitionBy("file_id", "stretch").orderBy("pos")
    last = lambda x: F.last(x, ignorenulls=True).over(scan)
    number = F.coalesce("n0", F.lit(0)) + F.sum(heading.cast("int")).over(scan)
    wide = begun.select("*", number.alias("section"), F.coalesce(last(F.when(heading, F.col("level"))), "own0").alias("own"), *[F.coalesce(last(of(k, at)), f"s{k}").alias(f"l{k}") for k in levels])
    crumbs = []
    for k in levels:
        above = F.greatest(F.lit(-1), *[F.coalesce(f"l{j}.pos", F.lit(-1)) for j in range(1, k)]) if k > 1 else F.lit(-1)
        crumbs.append(F.when((F.col("own") >= k) & (F.col(f"l{k}.pos") > above), F.col(f"l{k}.title")))
    trail = F.concat_ws(" > ", *crumbs)
    return wide.select("file_id", "pos", "line", "level", "title", "section", F.when(F.col("own").isNull(), NO_HEADING).otherwise(trail).alias("breadcrumb"))


def blocks(found: DataFrame) -> DataFrame:
    """sections with the block of each line: a table is one, else blank lines part them; null for blank lines between blocks."""
    by_line = Window.partitionBy("file_id", "section").orderBy("pos")
    marked = found.withColumn("table", table_line(F.col("line"))).withColumn("blank", blank(F.col("line")))
    before = lambda c: F.coalesce(F.lag(c).over(by_line), F.lit(False))
    starts = ~F.col("blank") & ((F.col("table") != before("table")) | before("blank") | F.lag("pos").over(by_line).isNull())
    numbered = marked.withColumn("starts", starts.cast("int"))
    return numbered.withColumn("block", F.when(~F.col("blank"), F.sum("starts").over(by_line))).drop("table", "blank", "starts")


def joined(line: str = "line", pos: str = "pos") -> Column:
    """Aggregate: the lines of a group in order."""
    ordered = F.array_sort(F.collect_list(F.struct(pos, line)))
    return F.array_join(F.transform(ordered, lambda x: x[line]), "\n")


def parts(texts: Column, most: int = MOST_TOKENS) -> Column:
    """Blocks (array of struct<text, tokens>) merged one after the other while they stay within the limit."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(s: Column, b: Column) -> Column:
        fits = s["open"].isNull() | (s["n"] + b["tokens"] <= most)
        return F.struct(
            F.when(fits, s["done"]).otherwise(F.array_append(s["done"], s["open"])).alias("done"),
            F.when(fits & s["open"].isNotNull(), F.concat(s["open"], F.lit("\n\n"), b["text"])).otherwise(b["text"]).alias("open"),
            F.when(fits, s["n"] + b["tokens"]).otherwise(b["tokens"]).alias("n"),
        )

    return F.aggregate(texts, zero, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def chunk_markdown(docs: DataFrame, markdown: str = "markdown", most: int = MOST_TOKENS) -> DataFrame:
    """(file_id, id, ord, breadcrumb, text, tokens) of (file_id, markdown).

    Sections without any text are left out; one over `most` tokens is cut at its blocks.  Files are at most some tens of MB,
    so a file's sections are numbered in one task.
    """
    found = blocks(sections(lines(docs, markdown)))
    whole = found.groupBy("file_id", "section", "breadcrumb").agg(joined().alias("raw"), F.max((F.col("level") > 0).cast("int")).alias("headed"))
    # The body is trimmed by itself behind its heading.
    body = F.when(F.col("headed") == 1, F.concat(F.regexp_extract("raw", r"^([^\n]*\n?)", 1), trim_all(F.regexp_replace("raw", r"^[^\n]*\n?", "")))).otherwise(F.col("raw"))
    whole = whole.select("file_id", "section", "breadcrumb", trim_all(body).alias("full")).filter("full != ''").withColumn("n", token_count(F.col("full")))
    short = whole.filter(F.col("n") <= most).select("file_id", "section", "breadcrumb", F.lit(0).alias("part"), F.col("full").alias("text"))
    long = whole.filter(F.col("n") > most).select("file_id", "section", "breadcrumb")
    cut = found.filter("block is not null").join(long, ["file_id", "section", "breadcrumb"]).groupBy("file_id", "section", "breadcrumb", "block").agg(joined().alias("text"))
    cut = cut.groupBy("file_id", "section", "breadcrumb").agg(F.array_sort(F.collect_list(F.struct("block", "text", token_count(F.col("text")).alias("tokens")))).alias("b"))
    cut = cut.select("file_id", "section", "breadcrumb", F.posexplode(parts(F.col("b"), most)).alias("part", "text")).withColumn("text", trim_all(F.col("text")))
    order = Window.partitionBy("file_id").orderBy("section", "part")
    out = short.unionByName(cut).withColumn("ord", F.row_number().over(order) - 1)
    return out.select("file_id", F.concat(F.lit("s"), "ord").alias("id"), "ord", "breadcrumb", "text", token_count(F.col("text")).alias("tokens"))


def outline(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_id", "ord", "id", F.col("breadcrumb").alias("section"), "tokens")
