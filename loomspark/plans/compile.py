"""compile, expand and prove over batches: tables of documents and of (file, task, budget) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import query as Q
from loomspark.functions.text import id_span, section_heading, section_label, section_preview, source_name
from loomspark.functions.tokens import PRICE_PER_MILLION, content_tokens, cost_usd, reduction_pct, token_count, tokens_saved, utf16_length
from loomspark.operators import hints, ranking
from loomspark.operators.chunking import chunk_markdown
from loomspark.operators.fold import folded, ranked_facts
from loomspark.operators.selection import CAP_MARK, END, NOTE
from loomspark.operators.sizes import crumb_line, cut, header_length, let
from loomspark.sources.shared import checked_broadcast, store

_SECTION = "id string, ord int, section string, tokens int, relevance int, truncated boolean, full_tokens int, matched_queries array<int>, text string"
_STRUCT = "struct<" + ",".join(f"{n}:{t}" for n, t in (c.strip().split(" ") for c in _SECTION.split(", "))) + ">"
PACKED = f"task_id string, file_id string, markdown string, tokens_used int, stopped_early boolean, selected_sections array<{_STRUCT}>, omitted_sections array<{_STRUCT}>, best array<string>"


def aspect_rows(tasks: DataFrame) -> DataFrame:
    """(task_id, file_id, task, token_budget) to one row an aspect: with qi, query and terms."""
    split = tasks.withColumn("queries", Q.aspects(F.col("task")))
    return split.select("*", F.posexplode("queries").alias("qi", "query")).withColumn("terms", Q.terms(F.col("query")))


def scored_sections(chunks: DataFrame, aspects: DataFrame) -> DataFrame:
    """(task_id, file_id, ord, score, turn, matched_queries, best, multi): the ranking that the selection walks."""
    # Scores are read by four aggregates and the ranking.  Sums come in any order, so their last digits are cut off: equal
    # sections stay equal, whichever task is run again.
    raw = store(ranking.bm25(chunks, aspects).withColumn("s", F.round("s", 9)), "scores")
    multi = aspects.groupBy("task_id").agg((F.count("*") > 1).alias("multi"), F.first("task").alias("task"))
    rows = ranking.normalized(raw.join(multi.filter("multi").select("task_id"), "task_id", "left_semi"))
    single = raw.join(multi.filter("not multi").select("task_id"), "task_id", "left_semi").select("task_id", "file_id", "ord", F.col("s").alias("score"), F.lit(None).cast("int").alias("turn"), F.lit(None).cast("array<int>").alias("matched_queries"))
    best = store(ranking.best_ids(rows, chunks, aspects), "best-ids")
    lead = best.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("qi", "ord"))), lambda x: F.concat(F.lit("s"), x["ord"])).alias("best"))
    out = single.unionByName(ranking.merged_turns(rows, best))
    told = multi.select("task_id", "multi").join(lead, "task_id", "left")
    return out.join(checked_broadcast(told), "task_id").select("task_id", "ord", "file_id", "score", "turn", "matched_queries", "best", "multi")


#: Lines of a manifest.
MOST_LISTED = hints.MANIFEST_STEPS[0]


def selections(scored: DataFrame, chunks: DataFrame, tasks: DataFrame, ceilings: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(facts, done): the ranked sections of each task as ranked_facts gives them, and each task's selection as folded gives it.

    scored: as scored_sections gives it; tasks: (task_id, file_id, task, token_budget, name of the source, and optionally forced,
    an array of section ids).  With ceilings each task is selected under every one of these, as task_id@ceiling; it is ranked once.
    """
    facts, told = ranked_facts(scored, chunks, tasks)
    facts = store(facts, "facts")
    asked = tasks.withColumn("of", F.col("task_id"))
    if ceilings:
        asked = asked.withColumn("token_budget", F.explode(F.array(*map(F.lit, ceilings)))).withColumn("task_id", F.concat_ws("@", "task_id", "token_budget"))
    read = asked.select("task_id", "of", "name", F.col("token_budget").cast("int").alias("budget"), Q.surname(F.col("task")).alias("surname"), Q.terms(F.col("task")).alias("terms"))
    return facts, store(folded(facts, told, chunks, read), "folded")


def selected_texts(done: DataFrame, chunks: DataFrame) -> DataFrame:
    """(task_id, file_id, ord, id, breadcrumb, tokens, full, text): the sections of selections, with what is left of their texts."""
    rows = done.select("task_id", "file_id", F.explode("selected").alias("s")).select("task_id", "file_id", "s.ord", "s.tokens", "s.full", F.col("s.text").alias("part"))
    texts = chunks.select("file_id", "ord", "id", "breadcrumb", F.col("text").alias("whole"))
    return rows.join(texts, ["file_id", "ord"]).select("task_id", "file_id", "ord", "id", "breadcrumb", "tokens", "full", F.coalesce("part", "whole").alias("text"))


def packed(scored: DataFrame, chunks: DataFrame, tasks: DataFrame) -> DataFrame:
    """The selection of each task with its artifact (PACKED); scored and tasks as selections takes them.

    Texts meet a task only where they are selected, and as labels where they are listed.
    """
    facts, done = selections(scored, chunks, tasks)
    relevance = ranking.relevance(F.col("score"), F.col("top"))
    matched = F.when(F.col("multi"), F.col("matched"))
    texts = selected_texts(done, chunks).select("task_id", "ord", F.col("tokens").alias("kept_tokens"), "full", F.col("text").alias("kept"))
    rows = facts.select("task_id", "ord", "id", "pos", "score", "top", "multi", "matched", "tokens", "breadcrumb").join(texts, ["task_id", "ord"], "left")
    entry = F.struct("id", F.col("ord").cast("int").alias("ord"), F.col("breadcrumb").alias("section"), F.coalesce("kept_tokens", "tokens").alias("tokens"), relevance.alias("relevance"), F.col("full").isNotNull().alias("truncated"),
                     F.col("full").alias("full_tokens"), matched.alias("matched_queries"), F.col("kept").alias("text"))
    chosen = F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("ord", entry.alias("s"))))
    left = F.collect_list(F.when(F.col("kept").isNull(), F.struct("pos", entry.alias("s"))))
    bare = lambda l: F.transform(F.array_sort(l), lambda x: x["s"])
    peak = F.max(F.when(F.col("kept").isNotNull(), F.col("score"))).alias("peak")
    lists = rows.groupBy("task_id").agg(bare(chosen).alias("selected_sections"), bare(left).alias("omitted_sections"), peak)

    # What the manifest calls the first of the omitted ones.  As many as are selected may stand between them.
    near = facts.select("task_id", "file_id", "ord", "pos").join(done.select("task_id", F.size("selected").alias("k")), "task_id").filter(F.col("pos") <= F.col("k") + MOST_LISTED)
    head, preview = section_heading(F.col("breadcrumb")), section_preview(F.col("text"))
    name = F.when(head != "", head).when(preview != "", preview).otherwise(F.col("id"))
    size = F.struct(utf16_length(F.col("text")).alias("u"), utf16_length(crumb_line(F.col("breadcrumb"))).alias("cu"))
    calls = near.join(chunks, ["file_id", "ord"]).select("task_id", "pos", F.struct("id", section_label(F.col("breadcrumb"), F.col("text")).alias("label"), "tokens", name.alias("name"), size.alias("size")).alias("x"))
    called = calls.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("called"))
    out = done.drop("selected").join(lists, "task_id").join(called, "task_id")
    omitted = F.size("omitted_sections")
    span = id_span(hints.ids(F.col("omitted_sections")))
    first = F.get("called", F.lit(0))
    # The first of the ranking is told to be too large if it is left out, wouldn't fit alone, and nothing as good is in.
    others = F.when(F.col("n_sections") > 1, utf16_length(hints.manifest(F.array(), F.col("n_sections") - 1, id_span(F.filter(F.concat(hints.ids(F.col("selected_sections")), hints.ids(F.col("omitted_sections"))), lambda i: i != first["id"])), 0)) + 1).otherwise(0)
    alone = F.floor((header_length(F.col("name")) + first["size"]["cu"] + first["size"]["u"] + 2 + others + len(END)) / 4) <= F.col("budget")
    peer = (F.col("top") > 0) & F.coalesce(F.col("peak") >= F.col("top"), F.lit(False))
    shut = F.exists("omitted_sections", lambda s: s["id"] == first["id"]) & ~alone & ~peer
    big = F.when(shut, F.struct(first["id"].alias("id"), first["name"].alias("name"), first["tokens"].alias("tokens")))
    listed = F.filter("called", lambda c: ~F.array_contains(hints.ids(F.col("selected_sections")), c["id"]))
    lines = F.coalesce(F.concat(hints.manifest(listed, omitted, span, MOST_LISTED, big), F.lit("\n")), F.lit(""))
    body = artifact_body(F.transform("selected_sections", lambda s: F.struct(s["section"].alias("breadcrumb"), s["text"].alias("text"))))
    markdown = F.concat(F.lit("<!-- Compiled context from: "), "name", F.lit(f" -->\n{NOTE}\n\n"), body, lines, F.lit(END))
    return out.select("task_id", "file_id", markdown.alias("markdown"), F.col("used").alias("tokens_used"), F.col("stopped").alias("stopped_early"), F.col("selected_sections").cast(f"array<{_STRUCT}>"), F.col("omitted_sections").cast(f"array<{_STRUCT}>"), "best")


def compile_context(docs: DataFrame, tasks: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row a task: the artifact, what is in it and what was left out, meters, hint, buckets and notes.

    docs: (file_id, name, markdown); tasks: (task_id, file_id, task, token_budget).  Tasks on files without sections give no row.
    """
    chunks = store(chunk_markdown(docs), "chunks") if chunks is None else chunks
    tasks = tasks.withColumn("task_id", F.col("task_id").cast("string"))
    aspects = store(aspect_rows(tasks), "aspects")
    named = docs.select("file_id", source_name(F.col("name")).alias("name"), token_count(F.col("markdown")).alias("raw_tokens"))
    done = store(packed(scored_sections(chunks, aspects), chunks, tasks.join(named.select("file_id", "name"), "file_id")), "packed")
    queries = aspects.groupBy("task_id").agg(F.first("queries").alias("queries"), F.first("token_budget").alias("token_budget"))
    out = done.join(queries, "task_id").join(named.select("file_id", "raw_tokens"), "file_id")
    budget, used, chosen, omitted = F.col("token_budget"), F.col("tokens_used"), F.col("selected_sections"), F.col("omitted_sections")
    out = out.withColumn("reduction_pct", reduction_pct(F.col("raw_tokens"), used)).withColumn("tokens_saved", tokens_saved(F.col("raw_tokens"), used))
    out = out.withColumn("next_section_hint", hints.next_section_hint(budget, used, omitted, chosen))
    hint = F.col("next_section_hint")
    out = out.withColumn("buckets", hints.omit_buckets(budget, used, chosen, omitted, hint, F.col("best")))
    return out.withColumn("compile_hints", hints.compile_hints(F.size("queries"), F.col("reduction_pct"), F.col("stopped_early"), budget, used, chosen, omitted, hint))


def measure(docs: DataFrame) -> DataFrame:
    return docs.select("file_id", "name", token_count(F.col("markdown")).alias("raw_tokens"))


def artifact_body(sections: Column) -> Column:
    """What stands between an artifact's first lines and its manifest: sections (array of struct<breadcrumb, text>), a breadcrumb
    where it changes."""
    def one(s: Column, i: Column) -> Column:
        same = F.get(sections, i - 1)["breadcrumb"].eqNullSafe(s["breadcrumb"]) & (i > 0)
        return F.concat(F.when(same, "").otherwise(F.concat(F.lit("<!-- section: "), s["breadcrumb"], F.lit(" -->\n"))), s["text"], F.lit("\n\n"))

    return F.array_join(F.transform(sections, one), "")


def assembled(sections: DataFrame) -> DataFrame:
    """(key, markdown): the artifact of each key's sections (key, name, ord, breadcrumb, text), without a manifest.

    Expressions alone: a breadcrumb is told where it changes, so each section looks at the one before it in its list.
    """
    listed = sections.groupBy("key", "name").agg(F.array_sort(F.collect_list(F.struct("ord", "breadcrumb", "text"))).alias("l"))
    head = F.concat(F.lit("<!-- Compiled context from: "), "name", F.lit(f" -->\n{NOTE}\n\n"))
    return listed.select("key", F.concat(head, artifact_body(F.col("l")), F.lit(END)).alias("markdown"))


def parity_contexts(proved: DataFrame, docs: DataFrame, cap: int = 60_000) -> DataFrame:
    """(task_id, full, context, full_tokens, context_tokens, reduction_pct): what the same question is asked of, whole file and selection.

    proved: (task_id, file_id, markdown); docs: (file_id, markdown).  A file of more than `cap` tokens is read up to that.
    """
    n = token_count(F.col("markdown"))
    head = F.concat(F.substring("markdown", F.lit(1), F.floor(F.length("markdown") * F.lit(cap) / n).cast("int")), F.lit(CAP_MARK))
    full = docs.select("file_id", F.when(n <= cap, F.col("markdown")).otherwise(head).alias("full"))
    both = proved.select("task_id", "file_id", F.col("markdown").alias("context")).join(full, "file_id")
    both = both.withColumn("full_tokens", content_tokens(F.col("full"))).withColumn("context_tokens", content_tokens(F.col("context")))
    return both.withColumn("reduction_pct", F.greatest(F.lit(0.0), reduction_pct(F.col("full_tokens"), F.col("context_tokens"))))


def responses(compiled: DataFrame, texts: bool = False, price: float = PRICE_PER_MILLION) -> DataFrame:
    """(task_id, json): each row of compile_context as one JSON object, without the sections' texts (they stand in markdown), or with them and the costs."""
    bare = F.transform("selected_sections", lambda s: s.dropFields("text"))
    out = compiled if texts else compiled.withColumn("selected_sections", bare)
    out = out.withColumn("omitted_sections", F.transform("omitted_sections", lambda s: s.dropFields("text")))
    if texts:
        out = out.withColumns({"cost_raw_usd": cost_usd(F.col("raw_tokens"), price), "cost_compiled_usd": cost_usd(F.col("tokens_used"), price), "price_per_mtok": F.lit(price)})
    return out.select("task_id", F.to_json(F.struct(*[c for c in out.columns if c != "best"])).alias("json"))


def expanded(text: Column, tokens: Column, budget: Column, terms: Column) -> Column:
    """struct<text, tokens, truncated, query_miss>: a section as it is, or cut to a budget around terms; query_miss where terms
    that the whole section has in few lines are in none of what is left."""
    asked = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.length(t) > 1)
    holds = lambda x, ts: F.exists(ts, lambda t: F.contains(F.lower(x), t))

    def judged(p: Column) -> Column:
        lines = F.transform(F.split(text, "\n"), lambda x: F.lower(x))
        few = lambda low: F.filter(asked, lambda t: F.size(F.filter(low, lambda x: F.contains(x, t))).between(1, 3))
        rare = let(lines, lambda low: let(few(low), lambda r: F.when(F.size(r) > 0, r).otherwise(asked)))
        miss = let(rare, lambda r: holds(text, r) & ~holds(p["text"], r))
        return F.struct(p["text"].alias("text"), p["tokens"].alias("tokens"), F.lit(True).alias("truncated"), F.coalesce(p.isNotNull() & miss, F.lit(False)).alias("query_miss"))

    whole = F.struct(text.alias("text"), tokens.cast("int").alias("tokens"), F.lit(False).alias("truncated"), F.lit(False).alias("query_miss"))
    return F.when(text.isNull() | (tokens <= budget), whole).otherwise(let(cut(text, tokens, budget, terms), judged))


def expand_sections(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (file_id, section_id, token_budget, task) with the section's markdown, or an error and the file's outline.

    A section over the budget is cut, around the task's terms if there is a task.
    """
    listed = chunks.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "breadcrumb", "tokens"))), lambda c: F.struct(c["id"].alias("id"), c["breadcrumb"].alias("section"), c["tokens"].alias("tokens"))).alias("outline"))
    matched = wanted.join(chunks.select("file_id", F.col("id").alias("section_id"), "breadcrumb", "text", "tokens"), ["file_id", "section_id"], "left")
    done = matched.withColumn("terms", Q.terms(F.col("task"))).withColumn("x", expanded(F.col("text"), F.coalesce("tokens", F.lit(0)), F.col("token_budget"), F.col("terms")))
    missing = F.when(F.col("breadcrumb").isNull(), F.concat(F.lit("No section with id '"), "section_id", F.lit("'"))).when(
        F.col("x.text").isNull(), F.concat(F.lit("Section '"), "section_id", F.lit("' needs at least "), "token_budget", F.lit(" tokens"))
    )
    markdown = F.when(missing.isNull(), F.concat(F.lit("<!-- section: "), "breadcrumb", F.lit(" (UNTRUSTED CONTENT) -->\n"), "x.text"))
    out = done.join(listed, "file_id", "left").withColumn("error", missing).withColumn("markdown", markdown)
    return out.select("file_id", "section_id", "token_budget", "markdown", F.when(markdown.isNotNull(), content_tokens(markdown)).alias("tokens_used"),
                      "x.truncated", F.when(F.col("x.truncated"), F.col("tokens")).alias("full_tokens"), "x.query_miss", "error", F.when(missing.isNotNull(), F.col("outline")).alias("outline"))


def prove_context(compiled: DataFrame, chunks: DataFrame, expanded: DataFrame, most: int = 2000) -> DataFrame:
    """(task_id, markdown, expanded_applied, expand_content_tokens): the selection and the sections asked for on top, in the
    order of the file; a cut section that is asked for is read again up to `most` tokens.  expanded: (task_id, section_id)."""
    chosen = compiled.select("task_id", "file_id", F.explode("selected_sections").alias("s")).select("task_id", "file_id", F.col("s.id").alias("id"), F.col("s.text").alias("has"), F.col("s.tokens").alias("has_tokens"), F.coalesce("s.truncated", F.lit(False)).alias("cut"))
    asked = expanded.join(compiled.select("task_id", "file_id"), "task_id").select("task_id", "file_id", F.col("section_id").alias("id")).distinct().withColumn("asked", F.lit(True))
    both = chosen.join(asked, ["task_id", "file_id", "id"], "full").join(chunks.select("file_id", "id", "ord", "breadcrumb", "text", "tokens"), ["file_id", "id"])
    fresh = F.col("has").isNull() | (F.coalesce("asked", F.lit(False)) & F.col("cut"))
    part = F.when(fresh, cut(F.col("text"), F.col("tokens"), F.lit(most), F.array().cast("array<string>")))
    read = both.withColumn("part", part).withColumn("now", F.coalesce("part.text", "has"))
    more = F.when(F.col("part").isNotNull(), F.greatest(F.lit(0), content_tokens(F.col("part.text")) - F.when(F.col("has").isNotNull(), content_tokens(F.col("has"))).otherwise(0)))
    rows = read.select("task_id", "file_id", "ord", "id", "breadcrumb", F.col("now").alias("text"), F.col("part").isNotNull().alias("applied"), more.alias("more"))
    kept = F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "breadcrumb", "text")))
    out = rows.groupBy("task_id").agg(F.first("file_id").alias("name"), F.array_sort(kept).alias("l"), F.array_sort(F.collect_list(F.when(F.col("applied"), F.struct("ord", "id")))).alias("applied"), F.coalesce(F.sum("more"), F.lit(0)).cast("int").alias("expand_content_tokens"))
    markdown = F.concat(F.lit("<!-- Compiled context from: "), "name", F.lit(f" -->\n{NOTE}\n\n"), artifact_body(F.col("l")), F.lit(END))
    return out.select("task_id", markdown.alias("markdown"), F.transform("applied", lambda x: x["id"]).alias("expanded_applied"), "expand_content_tokens")
