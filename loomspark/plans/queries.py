"""The registered queries over the data folder's tables.

A file is a source of documents and a section is a document; tasks are whole texts of benchmark in up to six aspects, of eight words or of a sixth of a longer text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import query as Q
from loomspark.functions import text as X
from loomspark.functions import tokens as K
from loomspark.operators import hints, matching, ranking
from loomspark.operators.chunking import blocks, chunk_markdown, lines, outline, sections
from loomspark.operators.index import build_index, top_sections
from loomspark.operators.sizes import cut
from loomspark.plans import compile as C
from loomspark.sources.files import cache_rows, cache_swept, cache_valid, catalog, guard, html_to_markdown
from loomspark.sources.files import full_markdown as full_docs
from loomspark.sources.shared import store
from loomspark.streaming import state as S
from loomspark.streaming import workspace as W

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections are numbered by doc_id, which orders them within their file."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    file_id = F.coalesce("source", F.lit(""))
    return docs.select(file_id.alias("file_id"), F.col("doc_id").alias("ord"), F.concat_ws(" > ", "source", "lang").alias("breadcrumb"), "text", K.token_count(F.col("text")).alias("tokens"), F.concat(F.lit("s"), "doc_id").alias("id"))


def benchmark_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.coalesce("source", F.lit(""))
    files = read(spark, sf_dir, "documents").agg(F.array_sort(F.collect_set(F.struct(F.length(source), source.alias("file_id")))).alias("files"))
    words = F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\r\n]+", " ")), " ")
    items = read(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).withColumn("each", F.greatest(F.lit(8), F.ceil(F.size("w") / Q.MOST_ASPECTS)).cast("int")).crossJoin(F.broadcast(files))
    slices = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / F.col("each")).cast("int") - 1), lambda i: F.slice("w", i * F.col("each") + 1, F.col("each")))
    file_id = F.get("files", F.pmod("item_id", F.size("files")).cast("int"))["file_id"]
    parts = items.select(F.col("item_id").alias("task_id"), file_id.alias("file_id"), F.posexplode(slices).alias("qi", "w"))
    return parts.select("task_id", "file_id", "qi", F.concat_ws(" ", "w").alias("query")).withColumn("terms", Q.terms(F.col("query")))


def _raw(spark, sf_dir, **how):
    return ranking.bm25(document_chunks(spark, sf_dir), store(benchmark_aspects(spark, sf_dir), "aspects"), **how)


def _stored_rows(spark, sf_dir):
    """Normalised scores that several steps read."""
    return store(_rows(spark, sf_dir).withColumn("s", F.round("s", 6)), "rows")


def _rows(spark, sf_dir, **how):
    return ranking.normalized(store(_raw(spark, sf_dir, **how), "scores"))


def _scores(spark, sf_dir):
    return ranking.merged(_rows(spark, sf_dir))


def conversation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat(F.lit("## "), "role", F.lit(" "), "turn", F.lit("\n\n"), "text").alias("md")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    body = F.array_join(F.transform("t", lambda x: x["md"]), "\n\n")
    return grouped.select(F.concat(F.lit("conv"), "conv_id").alias("file_id"), F.concat(F.lit("conv"), "conv_id", F.lit(".md")).alias("name"), F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n\n"), body).alias("markdown"))


# --- meters and scalars ----------------------------------------------------------------------------------------------


def token_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", K.token_count(F.col("text")).alias("tokens"))


def content_tokens(spark, sf_dir):
    text = F.concat(F.lit("<!-- note -->\n\n\n\n"), "text", F.lit("\n\n\n<!-- a\nb -->  "))
    return read(spark, sf_dir, "documents").select("doc_id", K.content_tokens(text).alias("tokens"))


def clamp_budget(spark, sf_dir):
    value = F.when(F.col("doc_id") % 7 == 0, "soon").otherwise((F.col("n_chars") * 37 - 9000).cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", *[K.clamp_budget(value, s).alias(s) for s in ("web", "compile", "expand")])


def token_savings(spark, sf_dir):
    raw, used = K.token_count(F.col("text")), (F.col("n_chars") % 997).cast("int")
    return read(spark, sf_dir, "documents").select("doc_id", K.tokens_saved(raw, used).alias("saved"), K.reduction_pct(raw, used).alias("pct"), F.round(K.cost_usd(raw), 8).alias("usd"),
                                                   K.packaging_note(raw, used).isNotNull().alias("gap"))


def tokenize_freq(spark, sf_dir):
    """Raw tokens are counted first, so each distinct one is stemmed once."""
    raw = read(spark, sf_dir, "documents").select("lang", F.explode(X.raw_tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))
    terms = raw.select("lang", F.explode(X.terms_of(F.col("token"))).alias("term"), "n")
    return terms.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_terms"), F.max("n").alias("most"))


def light_stem(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).groupBy(X.light_stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"))


#: Letters and what stands for them in texts that have none.
LATIN, HAN = "abcdefghijklmnopqrst", "保修条款雨飞行規則山川日月木水火土金人大"


def cjk_ngrams(spark, sf_dir):
    """Documents whose letters but for u to z are written in Han."""
    tokens = X.tokenize(F.translate(F.lower(F.coalesce("text", F.lit(""))), LATIN, HAN))
    return read(spark, sf_dir, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def arabic_terms(spark, sf_dir):
    """Documents with Arabic words, with and without their signs, behind them."""
    tokens = X.tokenize(F.concat(F.coalesce("text", F.lit("")), F.lit(" كِتَابٌ ـالخبّاز cafés كتب")))
    return read(spark, sf_dir, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def budget_presets(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 50 > 0, K.token_count(F.col("text")) * 3)
    return read(spark, sf_dir, "documents").select("doc_id", K.budget_presets(raw).alias("p")).select("doc_id", "p.quick", "p.standard", "p.deep")


def packaging_note(spark, sf_dir):
    n = K.token_count(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", K.packaging_note(n, (n + F.col("n_chars") % 300).cast("int")).alias("note"))


def settings(spark, sf_dir):
    values = F.array(*map(F.lit, ("12.9", "", "abc", "-5", "1e3", " 70 ", "NaN", "Infinity")))
    value = F.get(values, (F.col("doc_id") % 9).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", K.setting(value, 30, 2, 500).alias("whole"), K.setting(value, 0.5, 0, 80, whole=False).alias("number"))


def query_terms(spark, sf_dir):
    """Benchmark texts behind a name and a filler phrase."""
    task = F.concat(F.lit("What did Jane Bennet say early on about Red Headed mr Smith "), F.lower(F.coalesce("text", F.lit(""))))
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(Q.terms(task), " ").alias("terms"))


def _long_words(spark, sf_dir, least: int):
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{5,}"), F.lit(0))
    return read(spark, sf_dir, "documents").select("doc_id", "text", w.alias("w")).filter(F.size("w") >= least)


def split_aspects(spark, sf_dir):
    """Tasks of a question, an ask behind a semicolon, and two asks that a comma and a joining word part."""
    two = lambda i: F.array_join(F.slice("w", i, 2), " ")
    task = F.concat(two(1), F.lit("? "), two(3), F.lit("; ¿"), two(5), F.lit(", and which "), two(7))
    return _long_words(spark, sf_dir, 8).select("doc_id", F.array_join(Q.aspects(task), "|").alias("aspects"))


def split_commas(spark, sf_dir):
    """Tasks of three questions between commas; every third has one part that is no question and stays whole."""
    two = lambda i: F.array_join(F.slice("w", i, 2), " ")
    task = F.concat(F.lit("what is "), two(1), F.when(F.col("doc_id") % 3 == 0, ", about ").otherwise(", who is "), two(3), F.lit(", where is "), two(5))
    return _long_words(spark, sf_dir, 8).select("doc_id", F.array_join(Q.aspects(task), "|").alias("aspects"))


def name_intent(spark, sf_dir):
    """Tasks for a given name, and whether texts that end in different forms of the name tell it."""
    name = F.initcap(F.element_at("w", 1))
    task = F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("Who is Mr. "), name)).otherwise(F.concat(F.lit("What is Mr. "), name, F.lit("'s first name?")))
    end = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Anna "), name)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" Miss "), name)).otherwise(F.concat(F.lit(" ANNA "), F.upper(name)))
    rows = _long_words(spark, sf_dir, 1).withColumn("surname", Q.surname(task))
    return rows.select("doc_id", "surname", Q.given_name(F.concat("text", end), "surname").alias("named"))


def names_and_ids(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("C:\\data\\"), "source", F.lit(" -->"), "lang", F.lit("__(1).md\n"))
    json = F.concat(F.lit('["s'), F.col("doc_id"), F.lit('","s'), F.col("doc_id") % 5, F.lit('","x1","s2","s2"]'))
    return docs.select("doc_id", X.source_name(name).alias("name"), F.array_join(X.expanded_ids(json), ",").alias("ids"), X.id_span(F.array(F.concat(F.lit("s"), "doc_id"), F.concat(F.lit("s"), F.col("doc_id") % 9))).alias("span"))


def section_labels(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("file_id", "ord", X.section_label(F.col("breadcrumb"), F.col("text")).alias("label"))


# --- sections --------------------------------------------------------------------------------------------------------


def chunk_conversations(spark, sf_dir):
    return chunk_markdown(conversation_docs(spark, sf_dir)).select("file_id", "id", "ord", "breadcrumb", F.md5("text").alias("text_md5"), "tokens")


def chunk_oversize(spark, sf_dir):
    """Each conversation as one section of all texts with a table behind them, which is cut at blocks where it is over the limit."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    texts = F.array_join(F.transform("t", lambda x: F.concat(x["text"], F.lit(" "), F.repeat(F.lit("word "), 60), x["turn"])), "\n\n")
    rows = F.array_join(F.transform("t", lambda x: F.concat(F.lit("| "), x["role"], F.lit(" | "), x["turn"], F.lit(" |"))), "\n")
    md = F.concat(F.lit("# All\n\n"), texts, F.lit("\n"), rows, F.lit("\nend"))
    docs = grouped.select(F.col("conv_id").cast("string").alias("file_id"), md.alias("markdown"))
    return chunk_markdown(docs).select("file_id", "id", "ord", "breadcrumb", F.md5("text").alias("text_md5"), "tokens")


def full_markdown(spark, sf_dir):
    docs = full_docs(conversation_docs(spark, sf_dir))
    return docs.select("file_id", "name", F.md5("markdown").alias("text_md5"), F.length("markdown").alias("n_chars"))


def sample_catalog(spark, sf_dir):
    """Conversations as samples, of which those with an even number of letters in their name are measured."""
    samples = conversation_docs(spark, sf_dir).select("name", F.upper("file_id").alias("title"))
    return catalog(samples, C.measure(conversation_docs(spark, sf_dir)).filter(F.length("name") % 2 == 0))


def section_outline(spark, sf_dir):
    return outline(chunk_markdown(conversation_docs(spark, sf_dir))).groupBy("file_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("section").alias("last_section"))


def block_split(spark, sf_dir):
    found = blocks(sections(lines(conversation_docs(spark, sf_dir)))).filter("block is not null")
    return found.groupBy("file_id").agg(F.countDistinct("section", "block").alias("n_blocks"), F.count("*").alias("n_lines"))


def html_markdown(spark, sf_dir):
    @F.pandas_udf("string")
    def convert(s):
        return s.map(lambda x: html_to_markdown(x or ""), na_action=None)

    return read(spark, sf_dir, "pages").select("page_id", convert("html").alias("markdown")).select("page_id", "markdown", K.token_count(F.col("markdown")).alias("tokens"))


# --- ranking ---------------------------------------------------------------------------------------------------------


def bm25_single(spark, sf_dir):
    return _raw(spark, sf_dir, boost=False, zeros=False).filter("s > 0").select("task_id", "qi", "ord", F.round("s", 4).alias("s"))


def bm25_heading_boost(spark, sf_dir):
    # Headings here are source and language; the language is asked as a term.
    asked = store(benchmark_aspects(spark, sf_dir).withColumn("terms", F.array_append("terms", F.lit("de"))), "aspects")
    return ranking.bm25(document_chunks(spark, sf_dir), asked, zeros=False).filter("s > 0").select("task_id", "qi", "ord", F.round("s", 4).alias("s"))


def per_query_norm(spark, sf_dir):
    return _rows(spark, sf_dir, zeros=False).filter("s > 0").select("task_id", "qi", "ord", F.round("s", 4).alias("s"))


def multi_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("task_id", "ord", F.round("score", 4).alias("score"))


def relevance_pct(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    top = scores.groupBy("task_id").agg(K.max_of(F.col("score")).alias("top"))
    return scores.join(top, "task_id").select("task_id", "ord", ranking.relevance(F.round("score", 6), F.round("top", 6)).alias("relevance"))


def topk_sections(spark, sf_dir):
    return ranking.ranked(_scores(spark, sf_dir).withColumn("score", F.round("score", 6))).filter("pos < 10").select("task_id", "pos", "ord")


def indexed_topk(spark, sf_dir):
    """The ten best sections of each aspect from a stored index, without what breadcrumbs add."""
    found = top_sections(build_index(document_chunks(spark, sf_dir)), store(benchmark_aspects(spark, sf_dir), "aspects"))
    return found.select("task_id", "qi", "pos", "ord", F.round("s", 4).alias("s"))


def best_id(spark, sf_dir):
    rows = _stored_rows(spark, sf_dir)
    return ranking.best_ids(rows, document_chunks(spark, sf_dir), benchmark_aspects(spark, sf_dir))


def attribution(spark, sf_dir):
    rows = _stored_rows(spark, sf_dir)
    return ranking.attribution(rows).select("task_id", "ord", F.array_join(F.transform("matched_queries", lambda q: q.cast("string")), ",").alias("queries"))


def round_robin(spark, sf_dir):
    rows = _stored_rows(spark, sf_dir)
    best = ranking.best_ids(rows, document_chunks(spark, sf_dir), benchmark_aspects(spark, sf_dir))
    return ranking.round_robin(rows, best).select("task_id", "pos", "ord")


def score_shape(spark, sf_dir):
    return ranking.score_shape(_scores(spark, sf_dir)).select("task_id", F.round("top", 4).alias("top"), "flat")


def relevance_floor(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    top = scores.groupBy("task_id").agg(K.max_of(F.col("score")).alias("top"))
    return scores.join(top, "task_id").filter(ranking.passes_floor(F.round("score", 6), F.col("top"))).groupBy("task_id").agg(F.count("*").alias("n"))


def top_cluster(spark, sf_dir):
    return ranking.top_cluster(_scores(spark, sf_dir).withColumn("score", F.round("score", 6))).select("task_id", "ord")


def discriminative_terms(spark, sf_dir):
    """Terms in one to three lines of a section; all that its file is asked for where there are none."""
    chunks = document_chunks(spark, sf_dir)
    asked = store(benchmark_aspects(spark, sf_dir).select("file_id", F.explode("terms").alias("term")).filter("length(term) > 1").distinct(), "asked")
    few = matching.term_lines(chunks, asked).filter(F.col("lines") <= matching.MOST_LINES).groupBy("file_id", "ord").agg(F.array_sort(F.collect_list("term")).alias("rare"))
    every = asked.groupBy("file_id").agg(F.array_sort(F.collect_list("term")).alias("every"))
    out = chunks.select("file_id", "ord").join(every, "file_id").join(few, ["file_id", "ord"], "left")
    return out.select("file_id", "ord", F.array_join(F.coalesce("rare", "every"), ",").alias("terms"))


# --- selection -------------------------------------------------------------------------------------------------------


#: Sections of a task that count as selected where none is chosen by a budget.
PICKED = 3


def _picked(spark, sf_dir):
    """Task, budget 1000, the ranking's first three sections as selected and all others as left out, with the aspects they match and each aspect's best id."""
    scored, chunks = _stored_rows(spark, sf_dir), document_chunks(spark, sf_dir)
    pos = ranking.ranked(ranking.merged(scored))
    top = pos.groupBy("task_id").agg(F.max("score").alias("top"))
    rows = pos.join(top, "task_id").join(chunks.drop("text"), ["file_id", "ord"]).join(ranking.attribution(scored).drop("file_id"), ["task_id", "ord"], "left")
    rel = ranking.relevance(F.col("score"), F.col("top"))
    entry = F.struct("id", F.col("breadcrumb").alias("section"), "tokens", rel.alias("relevance"), F.lit(False).alias("truncated"), F.lit(None).cast("int").alias("full_tokens"), "matched_queries")
    listed = rows.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("s")))).alias("l"))
    best = ranking.best_ids(scored, chunks, benchmark_aspects(spark, sf_dir))
    lead = best.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("qi", "ord"))), lambda x: F.concat(F.lit("s"), x["ord"])).alias("best"))
    part = lambda keep: F.transform(F.filter("l", keep), lambda x: x["s"])
    out = listed.join(lead, "task_id", "left").select("task_id", part(lambda x: x["pos"] < 3).alias("selected"), part(lambda x: x["pos"] >= 3).alias("omitted"), "best")
    used = F.aggregate("selected", F.lit(0), lambda a, s: a + s["tokens"])
    return out.withColumn("used", used).withColumn("budget", F.greatest(F.lit(1000), used + 20))


def next_hint(spark, sf_dir):
    hint = hints.next_section_hint(F.col("budget"), F.col("used"), F.col("omitted"), F.col("selected"))
    return _picked(spark, sf_dir).withColumn("h", hint).select("task_id", "h.id", "h.tokens", "h.relevance", "h.suggested_budget")


def bound_hint(spark, sf_dir):
    """What a task is told about the section that its budget kept out."""
    hint = hints.next_section_hint(F.col("budget"), F.col("used"), F.col("omitted"), F.col("selected"))
    p = _picked(spark, sf_dir).withColumn("h", hint).withColumn("kind", hints.bound_hint_kind(F.col("h"), F.col("selected"), F.slice("omitted", 1, 1)))
    return p.select("task_id", F.when(F.col("h").isNotNull(), F.col("kind")).alias("kind"), hints.bound_hint_text(F.col("h"), F.col("budget"), F.col("kind")).alias("text"))


def omit_buckets(spark, sf_dir):
    p = _picked(spark, sf_dir).withColumn("h", hints.next_section_hint(F.col("budget"), F.col("used"), F.col("omitted"), F.col("selected")))
    b = hints.omit_buckets(F.col("budget"), F.col("used"), F.col("selected"), F.col("omitted"), F.col("h"), F.col("best"))
    return p.withColumn("b", b).select("task_id", F.array_join(hints.ids(F.col("b.budget")), ",").alias("for_budget"), F.size("b.relevance").alias("n_for_relevance"))


def compile_hints(spark, sf_dir):
    p = _picked(spark, sf_dir).withColumn("h", hints.next_section_hint(F.col("budget"), F.col("used"), F.col("omitted"), F.col("selected")))
    notes = hints.compile_hints(F.size("best"), F.lit(50.0), F.lit(False), F.col("budget"), F.col("used"), F.col("selected"), F.col("omitted"), F.col("h"))
    return p.withColumn("n", notes).select("task_id", "n.multi_part_nudge", "n.omit_action", "n.named_omit", "n.early_stopped")


def omitted_sections(spark, sf_dir):
    pos = ranking.ranked(_scores(spark, sf_dir).withColumn("score", F.round("score", 6)))
    return pos.join(pos.filter("pos < 3").select("task_id", "ord"), ["task_id", "ord"], "left_anti").groupBy("task_id").agg(F.count("*").alias("n"), F.min_by("ord", "pos").alias("first_ord"))


def _selected(out: DataFrame, *more) -> DataFrame:
    """What a selection comes to: ids in document order, tokens of the packed text, and how many were left out."""
    picked = F.array_join(hints.ids(F.col("selected_sections")), ",").alias("selected")
    return out.select(F.col("task_id"), picked, "tokens_used", "stopped_early", F.size("omitted_sections").alias("n_omitted"), *more)


def _benchmark_tasks(spark, sf_dir):
    """(aspects, tasks): whole benchmark texts on one file each, and room for all that they need."""
    aspects = benchmark_aspects(spark, sf_dir).withColumn("task_id", F.col("task_id").cast("string"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("qi", "query"))), lambda x: x["query"]), " ")
    tasks = store(aspects.groupBy("task_id", "file_id").agg(whole.alias("task")), "tasks")
    return store(aspects.join(tasks, ["task_id", "file_id"]), "aspects"), tasks.withColumns({"token_budget": F.lit(1_000_000), "name": F.lit("corpus")})


def _folded(done: DataFrame, *more) -> DataFrame:
    """The same of a selection as the fold gives it."""
    picked = F.array_join(F.transform("selected", lambda x: F.concat(F.lit("s"), x["ord"])), ",").alias("selected")
    return done.select("task_id", picked, F.col("used").alias("tokens_used"), F.col("stopped").alias("stopped_early"), (F.col("n_sections") - F.size("selected")).cast("int").alias("n_omitted"), *more)


def _select(spark, sf_dir, forced: bool):
    chunks = document_chunks(spark, sf_dir)
    aspects, tasks = _benchmark_tasks(spark, sf_dir)
    scored = store(C.scored_sections(chunks, aspects).withColumn("score", F.round("score", 6)), "scored")
    if forced:
        # The section that ranks last for every second task.
        last = scored.groupBy("task_id").agg(F.max_by("ord", F.when(F.col("multi"), F.col("turn") * 1.0).otherwise(-F.col("score") + F.col("ord") / 1e9)).alias("ord"))
        tasks = tasks.join(last, "task_id").withColumn("forced", F.when(F.col("task_id").cast("long") % 2 == 0, F.array(F.concat(F.lit("s"), "ord")))).drop("ord")
    return _folded(C.selections(scored, chunks, tasks)[1]).withColumn("task_id", F.col("task_id").cast("long"))


def select_sections(spark, sf_dir):
    """Coverage first, under a ceiling that all of it fits: open aspects, then rare terms, an end when all is covered."""
    return _select(spark, sf_dir, False)


def select_forced(spark, sf_dir):
    """The same with a section that must be in."""
    return _select(spark, sf_dir, True)


def select_tight(spark, sf_dir):
    """Tasks of several aspects under ceilings that bind: parts of needed sections, later whole ones in their place, an end of room.  Each section is one line."""
    chunks = _one_line(document_chunks(spark, sf_dir))
    aspects, tasks = _benchmark_tasks(spark, sf_dir)
    scored = store(C.scored_sections(chunks, aspects).withColumn("score", F.round("score", 6)).filter("multi"), "scored")
    done = C.selections(scored, chunks, tasks, (70, 250, 600, 1500))[1]
    return _folded(done).join(_parts(done, chunks), "task_id", "left").withColumn("parts", F.coalesce("parts", F.lit("")))


def _vague(spark, sf_dir, budgets: tuple[int, ...]):
    """Tasks that say nothing, one a file and budget; scores come from the sections' numbers: all alike in every third file, one on top in the next, seven steps else."""
    chunks = document_chunks(spark, sf_dir)
    first = chunks.groupBy("file_id").agg(F.min("ord").alias("first"))
    kind = F.pmod(F.ascii(F.substring("file_id", -1, 1)), F.lit(3))
    score = F.when(kind == 0, F.lit(1.0)).when(kind == 1, F.when(F.col("ord") == F.col("first"), 1.0).otherwise(0.5)).otherwise((F.col("ord") % 7) / 6.0)
    asked = chunks.select("file_id").distinct().select("file_id", F.explode(F.array(*map(F.lit, budgets))).alias("token_budget")).withColumn("task_id", F.concat_ws("@", "file_id", "token_budget"))
    tasks = store(asked.select("task_id", "file_id", F.lit("").alias("task"), "token_budget", F.lit("corpus").alias("name")), "tasks")
    scored = chunks.join(first, "file_id").join(tasks.select("file_id", "task_id"), "file_id").select(
        "task_id", "file_id", "ord", F.round(score, 6).alias("score"), F.lit(None).cast("int").alias("turn"), F.lit(None).cast("array<int>").alias("matched_queries"), F.lit(None).cast("array<string>").alias("best"), F.lit(False).alias("multi"))
    return C.selections(scored, chunks, tasks)[1], chunks


def select_vague(spark, sf_dir):
    """Of the sections on top of the ranking two at most; one where all scores are alike."""
    return _folded(_vague(spark, sf_dir, (1_000_000,))[0])


def select_partial(spark, sf_dir):
    """The same under ceilings that the best section mostly exceeds: what of it fits, and another only if it fits as well."""
    done, chunks = _vague(spark, sf_dir, (60, 150, 400, 900))
    return _folded(done).join(_parts(done, chunks), "task_id", "left").withColumn("parts", F.coalesce("parts", F.lit("")))


def _parts(done: DataFrame, chunks: DataFrame) -> DataFrame:
    """(task_id, parts): tokens, tokens of the whole section where it is cut, and hash of each text that is selected."""
    part = F.concat_ws(":", "tokens", F.coalesce("full", F.lit(0)), F.md5("text"))
    return C.selected_texts(done, chunks).groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("p")))), lambda x: x["p"]), ",").alias("parts"))


def truncate_prefix(spark, sf_dir):
    """Documents cut to three sizes without a task."""
    return _cuts(read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array(F.lit(39), F.lit(60), F.lit(200), F.lit(700))).alias("most"), F.array().cast("array<string>").alias("terms")))


def truncate_around(spark, sf_dir):
    """Documents cut around the lines that hold terms: their own tenth word from the end and a word that many have."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    terms = F.filter(F.array(F.element_at(F.reverse(w), 10), F.lit("der")), lambda x: x.isNotNull())
    return _cuts(read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array(F.lit(60), F.lit(200))).alias("most"), F.when(F.size(w) >= 10, terms).otherwise(F.array(F.lit("der"))).alias("terms")))


def _cuts(rows: DataFrame) -> DataFrame:
    part = cut(F.col("text"), K.token_count(F.col("text")), F.col("most"), F.col("terms"))
    return rows.withColumn("x", part).select("doc_id", "most", F.col("x.tokens").alias("tokens"), F.md5("x.text").alias("text_md5"))


def assemble_files(spark, sf_dir):
    """The artifact of every file with all of its sections."""
    texts = C.assembled(document_chunks(spark, sf_dir).select(F.col("file_id").alias("key"), F.col("file_id").alias("name"), "ord", "breadcrumb", "text"))
    return texts.select("key", F.md5("markdown").alias("text_md5"), F.length("markdown").alias("n_chars"))


def manifest_lines(spark, sf_dir):
    """The manifest of what each task leaves out, with as many lines as fit in 1,200 tokens.

    Only sections that can have a line meet their texts; of all others of a file their number and the outermost ids are enough.
    """
    chunks = document_chunks(spark, sf_dir)
    aspects = store(benchmark_aspects(spark, sf_dir), "aspects")
    rows = ranking.normalized(store(ranking.bm25(chunks, aspects, zeros=False), "scores"))
    scores = ranking.merged(rows).withColumn("score", F.round("score", 6))
    first = store(ranking.first_ranked(scores, chunks, aspects, PICKED + hints.MANIFEST_STEPS[0]), "first")
    label = X.section_label(F.col("breadcrumb"), F.col("text"))
    known = store(chunks.join(ranking.checked_broadcast(first.select("file_id", "ord").distinct()), ["file_id", "ord"]).select("file_id", "ord", "id", "tokens", label.alias("label")), "labels")
    placed = first.join(known, ["file_id", "ord"])
    listed = F.array_sort(F.collect_list(F.when(F.col("pos") >= PICKED, F.struct("pos", "id", "label", "tokens"))))
    bare = F.transform(listed, lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"), x["tokens"].alias("tokens")))
    lines = placed.groupBy("task_id", "file_id").agg(bare.alias("omitted"), F.collect_list(F.when(F.col("pos") < PICKED, F.col("id"))).alias("picked")).filter(F.size("omitted") > 0)
    # Of the outermost PICKED + 1 ids at either end one is left out, whichever are picked.
    number = F.col("ord").try_cast("int").alias("number")
    numbers = chunks.select("file_id", "id", number).distinct().filter("number is not null")
    outer = lambda by: numbers.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy(by))).filter(F.col("r") <= PICKED + 1)
    ends = outer(F.asc("number")).unionByName(outer(F.desc("number"))).groupBy("file_id").agg(F.collect_list("id").alias("ends"))
    sizes = chunks.groupBy("file_id").agg(F.count("ord").alias("n"))
    out = lines.join(sizes, "file_id").join(ends, "file_id", "left")
    span = X.id_span(F.array_except(F.coalesce("ends", F.array().cast("array<string>")), F.col("picked")))
    return out.withColumn("m", hints.manifest_text(F.col("omitted"), F.lit(1200), F.col("n") - F.size("picked"), span)).select("task_id", F.col("m.most").alias("most"), F.md5("m.text").alias("text_md5"))


def _compiled(spark, sf_dir, budget=1200):
    docs = conversation_docs(spark, sf_dir)
    tasks = docs.select(F.concat(F.lit("t-"), "file_id").alias("task_id"), "file_id", F.concat(F.lit("What about "), F.substring(F.regexp_replace("markdown", r"[#\n]+", " "), 40, 60), F.lit("? And where is "), F.substring("markdown", 200, 40)).alias("task"), F.lit(budget).alias("token_budget"))
    return C.compile_context(docs, tasks), docs, tasks


def compile_tight(spark, sf_dir):
    """Whole conversations for two questions under a ceiling of 1,200 tokens, with all that compile gives."""
    return _compiled(spark, sf_dir)[0]


def _two_questions(spark, sf_dir):
    """Each conversation asked by the first and the last four long words of its last turn, with room for all of it."""
    last = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("text"), "turn")["text"].alias("text"))
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{5,}"), F.lit(0))
    four = lambda a: F.array_join(a, " ")
    ask = F.concat(F.lit("What about "), four(F.slice(w, 1, 4)), F.lit("? Where is "), four(F.reverse(F.slice(F.reverse(w), 1, 4))), F.lit("?"))
    return last.select(F.concat(F.lit("conv"), "conv_id").alias("task_id"), F.concat(F.lit("conv"), "conv_id").alias("file_id"), ask.alias("task"), F.lit(100_000).alias("token_budget"))


def compile_context(spark, sf_dir):
    out = C.compile_context(conversation_docs(spark, sf_dir), _two_questions(spark, sf_dir))
    rel = F.array_join(F.transform("selected_sections", lambda x: F.coalesce(x["relevance"].cast("string"), F.lit("-"))), ",").alias("relevance")
    return _selected(out, rel, "raw_tokens", "reduction_pct", "tokens_saved", F.col("next_section_hint.id").alias("hint"), F.col("compile_hints.named_omit").alias("named_omit"), F.col("compile_hints.early_stopped").alias("early_stopped"))


def expand_section(spark, sf_dir):
    """The second section of every conversation in 120 tokens, or what there is instead of one that is missing."""
    docs = conversation_docs(spark, sf_dir)
    wanted = docs.select("file_id", F.explode(F.array(F.lit("s1"), F.lit("s99999"))).alias("section_id"), F.lit(120).alias("token_budget"), F.lit(None).cast("string").alias("task"))
    out = C.expand_sections(store(chunk_markdown(docs), "chunks"), wanted)
    listed = F.array_join(F.transform("outline", lambda x: F.concat_ws("|", x["id"], x["section"], x["tokens"])), ",")
    return out.select("file_id", "section_id", F.md5("markdown").alias("text_md5"), "tokens_used", "truncated", "full_tokens", "query_miss", "error", F.md5(listed).alias("outline_md5"))


def expand_query(spark, sf_dir):
    """Sections in 120 tokens around a task."""
    docs = conversation_docs(spark, sf_dir)
    wanted = docs.select("file_id", F.when(F.length("file_id") % 2 == 0, "s1").otherwise("s99").alias("section_id"), F.lit(120).alias("token_budget"), F.substring("markdown", 60, 40).alias("task"))
    return C.expand_sections(chunk_markdown(docs), wanted)


def _one_line(chunks: DataFrame) -> DataFrame:
    """Sections with their text on one line."""
    return chunks.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ")).withColumn("tokens", K.token_count(F.col("text")))


def expand_miss(spark, sf_dir):
    """Documents as sections of one line in 60 tokens, asked for by their tenth word from the end and their first: whether what is left has missed the question."""
    chunks = _one_line(document_chunks(spark, sf_dir))
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    task = F.when(F.size(w) >= 10, F.concat_ws(" ", F.get(F.reverse(w), F.lit(9)), F.when(F.col("ord") % 2 == 0, F.get(w, F.lit(0)))))
    out = C.expand_sections(chunks, chunks.select("file_id", F.col("id").alias("section_id"), F.lit(60).alias("token_budget"), task.alias("task")))
    return out.select("section_id", F.md5("markdown").alias("text_md5"), "truncated", "full_tokens", "query_miss")


def prove_context(spark, sf_dir):
    """The selections of compile_context with the second section of the file on top."""
    docs, tasks = conversation_docs(spark, sf_dir), _two_questions(spark, sf_dir)
    chunks = store(chunk_markdown(docs), "chunks")
    out = C.prove_context(C.compile_context(docs, tasks, chunks), chunks, tasks.select("task_id", F.lit("s1").alias("section_id")))
    return out.select("task_id", F.md5("markdown").alias("text_md5"), F.array_join("expanded_applied", ",").alias("expanded"), "expand_content_tokens")


def parity_contexts(spark, sf_dir):
    """Whole conversations up to 300 tokens beside what compile and prove make of them."""
    docs, tasks = conversation_docs(spark, sf_dir), _two_questions(spark, sf_dir)
    chunks = store(chunk_markdown(docs), "chunks")
    proved = C.prove_context(C.compile_context(docs, tasks, chunks), chunks, tasks.select("task_id", F.lit("s1").alias("section_id"))).join(tasks.select("task_id", "file_id"), "task_id")
    out = C.parity_contexts(proved, docs, cap=300)
    return out.select("task_id", F.md5("full").alias("full_md5"), F.md5("context").alias("context_md5"), "full_tokens", "context_tokens", "reduction_pct")


def responses(spark, sf_dir):
    return C.responses(C.compile_context(conversation_docs(spark, sf_dir), _two_questions(spark, sf_dir)))


def measure(spark, sf_dir):
    return C.measure(conversation_docs(spark, sf_dir))


def recall_at_budget(spark, sf_dir):
    """Each conversation's last turn asked by how its first line begins: whether the packed text holds the line's end under each budget, and if not, whether a section that was left out gives it back."""
    docs = conversation_docs(spark, sf_dir)
    chunks = store(chunk_markdown(docs), "chunks")
    last = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("text"), "turn")["text"].alias("text"))
    line = F.regexp_extract("text", r"\S[^\r\n]*", 0)
    cases = last.select(F.concat(F.lit("conv"), "conv_id").alias("file_id"), F.concat(F.lit("What about "), F.substring(line, 1, 60), F.lit("?")).alias("task"), F.regexp_extract(line, r"\S.{0,39}$", 0).alias("needle")).filter("needle <> ''")
    budgets = spark.createDataFrame([(b,) for b in (40, 250, 1000)], "token_budget int")
    tasks = cases.crossJoin(F.broadcast(budgets)).withColumn("task_id", F.concat_ws("-", "file_id", "token_budget"))
    holders = cases.join(chunks, "file_id").filter(F.contains("text", "needle")).groupBy("file_id").agg(F.collect_set("id").alias("holders"))
    packed = C.compile_context(docs, tasks.drop("needle"), chunks).select("task_id", "markdown", "tokens_used", "selected_sections", "omitted_sections")
    done = tasks.select("task_id", "file_id", "token_budget", "needle").join(packed, "task_id").join(holders, "file_id", "left")
    done = done.withColumn("found", F.contains("markdown", "needle")).withColumn("expand_ok", F.when(~F.col("found"), F.coalesce(F.arrays_overlap(hints.ids(F.col("omitted_sections")), "holders"), F.lit(False))))
    return done.select("task_id", "token_budget", "found", "expand_ok", (F.col("found") | F.col("expand_ok")).alias("ok"), "tokens_used", F.size("selected_sections").alias("selected"))


def pack_matrix(spark, sf_dir):
    """Conversations by a pointed and a vague question by budgets: what is packed, whole-document flags, and whether a larger budget keeps to the selection at 1000."""
    docs = conversation_docs(spark, sf_dir)
    pointed = F.concat(F.lit("What about "), F.substring(F.regexp_replace("markdown", r"[#\n]+", " "), 40, 60), F.lit("?"))
    asked = docs.select("file_id", F.explode(F.array(F.struct(F.lit("pointed").alias("kind"), pointed.alias("task")), F.struct(F.lit("vague").alias("kind"), F.lit("What is this conversation about?").alias("task")))).alias("q"))
    budgets = spark.createDataFrame([(b,) for b in (400, 1000, 4000, 8000)], "token_budget int")
    tasks = asked.select("file_id", "q.kind", "q.task").crossJoin(F.broadcast(budgets)).withColumn("task_id", F.concat_ws("-", "file_id", "kind", "token_budget"))
    out = C.compile_context(docs, tasks.drop("kind")).select("task_id", "raw_tokens", "tokens_used", "reduction_pct", F.size("selected_sections").alias("selected"), F.size("omitted_sections").alias("omitted"),
                                                             F.array_join(hints.ids(F.col("selected_sections")), ",").alias("ids"), F.col("compile_hints.early_stopped").alias("early_stopped"))
    cells = tasks.select("task_id", "file_id", "kind", "token_budget").join(out, "task_id").withColumn("whole_doc", (F.col("selected") + F.col("omitted") > 0) & (F.col("omitted") == 0))
    w = Window.partitionBy("file_id", "kind")
    base = F.max(F.when(F.col("token_budget") == 1000, F.struct("ids", "selected"))).over(w)
    kept = (F.col("token_budget") <= 1000) | (F.col("ids") == F.col("base.ids")) | (F.col("selected") <= F.col("base.selected") + 2)
    flagged = cells.withColumn("base", base).withColumn("stable_ids", F.min(kept).over(w)).withColumn("short_circuit", (F.col("raw_tokens") <= F.col("token_budget")) & (F.col("reduction_pct") == 0) & F.col("whole_doc"))
    return flagged.select("file_id", "kind", "token_budget", "raw_tokens", "tokens_used", "selected", (F.col("selected") + F.col("omitted")).alias("total_sections"), "ids", "whole_doc", "early_stopped", "short_circuit", "stable_ids")


# --- cache and state -------------------------------------------------------------------------------------------------


def cache_lookup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("file_id"), F.col("text").alias("markdown"))
    return cache_valid(cache_rows(docs)).select("key", K.token_count(F.col("markdown")).alias("tokens"))


def cache_damage(spark, sf_dir):
    """Two entries a text, the newer one of every tenth document damaged; what is older than twenty days goes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.col("text").alias("markdown"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    old = docs.select("key", "markdown", F.sha2("markdown", 256).alias("md_sha"), (now - F.make_dt_interval(days=(F.col("doc_id") % 40).cast("int"), hours=F.lit(1))).alias("stored_at"))
    new = docs.select("key", F.concat("markdown", F.when(F.col("doc_id") % 10 == 0, "!").otherwise("")).alias("markdown"), F.sha2("markdown", 256).alias("md_sha"), (now - F.make_dt_interval(days=(F.col("doc_id") % 40).cast("int"))).alias("stored_at"))
    kept = cache_valid(cache_swept(old.unionByName(new), now, days=20))
    return kept.select("key", F.md5("markdown").alias("text_md5"), F.date_format("stored_at", "yyyy-MM-dd HH").alias("stored"))


def upload_guard(spark, sf_dir):
    """Documents as uploads under ten endings, with signatures, zero bytes and nothing in some of them."""
    ends = F.array(*map(F.lit, (".md", ".txt", ".PDF", ".docx", ".exe", "", ".csv", ".html", ".pdf", ".xlsx")))
    k = F.col("doc_id") % 10
    text = F.coalesce("text", F.lit(""))
    content = F.when(k == 8, F.concat(F.lit("%PDF-"), text)).when(k == 1, F.concat(F.substring(text, 1, 100), F.lit("\x00"), text)).when(k == 6, "").when(k == 9, F.concat(F.lit("PK"), text)).otherwise(text)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.get(ends, k.cast("int"))).alias("name"), content.cast("binary").alias("content"))
    return rows.select("doc_id", guard(F.col("name"), F.col("content")).alias("g")).select("doc_id", "g.ok", "g.status")


def dedupe_by_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def _requests(spark, sf_dir):
    route = F.when(F.col("event_type") == "purchase", "/api/agent").when(F.col("event_type") == "click", "/api/answer").otherwise("/api/compile")
    return read(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), route.alias("route"))


def rate_limit(spark, sf_dir):
    return S.rate_limit(_requests(spark, sf_dir), points=20, window=3600).select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "route", "cost", "allowed", "used")


def one_shot(spark, sf_dir):
    """Purchases store a handle, clicks use it; a handle lives for two days."""
    kind = F.when(F.col("event_type") == "purchase", "store").when(F.col("event_type") == "click", "use")
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("handle"), kind.alias("kind"), (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=(F.col("event_id") % 60).cast("decimal(18,6)"))).alias("ts")).filter("kind is not null")
    once = rows.groupBy("handle", "ts").agg(F.min("kind").alias("kind"))
    out = S.one_shot(once, most=1_000_000, seconds=2 * 86400)
    return out.groupBy("handle", "outcome").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


def _handles(spark, sf_dir):
    """Events as stores (purchases) and uses (clicks) of handles."""
    kind = F.when(F.col("event_type") == "purchase", "store").when(F.col("event_type") == "click", "use")
    return read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100).alias("handle"), (F.col("user_id") % 7).alias("pool"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts")).filter("kind is not null")


def one_shot_bounded(spark, sf_dir):
    """Seven pools that hold ten handles each: newer ones push older ones out."""
    rows = _handles(spark, sf_dir).select("pool", "handle", (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 60).cast("decimal(18,6)"))).alias("ts"), "kind")
    once = rows.groupBy("pool", "handle", "ts").agg(F.min("kind").alias("kind"))
    out = S.one_shot(once, most=10, seconds=2 * 86400, pool="pool")
    return out.groupBy("pool", "handle", "outcome").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


def handle_look_ups(spark, sf_dir):
    """Each click looks its handle up: whether the last purchase was stored within six hours, how old it is, and which it was."""
    rows = _handles(spark, sf_dir).drop("pool").withColumn("value", F.col("event_id"))
    return S.look_ups(rows, 6 * 3600).select("event_id", "handle", "found", F.round("age", 3).alias("age"), "value")


WORKSPACE_TYPES = ("WORKSPACE_HYDRATED", "DOCUMENT_SELECTED", "DOCUMENT_RESTORED", "TASK_CHANGED", "BUDGET_CHANGED", "PRESETS_CHANGED", "DOC_SIZE_NOTE_CHANGED", "COMPILE_SUCCEEDED", "COMPILE_CLEARED", "COMPILE_FAILED",
                   "PROVE_INCLUDE_CHANGED", "PROVE_INCLUDE_CHANGED", "PROVE_INCLUDE_CHANGED", "PROVE_INCLUDE_CLEARED", "RUN_INTENT_CREATED", "RUN_INTENT_CLAIMED", "COMPILE_SUCCEEDED", "TASK_CHANGED", "PROVE_INCLUDE_CHANGED")


def workspace_events(spark, sf_dir):
    """The events table read as events of workspaces."""
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 200).cast("string").alias("session"), i.alias("at"), F.get(F.array(*map(F.lit, WORKSPACE_TYPES)), (i % 19).cast("int")).alias("type"), F.concat("event_type", i % 3).alias("task"), (i % 7 * 100).cast("int").alias("budget"),
        F.when(i % 2 == 0, F.concat(F.lit("f"), i % 4)).alias("file"), F.when(i % 5 == 0, F.concat(F.lit("k"), i % 3)).alias("sample_key"), F.get(F.array(F.lit("quick"), F.lit("standard"), F.lit("deep")), (i % 4).cast("int")).alias("tier"),
        F.struct(F.lit(200).alias("quick"), F.lit(400).alias("standard"), (i % 10 + 800).cast("int").alias("deep")).alias("presets"), F.concat(F.lit("s"), i % 4).alias("id"), F.when(F.floor(i / 4) % 2 == 0, "agent").otherwise("prove").alias("kind"),
        (i % 3 != 0).alias("included"), (i % 100).cast("int").alias("tokens"), (F.floor("value") - 20).cast("long").alias("tokens_saved"), F.round(F.floor("value") / 1000 - 0.02, 4).alias("usd_saved"), F.concat(F.lit("n"), i % 11).alias("note"))


def workspace_states(spark, sf_dir):
    out = W.workspace_states(workspace_events(spark, sf_dir))
    return out.withColumn("expanded", F.array_join("expanded", ",")).withColumn("saved_usd", F.round("saved_usd", 4))


def workspace_status(spark, sf_dir):
    s = W.workspace_states(workspace_events(spark, sf_dir))
    live = F.col("compiled_task").isNotNull()
    status = W.workspace_status(F.col("compiled_task"), F.col("task"), F.col("compiled_budget"), F.col("budget"), live, F.col("file").isNotNull(), F.length("task") % 2 == 0, F.col("revision") % 5 == 0)
    return s.select("session", status.alias("x")).select("session", "x.*")


def request_costs(spark, sf_dir):
    return _requests(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"), F.sum(S.request_cost(F.col("route"))).cast("long").alias("points"))


def counters(spark, sf_dir):
    return S.counters(read(spark, sf_dir, "events").select(F.col("event_type").alias("name")))


def session_totals(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("at"), F.floor("value").cast("long").alias("tokens_saved"))
    return S.session_totals(runs, order="at").select("event_id", "session", "saved_so_far", F.round("usd_so_far", 6).alias("usd_so_far"))


def live_handles(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("handle"), F.col("event_type").alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    return S.live_handles(rows, F.lit("2024-01-30 00:00:00").cast("timestamp"), 3600 * 24).select("handle", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def event_windows(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    bm25_single, token_count, content_tokens, clamp_budget, token_savings, tokenize_freq, light_stem, cjk_ngrams, arabic_terms, budget_presets, packaging_note, settings, query_terms, split_aspects, split_commas, name_intent, names_and_ids, section_labels, chunk_conversations, chunk_oversize, full_markdown, sample_catalog, section_outline, block_split,
    html_markdown, bm25_heading_boost, per_query_norm, multi_score, relevance_pct, topk_sections, indexed_topk, best_id, attribution, round_robin, score_shape, relevance_floor, top_cluster, discriminative_terms,
    next_hint, bound_hint, omit_buckets, compile_hints, omitted_sections, select_sections, select_forced, select_tight, select_vague, select_partial, truncate_prefix, truncate_around, assemble_files, manifest_lines,
    compile_context, compile_tight, expand_section, expand_query, expand_miss, prove_context, parity_contexts, responses, measure, recall_at_budget, pack_matrix, cache_lookup, cache_damage, upload_guard, dedupe_by_hash, rate_limit, one_shot, one_shot_bounded, handle_look_ups, workspace_states, workspace_status,
    request_costs, counters, session_totals, live_handles, event_windows,
)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best sections for each benchmark task, with their relevance."""
    scores = _scores(spark, sf_dir)
    top = scores.groupBy("task_id").agg(K.max_of(F.col("score")).alias("top"))
    return ranking.ranked(scores).filter("pos < 10").join(top, "task_id").select("task_id", "file_id", "pos", "ord", ranking.relevance(F.col("score"), F.col("top")).alias("relevance"))
