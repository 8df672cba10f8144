"""BM25 by file as joins and aggregates, and what is derived from its scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import tokenize
from loomspark.functions.tokens import half_up, max_of
from loomspark.sources.shared import checked_broadcast, fits_broadcast, store

#: Fixed values of the ranking.
K1, B = 1.5, 0.75
HEADING_BOOST, NEAR_TOP, RELEVANCE_FLOOR, NAME_BOOST = 0.35, 0.85, 0.4, 0.6
CLUSTER_RATIO, FLAT_RATIO = 0.98, 0.95


def query_rows(tasks: DataFrame) -> DataFrame:
    """(task_id, file_id, qi, term, qtf) of tasks with terms: a term counts as often as it is asked."""
    return tasks.select("task_id", "file_id", "qi", F.explode("terms").alias("term")).groupBy("task_id", "file_id", "qi", "term").agg(F.count("*").alias("qtf"))


def term_frequencies(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(file_id, ord, term, f): how often a section has the terms that tasks on its file ask; all its other tokens under null.

    Texts are tokenized once.  Where the asked terms are few, tokens meet them before anything is moved, so what is moved is
    what is asked for and a row a section; where they are not, tokens are counted by section before they are joined.
    """
    wanted = asked.select("file_id", F.col("term").alias("wanted")).distinct()
    tokens = chunks.select("file_id", "ord", F.explode_outer(tokenize(F.col("text"))).alias("token"))
    if fits_broadcast(wanted):
        counted, wanted = tokens.withColumn("k", F.col("token").isNotNull().cast("long")), F.broadcast(wanted)
    else:
        counted = tokens.groupBy("file_id", "ord", "token").agg(F.count("token").alias("k"))
    on = (counted["file_id"] == wanted["file_id"]) & (counted["token"] == wanted["wanted"])
    return counted.join(wanted, on, "left").groupBy(counted["file_id"], "ord", F.col("wanted").alias("term")).agg(F.sum("k").alias("f"))


def bm25(chunks: DataFrame, tasks: DataFrame, boost: bool = True, zeros: bool = True) -> DataFrame:
    """(task_id, file_id, qi, ord, s) for the sections of the task's file; with zeros also for those that score nothing.

    tasks: (task_id, file_id, qi, terms).  A section whose breadcrumb has a term gets a share of the best score on top.
    """
    asked = query_rows(tasks)
    found = store(term_frequencies(chunks, asked), "terms")
    sizes = found.groupBy("file_id", "ord").agg(F.sum("f").alias("size"))
    mean = F.avg("size")
    stats = sizes.groupBy("file_id").agg(F.count("*").alias("n"), F.when(mean == 0, 1.0).otherwise(mean).alias("mean"))
    tf = found.filter("term is not null")
    df = tf.groupBy("file_id", "term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    terms = asked.join(df, ["file_id", "term"]).join(stats, "file_id").select("task_id", "file_id", "qi", "term", "mean", (F.col("qtf") * idf).alias("idf"))
    weigh = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    keys = ["task_id", "file_id", "qi", "ord"]
    scores = tf.join(sizes, ["file_id", "ord"]).join(checked_broadcast(terms), ["file_id", "term"]).groupBy(*keys).agg(F.sum(weigh).alias("s"))
    if boost:
        top = scores.groupBy("task_id", "qi").agg(max_of(F.col("s")).alias("top")).filter("top > 0")
        # Sections share breadcrumbs, so these are tokenized once each.
        crumbs = chunks.select("file_id", "breadcrumb").distinct().select("file_id", "breadcrumb", F.explode(F.array_distinct(tokenize(F.col("breadcrumb")))).alias("term"))
        headed = crumbs.join(asked, ["file_id", "term"]).select("task_id", "file_id", "qi", "breadcrumb").distinct().join(top, ["task_id", "qi"])
        more = chunks.select("file_id", "ord", "breadcrumb").join(headed, ["file_id", "breadcrumb"]).select(*keys, (F.col("top") * HEADING_BOOST).alias("s"))
        scores = scores.unionByName(more).groupBy(*keys).agg(F.sum("s").alias("s"))
    if zeros:
        every = tasks.select("task_id", "file_id", "qi").join(sizes.select("file_id", "ord"), "file_id")
        scores = every.join(scores, keys, "left").select(*keys, F.coalesce("s", F.lit(0.0)).alias("s"))
    return scores


def normalized(scores: DataFrame) -> DataFrame:
    """Each aspect's scores by its own best; all 0 where nothing matches."""
    top = scores.groupBy("task_id", "qi").agg(max_of(F.col("s")).alias("top"))
    return scores.join(top, ["task_id", "qi"]).withColumn("s", F.when(F.col("top") > 0, F.col("s") / F.col("top")).otherwise(0.0)).drop("top")


def merged(rows: DataFrame) -> DataFrame:
    """(task_id, file_id, ord, score): the best over aspects."""
    return rows.groupBy("task_id", "file_id", "ord").agg(max_of(F.col("s")).alias("score"))


def relevance(score: Column, top: Column) -> Column:
    """Percent of the best score; null where there is none."""
    return F.when(top > 0, half_up(score * 100 / top).cast("int"))


def ranked(scores: DataFrame, score: str = "score", by: str = "task_id") -> DataFrame:
    """scores with pos from 0: best first, then in the order of the file."""
    return scores.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "ord")) - 1)


def first_ranked(scores: DataFrame, sections: DataFrame, tasks: DataFrame, k: int) -> DataFrame:
    """(task_id, file_id, ord, pos): the first k of what ranked gives for all sections of a task's file, with rows for those alone that score.

    scores: (task_id, file_id, ord, score), other sections score 0; sections: (file_id, ord); tasks: (task_id, file_id).  A task with
    fewer than k scores goes on in the order of its file, and finds enough among the first 2k sections there.
    """
    order = Window.partitionBy("task_id").orderBy(F.desc("score"), "ord")
    best = scores.filter("score > 0").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    best = store(best.select("task_id", "file_id", "ord", (F.col("r") - 1).alias("pos")), "best")
    heads = sections.select("file_id", "ord").distinct().withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy("ord"))).filter(F.col("r") <= 2 * k).drop("r")
    few = tasks.select("task_id", "file_id").distinct().join(best.groupBy("task_id").agg(F.count("*").alias("n")), "task_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < k)
    rest = few.join(heads, "file_id").join(best, ["task_id", "ord"], "left_anti")
    pos = F.row_number().over(Window.partitionBy("task_id").orderBy("ord")) - 1 + F.col("n")
    return best.unionByName(rest.select("task_id", "file_id", "ord", pos.cast("int").alias("pos")).filter(F.col("pos") < k))


def best_ids(rows: DataFrame, chunks: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, qi, ord): each aspect's best section.

    Among the sections near the aspect's best score the one that has most of the terms only this aspect asks; by score and
    then by order among equals.  Without such terms, or where nothing scores, the first of the best scores.
    """
    asked = tasks.select("task_id", "qi", F.explode("terms").alias("term")).distinct()
    own = asked.groupBy("task_id", "term").agg(F.count("*").alias("k"), F.min("qi").alias("qi")).filter("k = 1").groupBy("task_id", "qi").agg(F.collect_list("term").alias("own"))
    top = rows.groupBy("task_id", "qi").agg(max_of(F.col("s")).alias("top"))
    near = rows.join(top, ["task_id", "qi"]).filter((F.col("top") <= 0) | (F.col("s") >= NEAR_TOP * F.col("top"))).join(own, ["task_id", "qi"], "left")
    texts = chunks.select("file_id", "ord", F.lower("text").alias("lower"))
    hits = F.when((F.col("top") > 0) & F.col("own").isNotNull(), F.size(F.filter("own", lambda t: F.contains(F.col("lower"), t)))).otherwise(0)
    counted = near.join(texts, ["file_id", "ord"]).withColumn("hits", hits)
    return counted.groupBy("task_id", "qi").agg(F.min(F.struct(-F.col("hits"), -F.col("s"), F.col("ord"))).alias("m")).select("task_id", "qi", F.col("m.ord").alias("ord"))


def attribution(rows: DataFrame, floor: float = RELEVANCE_FLOOR) -> DataFrame:
    """(task_id, file_id, ord, matched_queries): the aspects whose best a section is near to, best first."""
    top = rows.groupBy("task_id", "qi").agg(max_of(F.col("s")).alias("top"))
    near = rows.join(top, ["task_id", "qi"]).filter(F.col("s") >= F.when(F.col("top") > 0, F.greatest(F.lit(floor), NEAR_TOP * F.col("top"))).otherwise(F.lit(floor)))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "qi")))
    return near.groupBy("task_id", "file_id", "ord").agg(F.transform(listed, lambda x: x["qi"]).alias("matched_queries"))


def round_robin(rows: DataFrame, best: DataFrame) -> DataFrame:
    """(task_id, file_id, ord, pos): every aspect's first, then every aspect's second and so on; a section counts once, at its first place.

    An aspect's own best section leads its list.
    """
    led = rows.join(best.select("task_id", "qi", F.col("ord").alias("lead")), ["task_id", "qi"], "left")
    by = Window.partitionBy("task_id", "qi").orderBy(F.when(F.col("ord") == F.col("lead"), 0).otherwise(1), F.desc("s"), "ord")
    first = led.withColumn("r", F.row_number().over(by)).groupBy("task_id", "file_id", "ord").agg(F.min(F.struct("r", "qi")).alias("at"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("task_id").orderBy("at.r", "at.qi")) - 1).drop("at")


def merged_turns(rows: DataFrame, best: DataFrame) -> DataFrame:
    """(task_id, file_id, ord, score, turn, matched_queries): merged, round_robin and attribution of the same rows, which are sorted once
    by aspect and met once by section."""
    led = rows.join(checked_broadcast(best.select("task_id", "qi", F.col("ord").alias("lead"))), ["task_id", "qi"], "left")
    aspect = Window.partitionBy("task_id", "qi")
    by = aspect.orderBy(F.when(F.col("ord") == F.col("lead"), 0).otherwise(1), F.desc("s"), "ord")
    placed = led.withColumns({"r": F.row_number().over(by), "top": F.coalesce(F.greatest(F.max("s").over(aspect), F.lit(0)), F.lit(0))})
    near = F.col("s") >= F.when(F.col("top") > 0, F.greatest(F.lit(RELEVANCE_FLOOR), NEAR_TOP * F.col("top"))).otherwise(F.lit(RELEVANCE_FLOOR))
    matched = F.collect_list(F.when(near, F.struct((-F.col("s")).alias("s"), "qi")))
    met = placed.groupBy("task_id", "file_id", "ord").agg(max_of(F.col("s")).alias("score"), F.min(F.struct("r", "qi")).alias("at"), matched.alias("m"))
    turn = F.row_number().over(Window.partitionBy("task_id").orderBy("at.r", "at.qi")) - 1
    return met.select("task_id", "file_id", "ord", "score", turn.alias("turn"), F.when(F.size("m") > 0, F.transform(F.array_sort("m"), lambda x: x["qi"])).alias("matched_queries"))


def score_shape(scores: DataFrame) -> DataFrame:
    """(task_id, top, flat): the best score, and whether all positive ones are close to it."""
    top = max_of(F.col("score"))
    least = F.min(F.when(F.col("score") > 0, F.col("score")))
    return scores.groupBy("task_id").agg(top.alias("top"), F.coalesce(least, F.lit(0.0)).alias("least")).select("task_id", "top", ((F.col("top") <= 0) | (F.col("least") >= FLAT_RATIO * F.col("top"))).alias("flat"))


def passes_floor(score: Column, top: Column, floor: float = RELEVANCE_FLOOR) -> Column:
    return (top <= 0) | F.lit(floor <= 0) | (score >= top * floor)


def top_cluster(scores: DataFrame, ratio: float = CLUSTER_RATIO) -> DataFrame:
    """The sections close to the best score; the first one alone where scores are flat, none without a score."""
    shaped = ranked(scores).join(score_shape(scores), "task_id").filter("top > 0")
    return shaped.filter(F.when(F.col("flat"), F.col("pos") == 0).otherwise(F.col("score") >= F.col("top") * ratio))
