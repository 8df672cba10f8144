"""An inverted index of sections: texts are tokenized once for all questions, and a top list reads the blocks that can hold it.

Postings are kept in blocks of neighbouring sections, the same for all terms of a file, as small whole numbers: place in the
block, frequency and length.  From these follows the most that one of a block's sections can get of a term.  Summed over a
question's terms this bounds every score in the block from above, and the largest of them is reached by some section, so the
k-th best of those bounds the k-th best score from below.  Only blocks above that are scored, exactly.  Sections without a term of
the question appear nowhere.

Texts are moved once, to the task that makes their block; what is counted there is moved no more.  Questions take the blocks of
their own terms from the index, and only these are joined further.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import tokenize
from loomspark.operators.ranking import B, K1, query_rows
from loomspark.sources.shared import checked_broadcast, store

#: Section numbers that a block spans.
SPAN = 512
#: Scores are sums in any order; what is this close counts as equal.
CLOSE = 1e-6


@dataclass(frozen=True)
class Index:
    """files (file_id, n, mean): sections and their mean length; blocks (file_id, term, block, bound, postings: array of (ord,
    share))."""

    files: DataFrame
    blocks: DataFrame


def build_index(chunks: DataFrame, span: int = SPAN) -> Index:
    """The index of chunks (file_id, ord, text), as stored tables.  Null texts have no tokens but count as sections."""
    block = F.floor(F.col("ord") / span)
    dealt = chunks.select("file_id", "ord", block.alias("block"), "text").repartition("file_id", "block")
    read = dealt.select("file_id", "block", "ord", tokenize(F.col("text")).alias("t")).select("file_id", "block", "ord", F.size("t").alias("size"), F.explode("t").alias("term"))
    counted = read.groupBy("file_id", "block", "ord", "size", "term").agg(F.count("*").cast("int").alias("f"))
    posting = F.struct((F.col("ord") - F.col("block") * span).cast("int").alias("at"), "f", "size")
    kept = store(counted.groupBy("file_id", "block", "term").agg(F.array_sort(F.collect_list(posting)).alias("p")), "index-blocks")
    tokens = kept.groupBy("file_id").agg(F.sum(F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["f"])).alias("tokens"))
    mean = F.coalesce("tokens", F.lit(0)) / F.col("n")
    files = store(chunks.groupBy("file_id").agg(F.count("*").alias("n")).join(tokens, "file_id", "left").select("file_id", "n", F.when(mean == 0, 1.0).otherwise(mean).alias("mean")), "index-files")
    # What a section gets of a term, but for the term's weight.
    share = lambda p: p["f"] * (K1 + 1) / (p["f"] + K1 * (1 - B + B * p["size"] / F.col("mean")))
    ord_ = lambda p: (F.col("block") * span + p["at"]).cast(chunks.schema["ord"].dataType)
    postings = F.transform("p", lambda p: F.struct(ord_(p).alias("ord"), share(p).alias("share")))
    blocks = kept.join(checked_broadcast(files.select("file_id", "mean")), "file_id")
    return Index(files, blocks.select("file_id", "term", "block", F.array_max(F.transform("p", share)).alias("bound"), postings.alias("postings")))


def weights(index: Index, tasks: DataFrame) -> DataFrame:
    """(task_id, file_id, qi, term, w): what a question's terms weigh in its file."""
    asked = query_rows(tasks)
    terms = _asked(index, asked).groupBy("file_id", "term").agg(F.sum(F.size("postings")).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return asked.join(terms, ["file_id", "term"]).join(index.files, "file_id").select("task_id", "file_id", "qi", "term", (F.col("qtf") * idf).alias("w"))


def _asked(index: Index, asked: DataFrame) -> DataFrame:
    """The blocks of the terms that are asked for."""
    return index.blocks.join(checked_broadcast(asked.select("file_id", "term").distinct()), ["file_id", "term"], "left_semi")


def top_blocks(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(task_id, file_id, qi, block): the blocks that can hold one of a question's k best sections."""
    most = F.col("w") * F.col("bound")
    keys = ["task_id", "file_id", "qi"]
    bounds = asked.join(index.blocks.select("file_id", "term", "block", "bound"), ["file_id", "term"]).groupBy(*keys, "block").agg(F.sum(most).alias("above"), F.max(most).alias("reached"))
    bounds = store(bounds, "bounds")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("reached")))
    least = bounds.withColumn("k", rank).filter(F.col("k") == k).select(*keys, F.col("reached").alias("least"))
    return bounds.join(least, keys, "left").filter(F.col("least").isNull() | (F.col("above") >= F.col("least") - 10 * CLOSE)).select(*keys, "block")


def top_sections(index: Index, tasks: DataFrame, k: int = 10) -> DataFrame:
    """(task_id, file_id, qi, pos, ord, s): the k best sections of each aspect that score at all, in order; equal scores in the
    order of the file.  tasks: (task_id, file_id, qi, terms).  No text is read."""
    index = Index(index.files, store(_asked(index, query_rows(tasks)), "asked-blocks"))
    asked = store(weights(index, tasks), "weights")
    kept = top_blocks(index, asked, k).join(asked, ["task_id", "file_id", "qi"])
    read = kept.join(index.blocks.drop("bound"), ["file_id", "term", "block"]).select("task_id", "file_id", "qi", "w", F.explode("postings").alias("p"))
    scores = read.groupBy("task_id", "file_id", "qi", "p.ord").agg(F.sum(F.col("w") * F.col("p.share")).alias("s"))
    order = Window.partitionBy("task_id", "qi").orderBy(F.desc(F.round("s", 6)), "ord")
    return scores.withColumn("pos", F.row_number().over(order) - 1).filter(F.col("pos") < k).select("task_id", "file_id", "qi", "pos", "ord", "s")
