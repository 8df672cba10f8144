"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, weighted-shingle verification.

All of it is DataFrame expressions.

1. A window that passes the verification shares more than a quarter of its item's weight in any choice of shingles that
   heavy; so the item's rarest shingles up to that weight are looked for in all texts, and only what lies around these anchors
   is read again.  A passage that many documents and items share is rare in none of these lists.
2. Around an anchor, each shingle of the item that is found says where its window would start.  These starts and all between
   neighbouring ones are fingerprinted.
3. Fingerprints are cut into blocks.  Two of them within the radius differ in one block at least by no more than
   radius / blocks bits, so all near values of the items' blocks are listed and a join on blocks misses none.  The search
   asks all items as long as the window, not only those whose anchor it stands at.
4. A similar window may still differ in more bits than the radius: weights decide bits, and these can be nearly even.  So the
   windows around an item's anchors whose fingerprints are farther from the item's are candidates of it too.
5. All candidates are verified by the exact weighted similarity, and of each pair the best window is kept.

An item of fewer than five words is one shingle of its own length and is looked for as such in texts of any length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import checked_broadcast, drop_stored, free_name, let, store, words


#: Sums of weights are known so far; what reaches the similarity up to that has reached it.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Parameters:
    words: int = 5
    similarity: float = 0.75
    bits: int = 64
    #: Fingerprints that differ in more bits are not found by the search.
    radius: int = 15
    #: Blocks of a fingerprint; bits must be a multiple of it.
    blocks: int = 8
    #: Longer words weigh more in a fingerprint, up to this many letters.
    most_letters: int = 8
    #: Bytes that are broadcast at most; more is joined by a shuffle.
    most_broadcast: int = 64_000_000


def shingle_hashes(w: Column, k: int) -> Column:
    """Hashes of the k-word shingles in order; of all words as one where there are fewer; none without words."""
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(k))))


def grams(w: Column, k: int) -> Column:
    """Hashes of the runs of exactly k words, none where there are fewer."""
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(k))))


def fingerprint(w: Column, p: Parameters = Parameters()) -> Column:
    """SimHash of words: bit b is set where the words whose hash has bit b weigh more than the others."""
    weighed = F.transform(w, lambda x: F.struct(F.xxhash64(x).alias("h"), F.least(F.length(x), F.lit(p.most_letters)).alias("w")))

    def bits(hashes: Column) -> Column:
        def bit(b: Column) -> Column:
            total = F.aggregate(hashes, F.lit(0), lambda s, x: s + F.when(F.call_function("getbit", x["h"], b) == 1, x["w"]).otherwise(-x["w"]))
            return F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(p.bits - 1)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))

    return let(weighed, bits)


def block(fp: Column, i: int | Column, p: Parameters) -> Column:
    width = p.bits // p.blocks
    at = i * width if isinstance(i, int) else i * F.lit(width)
    return F.call_function("shiftrightunsigned", fp, F.lit(at) if isinstance(at, int) else at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def near_values(p: Parameters) -> list[int]:
    """What a block is changed by where it differs in at most radius / blocks bits."""
    width, most = p.bits // p.blocks, p.radius // p.blocks
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(width), k)]


def weights(items: DataFrame, n_items: int) -> DataFrame:
    """(item_id, h, weight): an item's distinct shingles; one weighs ln(1 + items / items that have it)."""
    placed = items.select("item_id", F.explode("hs").alias("h")).distinct()
    weight = placed.groupBy("h").agg(F.log(1 + F.lit(n_items) / F.count("*")).alias("weight"))
    return placed.join(weight, "h")


def anchors_of(weighed: DataFrame, p: Parameters) -> DataFrame:
    """(item_id, h): the heaviest shingles of each item, up to more than the weight that a hit may lack."""
    before = Window.partitionBy("item_id").orderBy(F.desc("weight"), "h")
    total = F.sum("weight").over(Window.partitionBy("item_id"))
    lighter = F.coalesce(F.sum("weight").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return weighed.select("item_id", "h", lighter.alias("lighter"), total.alias("total")).filter(F.col("lighter") <= F.col("total") * (1 - p.similarity) + 1e-9).select("item_id", "h")


def places(docs: DataFrame, anchors: DataFrame, short: list[int], k: int) -> DataFrame:
    """(doc_id, item_id, run): where anchors stand, in runs of as many words as the item has; of short items the first place."""
    hashes = let(words(F.lower("text")), lambda w: F.struct(*[grams(w, n).alias(f"h{n}") for n in {k, *short}]))
    read = docs.select("doc_id", hashes.alias("x"))
    at = read.select("doc_id", F.posexplode(f"x.h{k}").alias("pos", "h"))
    runs = at.join(anchors.filter(F.col("m") >= k), "h").select("doc_id", "item_id", F.floor(F.col("pos") / F.col("m")).cast("int").alias("run")).distinct()
    for n in short:
        found = read.select("doc_id", F.posexplode(f"x.h{n}").alias("pos", "h")).join(anchors.filter(F.col("m") == n), "h")
        runs = runs.unionByName(found.groupBy("doc_id", "item_id", "m").agg(F.min("pos").alias("pos")).select("doc_id", "item_id", F.floor(F.col("pos") / F.col("m")).cast("int").alias("run")))
    return runs


def window_starts(region: Column, first: Column, n: Column, m: Column, hs: Column, run: Column, p: Parameters) -> Column:
    """Starts of the windows that an item's shingles (hs) in a region point at, and all between neighbours of these that one
    window can span; of windows that hold no word of the run those of other runs take care.

    region: the words from place `first` on of a text of n words; m: words of the item.
    """
    k = F.when(m < p.words, m).otherwise(F.lit(p.words))
    last = F.greatest(n - m, F.lit(0))
    own = F.when(F.size(region) >= k, F.transform(F.sequence(F.lit(0), F.size(region) - k), lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice(region, i + 1, k)).alias("h")))).otherwise(
        F.array(F.struct(F.lit(0).alias("i"), F.xxhash64(region).alias("h")))
    )
    places_of = lambda x: F.filter(F.transform(hs, lambda y, j: F.when(y == x["h"], F.least(F.greatest(first + x["i"] - j, F.lit(0)), last))), lambda s: s.isNotNull())
    starts = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(own, lambda x: F.array_contains(hs, x["h"])), places_of))))

    def filled(s: Column) -> Column:
        upto = lambda x, i: F.when(F.get(s, i + 1) - x < m, F.sequence(x, F.get(s, i + 1))).otherwise(F.array(x))
        return F.array_distinct(F.flatten(F.transform(s, upto)))

    inside = lambda x: (x > (run - 1) * m) & (x < (run + 1) * m) | (x == last)
    return F.filter(let(starts, filled), inside)


def decontamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, item_id, start, similarity): the items that a document holds, each with its best window (first word and similarity).

    Words are lower-cased.  Shingles weigh ln(1 + items / items that have them), one that the item lacks as if one item had it;
    the similarity is the weight shared over the weight of both, and a window as long as the item (or the whole of a shorter
    text) is a hit from p.similarity on.  Windows start where a shingle of the item puts them or between two such places; of
    equal ones the first counts.  Items and texts that are null or without words are found nowhere, items without an id
    neither.  Repeated rows of a doc_id give one row an item, a null doc_id is one like others, empty tables give an empty
    table, a very long text is read to its end, and other columns don't matter.
    """
    spark, k = docs.sparkSession, p.words
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words(F.lower(item_text)).alias("iw")).filter(F.size("iw") > 0)
    items = store(items.select("item_id", "iw", F.size("iw").alias("m"), shingle_hashes(F.col("iw"), k).alias("hs")), "items")
    n_items = items.select("item_id").distinct().count()
    short = sorted(r.m for r in items.filter(F.col("m") < k).select("m").distinct().collect())
    weighed = store(weights(items, n_items), "weights")
    anchors = anchors_of(weighed, p).join(items.select("item_id", "m").distinct(), "item_id").distinct()
    runs = store(places(docs, checked_broadcast(anchors, p.most_broadcast), short, k), "runs")

    # Second reading: the words around the anchors.
    facts = checked_broadcast(items.select("item_id", "iw", "m", "hs"), p.most_broadcast)
    around = runs.join(checked_broadcast(items.select("item_id", "m").distinct(), p.most_broadcast), "item_id")
    wanted = around.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "m", "run")).alias("runs"))
    found = docs.join(checked_broadcast(wanted.withColumnRenamed("doc_id", "wanted_id"), p.most_broadcast), F.col("doc_id").eqNullSafe(F.col("wanted_id")))

    def regions(w: Column) -> Column:
        def region(x: Column) -> Column:
            first = F.greatest((x["run"] - 2) * x["m"], F.lit(0))
            return F.struct(x["item_id"].alias("item_id"), x["m"].alias("m"), x["run"].alias("run"), first.alias("first"), F.size(w).alias("n"), F.slice(w, first + 1, (x["run"] + 3) * x["m"] + k - first).alias("region"))

        return F.transform("runs", region)

    near = found.select("doc_id", F.explode(let(words(F.lower("text")), regions)).alias("x")).select("doc_id", "x.*").filter(F.size("region") > 0).join(facts, ["item_id", "m"])
    starts = window_starts(F.col("region"), F.col("first"), F.col("n"), F.col("m"), F.col("hs"), F.col("run"), p)
    cut = near.select("doc_id", "item_id", "m", "region", "first", F.explode(starts).alias("start"))
    # The region ends behind the last window that starts in it, so that a slice is the window.
    windows = cut.select("doc_id", "item_id", "m", "start", F.slice("region", F.greatest(F.col("start") - F.col("first"), F.lit(0)) + 1, F.col("m")).alias("ww")).filter(F.size("ww") > 0)
    windows = store(windows.withColumn("fp", fingerprint(F.col("ww"), p)), "windows")

    # Hamming search on the items' blocks and their near values.
    changed = F.array(*[F.lit(v).cast("long") for v in near_values(p)])
    cells = lambda fp, also: F.flatten(F.array(*[also(F.lit(i), block(fp, i, p)) for i in range(p.blocks)]))
    cell = lambda i, v: F.struct(i.alias("block"), v.alias("value"))
    prints = store(items.select("item_id", "m", fingerprint(F.col("iw"), p).alias("item_fp")).distinct(), "prints")
    known = prints.select("item_id", "m", "item_fp", F.explode(cells(F.col("item_fp"), lambda i, v: F.transform(changed, lambda c: cell(i, v.bitwiseXOR(c))))).alias("c")).select("item_id", "m", "item_fp", "c.*")
    left = windows.select("doc_id", "m", "start", "ww", "fp", F.explode(cells(F.col("fp"), lambda i, v: F.array(cell(i, v)))).alias("c")).select("doc_id", "m", "start", "ww", "fp", "c.*")
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    pairs = left.join(checked_broadcast(known, p.most_broadcast), ["m", "block", "value"]).filter(F.bit_count(differ) <= p.radius)
    # A pair that agrees in several blocks counts at the first of them.
    pairs = pairs.filter(F.forall(F.sequence(F.lit(0), F.lit(p.blocks - 1)), lambda i: (i >= F.col("block")) | (F.bit_count(block(differ, i, p)) > p.radius // p.blocks)))
    beyond = windows.join(checked_broadcast(prints.drop("m"), p.most_broadcast), "item_id").filter(F.bit_count(differ) > p.radius)
    pairs = pairs.select("doc_id", "item_id", "start", "ww").unionByName(beyond.select("doc_id", "item_id", "start", "ww"))

    listed = weighed.groupBy("item_id").agg(F.collect_list(F.struct("h", "weight")).alias("shingles"), F.sum("weight").alias("total"))
    rare = math.log(1 + n_items)

    def similarity(g: Column) -> Column:
        shared = F.filter("shingles", lambda x: F.array_contains(g, x["h"]))
        weight = F.aggregate(shared, F.lit(0.0), lambda s, x: s + x["weight"])
        return weight / (F.col("total") + F.lit(rare) * (F.size(g) - F.size(shared)))

    own = F.array_distinct(shingle_hashes(F.col("ww"), k))
    judged = pairs.join(checked_broadcast(listed, p.most_broadcast), "item_id").withColumn("similarity", let(own, similarity)).filter(F.col("similarity") >= p.similarity - ROUNDING)
    # Equal similarities are sums in different orders: the first of those that round alike.
    best = judged.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.round("similarity", 9)).alias("r"), "start", "similarity")).alias("best"))
    out = store(best.select("doc_id", "item_id", F.col("best.start").cast("long").alias("start"), F.col("best.similarity").alias("similarity")), "hits")
    drop_stored(spark, items, weighed, runs, windows, prints)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """docs without the documents that hold an item, repeated rows of a doc_id alike.

    Documents with a null or empty text stay, a null doc_id is one like others, columns of any name stay as they are, and
    empty tables are no special case.
    """
    name = free_name(docs, "hit")
    hits = decontamination(docs.select("doc_id", "text"), benchmark, p=p).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(checked_broadcast(hits, p.most_broadcast), docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")
