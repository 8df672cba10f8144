"""Source divergence audit: how far the sources of a language are from each other, and by which terms.

Terms become integers.  A batch of texts is cut into terms, these into a sorted array, and counted by (group, id) with
bincount; Spark adds the counts up.  The terms that enough documents of a language have are its dictionary, dealt out by
ranges of UTF-8 order, so a chunk of it is a sorted array whose ids keep that order.  A chunk's counts are one dense table of
groups by ids; shares, differences and ties are plain array work on it, all in whole numbers, and what leaves a chunk is a
number for each two sources and a few terms for each source.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import drop_stored, release_memory, small_batches, store


@dataclass(frozen=True)
class Parameters:
    #: Documents of a language that a term must be in.
    least_documents: int = 10
    #: Terms reported for each group.
    top_terms: int = 10
    #: Terms of a dictionary chunk, about.
    chunk_terms: int = 50_000
    #: Bytes of a text that are cut into terms at once.
    segment: int = 4 * 2**20


#: Shares are counted in these.
UNIT = 1_000_000_000
#: Terms are runs of ASCII letters and of bytes of other letters; everything else separates them.
_SEPARATED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def segments(raw: bytes, size: int) -> Iterator[bytes]:
    """A text's bytes, lower-cased and with blanks between terms, in pieces that end between terms."""
    raw = raw.translate(_SEPARATED)
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + size)
        if stop < len(raw):
            cut = raw.rfind(b" ", at, stop)
            stop = cut if cut > at else raw.find(b" ", stop)
            stop = len(raw) if stop < 0 else stop
        yield raw[at:stop]
        at = stop


COUNTED = "lang string, source string, term string, n long, d long"


def counted(parts: Iterator[pd.DataFrame], p: Parameters) -> Iterator[pd.DataFrame]:
    """(lang, source, term, n, d): occurrences, and documents that have the term, in each batch."""
    for pdf in parts:
        groups = pd.MultiIndex.from_arrays([pdf["lang"], pdf["source"]])
        group, names = pd.factorize(groups)
        lists, long = [], []
        for g, raw in zip(group.tolist(), pdf["text"], strict=True):
            if len(raw) > p.segment:
                found: Counter[bytes] = Counter()
                for piece in segments(raw, p.segment):
                    found.update(piece.split())
                long.append((g, found))
                lists.append([])
            else:
                lists.append(raw.translate(_SEPARATED).split())
        sizes = np.array([len(x) for x in lists])
        words = np.empty(int(sizes.sum()), dtype=object)
        words[:] = [w for x in lists for w in x]
        if len(words):
            # Ids of the batch's own dictionary, a sorted array.
            seen, found = pd.factorize(words)
            order = np.argsort(found.astype(object), kind="stable")
            place = np.empty(len(found), np.int64)
            place[order] = np.arange(len(found))
            ids, terms, k = place[seen], found[order], len(found)
            cell = np.repeat(group, sizes) * k + ids
            n = np.bincount(cell, minlength=len(names) * k)
            once = np.unique(np.repeat(np.arange(len(lists)), sizes) * k + ids)
            d = np.bincount(group[once // k] * k + once % k, minlength=len(names) * k)
            at = np.flatnonzero(n)
            yield _rows(names, at // k, terms[at % k], n[at], d[at])
        for g, found in long:
            yield _rows(names, np.full(len(found), g), list(found), list(found.values()), 1)
    release_memory()


def _rows(names: pd.MultiIndex, group: np.ndarray, terms, n, d) -> pd.DataFrame:
    return pd.DataFrame({"lang": names.get_level_values(0).to_numpy()[group], "source": names.get_level_values(1).to_numpy()[group], "term": [t.decode() for t in terms], "n": n, "d": d})


def shares(n: np.ndarray, total: np.ndarray | int, v: int) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / (total + 2 v)) in whole numbers; in two steps, so that nothing leaves 64 bits below 2.9e14."""
    whole = np.asarray(total, np.int64) + 2 * v
    high, rest = np.divmod((n.astype(np.int64) + 2) * 31_250, whole)
    return 1 + high * 32_000 + rest * 32_000 // whole


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


CHUNK = "part string, source string, item string, value long"


def chunk_table(terms: pd.DataFrame, groups: pd.DataFrame, p: Parameters) -> pd.DataFrame:
    """A chunk's share of the sums of source pairs (each pair once, in UTF-8 order), and the best terms of each source.

    terms: (term, per), per the sources with their counts; groups: (source, total, v) of the language, all of them.
    """
    utf8 = lambda x: np.array([s.encode() for s in x], dtype=object)
    sources = groups["source"].to_numpy()[np.argsort(utf8(groups["source"]), kind="stable")]
    total = groups.set_index("source")["total"].loc[sources].to_numpy(np.int64)
    v = int(groups["v"].iloc[0])
    by_term = np.argsort(utf8(terms["term"]), kind="stable")
    dictionary = terms["term"].to_numpy()[by_term]
    k = len(dictionary)
    entries = [(i, r) for i, per in enumerate(terms["per"].to_numpy()[by_term]) for r in per]
    ids = np.array([i for i, _ in entries], np.int64)
    keys = utf8(sources)
    row = np.searchsorted(keys, utf8([r["source"] for _, r in entries]))
    table = np.zeros(len(sources) * k, np.int64)
    # A source and a term meet once.
    table[row * k + ids] = np.array([r["n"] for _, r in entries], np.int64)
    table = table.reshape(len(sources), k)
    whole = table.sum(axis=0)
    share = shares(table, total[:, None], v)
    base = shares(whole, int(total.sum()), v)
    out = []
    for i in range(len(sources) - 1):
        value = np.array([int(differences(share[i], x).sum()) for x in share[i + 1 :]], np.int64)
        out.append(pd.DataFrame({"part": "pair", "source": sources[i], "item": sources[i + 1 :], "value": value}))
    for i, source in enumerate(sources):
        at = np.flatnonzero((table[i] > 0) & (share[i] > base))
        f = differences(share[i, at], base[at])
        # Ids are in the order of the terms, and a stable sort keeps it among equal values.
        best = np.argsort(-f, kind="stable")[: p.top_terms]
        out.append(pd.DataFrame({"part": "term", "source": source, "item": dictionary[at[best]], "value": f[best]}))
    return pd.concat(out, ignore_index=True)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", p: Parameters = Parameters()) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group.

    Part `pair`: each other source of the language, and how far the shares of the language's terms are apart.  Part `term`:
    the terms a source has a larger share of than its language, the best of them.  Ranks start at 1, larger values first,
    equal ones in UTF-8 order of the item.

    Nulls are empty strings, and an empty language or source is one like others.  Every row is a document, repeated or not;
    a language without terms has pairs of value 0, a source alone in its language none, an empty table gives no row.  Texts
    of any length are read to their end in pieces.  Other columns don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))
    found = rows.mapInPandas(lambda parts: counted(parts, p), COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    # One row a kept term; it names at most all sources of its language, of which the result has all pairs.
    per = F.collect_list(F.struct("source", "n"))
    kept = store(found.groupBy("lang", "term").agg(F.sum("d").alias("d"), per.alias("per")).filter(F.col("d") >= p.least_documents).select("lang", "term", "per"), "kept-terms")

    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sums = kept.select("lang", F.explode("per").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(v, "lang", "left")
    groups = store(groups.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("v", F.lit(0)).cast("long").alias("v")), "groups")

    n_chunks = max(1, math.ceil(kept.count() / p.chunk_terms))
    chunks = kept.repartitionByRange(n_chunks, "lang", "term").withColumn("chunk", F.spark_partition_id())
    chunks = store(chunks, "chunks")
    at = chunks.select(F.col("lang").alias("of_lang"), F.col("chunk").alias("of_chunk")).distinct()
    every = at.join(groups, F.col("of_lang") == F.col("lang")).select("of_lang", "of_chunk", "source", "total", "v")
    parts = chunks.groupBy("lang", "chunk").cogroup(every.groupBy("of_lang", "of_chunk")).applyInPandas(
        lambda key, t, g: chunk_table(t, g, p).assign(lang=key[0])[["lang", "part", "source", "item", "value"]], f"lang string, {CHUNK}"
    )
    parts = store(parts, "divergence-parts")

    half = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    pairs = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = parts.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.unionByName(terms).withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= p.top_terms))
    out = store(ranked, "divergence")
    drop_stored(spark, kept, groups, chunks, parts)
    return out
