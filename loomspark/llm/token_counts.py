"""Token counts: each distinct pre-token is counted once, then joined to every document's pre-token frequencies.

1. Tasks collect the pre-tokens of their texts; one aggregate makes them distinct and the tokenizer counts each of them once,
   into a stored table.
2. The texts are read again for their pre-token frequencies.  The table's most frequent pre-tokens, a bounded number of bounded
   length, are known to every task and summed there; only the frequencies of the others are joined to the table by a shuffle,
   so a pre-token that is everywhere moves no rows.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import mul

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import drop_stored, free_name, most_frequent, release_memory, small_batches, store

#: What the byte-level pre-tokenizer takes for blanks (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
#: A blank goes with the word behind it and the blanks before that stand alone; marks that end a word of Latin letters stand
#: alone.  No pre-token of the library crosses these cuts.
PRE_TOKEN = re.compile(
    f"[{SPACE}]?[{_LATIN}]+(?=[{_MARKS}]+(?:[{SPACE}]|\\Z))|(?<=[{_LATIN}])[{_MARKS}]+(?=[{SPACE}]|\\Z)"
    f"|[{SPACE}]?[^{SPACE}]+|[{SPACE}]+(?=[{SPACE}][^{SPACE}])|[{SPACE}]+"
)


@dataclass(frozen=True)
class Parameters:
    #: Pre-tokens that every task knows: so many of up to 64 characters, and of longer ones as many as are this many bytes.
    most_known: int = 200_000
    longest_known: int = 64
    long_bytes: int = 16_000_000
    #: What a task keeps of distinct pre-tokens, and of texts, at once: pre-tokens and characters.
    most_held: int = 200_000
    most_chars: int = 2_000_000


def load(path: str):
    """The tokenizer of a file; a bare name is looked up among the public ones."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if os.sep not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Tokenizer.from_file(path)


class PreTokens:
    """Cuts texts into pre-tokens and the added tokens between them."""

    def __init__(self, path: str):
        special = [t.content for t in load(path).get_added_tokens_decoder().values()]
        #: An added token inside a text is one token by the library's default and splits what surrounds it.
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def cut(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text in order, and the added tokens in it."""
        if self.special and (n := len(self.special.findall(text))):
            return [w for part in self.special.split(text) for w in PRE_TOKEN.findall(part)], n
        return PRE_TOKEN.findall(text), 0


def in_chunks(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters, so that what is kept of them at once stays small."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def distinct(parts: Iterator[pd.DataFrame], path: str, p: Parameters) -> Iterator[pd.DataFrame]:
    """(piece, runs): the pre-tokens of a task's texts, with the number of runs of texts that have them."""
    found: Counter = Counter()
    pre, size = PreTokens(path), 0

    def flush() -> pd.DataFrame:
        return pd.DataFrame({"piece": list(found), "runs": list(found.values())})

    for pdf in parts:
        for texts in in_chunks(pdf["text"], p.most_chars):
            new = set().union(*(pre.cut(t)[0] for t in texts))
            size += sum(map(len, new))
            found.update(new)
            # Characters are counted once a run, so long pre-tokens fill what a task may hold as many short ones do.
            if len(found) > p.most_held or size > 8 * p.most_chars:
                yield flush()
                found.clear()
                size = 0
    if found:
        yield flush()
        found.clear()
    release_memory()


def sizes(parts: Iterator[pd.DataFrame], path: str, p: Parameters) -> Iterator[pd.DataFrame]:
    """(piece, runs, n): the tokens of each pre-token."""
    tokenizer = load(path)
    for pdf in parts:
        # The ids of a piece live as long as its run of pieces; those of a document are never made.
        n = [len(e) for c in in_chunks(pdf["piece"], p.most_chars // 8) for e in tokenizer.encode_batch_fast(c, add_special_tokens=False)]
        yield pdf.assign(n=pd.Series(n, dtype="int64", index=pdf.index))
    release_memory()


def piece_table(docs: DataFrame, path: str, text: str, p: Parameters) -> DataFrame:
    """(piece, runs, n): every distinct pre-token of the texts, counted once."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = texts.mapInPandas(lambda parts: distinct(parts, path, p), "piece string, runs long").groupBy("piece").agg(F.sum("runs").alias("runs"))
    return store(every.mapInPandas(lambda parts: sizes(parts, path, p), "piece string, runs long, n long"), "pieces")


def token_counts(docs: DataFrame, path: str = "byte_bpe_50k.json", limit: int = 1024, text: str = "text", p: Parameters = Parameters()) -> DataFrame:
    """docs, but for the text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null counts as empty, an empty text has 0 of each, and an empty table gives an empty table.  Rows are numbered when they
    are written, so repeated rows and null ids stay and are counted one by one; a very long text is one row like others.
    Columns of docs named like the new ones are replaced, others of any name don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = piece_table(docs, path, text, p)
    # Long ones in steps of doubled length, so that a few very long ones don't keep out what is as frequent.
    size = F.length("piece")
    tiers = [(p.longest_known, p.most_known)]
    while tiers[-1][0] < p.long_bytes // 64:
        tiers.append((2 * tiers[-1][0], p.long_bytes // (128 * tiers[-1][0])))
    lengths = {r.k for r in pieces.select(F.ceil(F.log2(F.greatest(size, F.lit(p.longest_known)) / p.longest_known)).alias("k")).distinct().collect()}
    known = pieces.filter(F.lit(False)).select("piece", "n")
    for k, (most, n) in enumerate(tiers):
        if k in lengths:
            least = tiers[k - 1][0] if k else -1
            known = known.unionByName(most_frequent(pieces.filter((size > least) & (size <= most)), "runs", n).select("piece", "n"))
    known = known.toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(known["piece"].to_pylist(), known["n"].to_pylist(), strict=True)))

    @F.pandas_udf("n long, others array<struct<piece:string,f:long>>")
    def summed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pre, look = PreTokens(path), shared.value.get
        for s in parts:
            rows = []
            for t in s:
                found, n = pre.cut(t)
                f = Counter(found)
                n_of = list(map(look, f))
                others = []
                if None in n_of:
                    others = [{"piece": w, "f": k} for (w, k), x in zip(f.items(), n_of, strict=True) if x is None]
                    n_of = [x or 0 for x in n_of]
                rows.append((n + sum(map(mul, f.values(), n_of)), others))
            yield pd.DataFrame(rows, columns=["n", "others"])
        release_memory()

    new = ("n_bytes", "n_tokens", "over_limit")
    row, counted = free_name(docs, "row"), free_name(docs, "counted")
    kept = [c for c in docs.columns if c not in (text, *new)]
    read = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(counted, summed(F.coalesce(F.col(text), F.lit(""))))
    n_bytes = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes")
    rows = store(read.select(*kept, n_bytes, row, F.col(f"{counted}.n").alias("n_tokens"), F.col(f"{counted}.others").alias(counted)), "counts")
    drop = [counted, row]
    if pieces.count() > len(known):
        other = rows.select(row, F.explode(counted).alias("o")).select(row, "o.piece", "o.f")
        sums = other.join(pieces.select("piece", "n"), "piece").groupBy(row).agg(F.sum(F.col("f") * F.col("n")).alias(counted))
        first = rows
        rows = store(rows.drop(counted).join(sums, row, "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce(counted, F.lit(0))).drop(*drop), "summed")
        drop_stored(spark, first)
    drop_stored(spark, pieces)
    return rows.drop(*drop).withColumn("over_limit", F.col("n_tokens") > limit)
