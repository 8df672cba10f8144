"""Language identification: word frequencies first, shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import drop_stored, free_name, release_memory, small_batches, store

UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """Runs of letters in lower case; training and scoring read texts by this alone."""
    out = _WORDS.findall(text.lower()) if text else []
    # The pattern takes signs such as ½ for letters; these part words like any other sign.
    return out if all(map(str.isalpha, out)) else [w for x in out for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


@dataclass(frozen=True)
class Parameters:
    #: Most documents the model is fitted on, shared out evenly to the languages: of each those that come first by a hash of
    #: the text, and of a language with fewer than its share all.
    most_documents: int = 12_000
    longest_ngram: int = 4
    #: A word, or an n-gram of a distinct word, counts as seen from so many on; of a language with fewer such words than
    #: few_words every word counts, so that none is lost.
    least_count: int = 2
    few_words: int = 1
    smooth: float = 0.5


class Table:
    """Log frequencies of keys by language: a floor for each language, and for each key what the languages that have it add."""

    def __init__(self, counts: dict[str, dict[int, int]], n: int, smooth: float):
        keys = sorted(counts)
        self.at = {k: i for i, k in enumerate(keys)}
        self.sizes = np.array([len(counts[k]) for k in keys], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if keys else np.zeros(0, np.int64)
        self.languages = np.array([j for k in keys for j in counts[k]], np.int32)
        seen = np.array([c for k in keys for c in counts[k].values()], np.float64)
        self.more = np.log1p(seen / smooth)
        total = np.bincount(self.languages, seen, n) + smooth * max(1, len(keys))
        self.floor = np.log(smooth / total)

    def sum(self, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Summed rows of keys, each times its weight."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        flat = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
        return self.floor * weights.sum() + np.bincount(self.languages[flat], self.more[flat] * np.repeat(weights, sizes), len(self.floor))


@dataclass
class Model:
    """languages in order, and log frequencies of words and n-grams by language."""

    languages: list[str]
    longest: int
    words: Table
    ngrams: Table

    def places(self, word: str) -> list[int]:
        """At each place of a marked word the longest known n-gram that starts there."""
        w, get, known = f"<{word}>", self.ngrams.at.get, []
        for i in range(len(w)):
            for n in range(min(self.longest, len(w) - i), 0, -1):
                if (k := get(w[i : i + n])) is not None:
                    known.append(k)
                    break
        return known


def sample(docs: DataFrame, lang: str, text: str, p: Parameters) -> DataFrame:
    """(lang, text) of at most about most_documents rows, each text of a language once."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = p.most_documents / max(1, sizes.count())
    # One row a language that occurs, which is what the model has a column for.
    rates = sizes.select("lang", F.least(F.lit(1.0), F.lit(share) / F.col("n")).alias("rate"))
    hashed = rows.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.col("rate") * 1_000_003)
    return hashed.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("lang", "text")


def word_counts(rows: DataFrame, most_held: int = 200_000) -> DataFrame:
    """(lang, word, n)"""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pd.DataFrame:
            return pd.DataFrame([(g, w, n) for g, c in found.items() for w, n in c.items()], columns=["lang", "word", "n"])

        for pdf in parts:
            for g, t in zip(pdf["lang"], pdf["text"], strict=True):
                found[g].update(letters(t))
                if sum(map(len, found.values())) > most_held:
                    yield flush()
                    found.clear()
        if found:
            yield flush()
        release_memory()

    return rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", p: Parameters = Parameters()) -> Model:
    """A model of every language that labels a row with a word; Spark counts the sample's words, and those seen often enough, or
    all of a language with few, come to the driver."""
    rows = store(sample(docs, lang, text, p), "sample")
    counts = store(word_counts(rows), "word-counts")
    # One row a language that occurs.
    seen = counts.groupBy("lang").agg(F.sum((F.col("n") >= p.least_count).cast("long")).alias("seen"))
    found = counts.join(F.broadcast(seen), "lang").filter((F.col("n") >= p.least_count) | (F.col("seen") < p.few_words)).select("lang", "word", "n").toPandas()
    drop_stored(docs.sparkSession, rows, counts)
    languages = sorted(found["lang"].unique())
    place = {x: i for i, x in enumerate(languages)}
    words: dict[str, dict[int, int]] = defaultdict(dict)
    grams: dict[str, dict[int, int]] = defaultdict(dict)
    for lang_, word, n_ in found.itertuples(index=False):
        j = place[lang_]
        words[word][j] = int(n_)
        marked = f"<{word}>"
        for k in range(1, p.longest_ngram + 1):
            for i in range(len(marked) - k + 1):
                c = grams[marked[i : i + k]]
                c[j] = c.get(j, 0) + 1
    kept = {g: c for g, c in grams.items() if len(g) == 1 or sum(c.values()) >= p.least_count}
    return Model(languages, p.longest_ngram, Table(words, len(languages), p.smooth), Table(kept, len(languages), p.smooth))


class Scorer:
    """Sums the rows of a text's words; the n-grams of unseen words are looked up once and remembered up to a bound."""

    MOST = 3_000_000

    def __init__(self, model: Model):
        self.model, self.held, self.size = model, {}, 0

    def unseen(self, word: str) -> list[int]:
        if (k := self.held.get(word)) is None:
            k = self.model.places(word)
            # What is kept is bounded by its numbers and letters, as a word may be of any length.
            self.size += len(k) + len(word) + 20
            if self.size > self.MOST:
                self.held.clear()
                self.size = len(k) + len(word) + 20
            self.held[word] = k
        return k

    def score(self, text: str | None) -> tuple[str, float]:
        found = letters(text)
        if not found or not self.model.languages:
            return UNKNOWN, 0.0
        get = self.model.words.at.get
        total = np.zeros(len(self.model.languages))
        known: list[int] = []
        times: list[int] = []
        grams: list[int] = []
        shares: list[float] = []
        for word, n in Counter(found).items():
            if (k := get(word)) is not None:
                known.append(k)
                times.append(n)
            elif new := self.unseen(word):
                # The mean over the word's n-grams, once for each time it occurs.
                grams += new
                shares += [n / len(new)] * len(new)
        if known:
            total += self.model.words.sum(np.array(known), np.array(times, np.float64))
        if grams:
            total += self.model.ngrams.sum(np.array(grams), np.array(shares))
        odds = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.languages[best], float(1 / odds.sum())


def predicted(text: Column, model: Model, spark) -> Column:
    """struct<lang_pred, score>; the model's size is bounded by its sample, so it is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for s in parts:
            yield pd.DataFrame([scorer.score(t) for t in s], columns=["lang_pred", "score"]).astype({"lang_pred": "object", "score": "float64"})
        del scorer
        release_memory()

    return score(text)


def language_id(docs: DataFrame, train: DataFrame, text: str = "text", lang: str = "lang", p: Parameters = Parameters()) -> DataFrame:
    """docs with lang_pred and score (the posterior of that language, all being equally likely before).

    Null texts and those without a letter are ``und`` with score 0; so is everything when train has no labelled word.
    Ties go to the first language by name.  Nothing but the text decides, so equal texts get equal results, however long
    they are; repeated rows stay, an empty table gives an empty table, and docs' columns named like the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    model = fit(train, lang, text, p)
    name = free_name(docs, "found")
    scored = docs.withColumn(name, predicted(docs[text], model, docs.sparkSession))
    return scored.withColumn("lang_pred", F.col(f"{name}.lang_pred")).withColumn("score", F.col(f"{name}.score")).drop(name)
