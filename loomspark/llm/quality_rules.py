"""Quality rules: a threshold table compiled into one projection of JVM expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import BLANKS, WORD, let, words

#: Frequent function words of English, German, French, Spanish, Italian, Portuguese, Dutch, Polish, Swedish,
#: Turkish and Indonesian, one line each.
STOP_WORDS = (
    "the of and to in is it that for was on are as with his they at be this from or by not but have "
    "der die das und ist von mit den des ein eine zu im nicht auf sich auch als dem "
    "le la les et est un une du de au sur pas que qui dans pour "
    "el los las y en se del por con para una su al lo es "
    "il di che e non per un sono si anche della nel "
    "o os que não uma com mais dos da ao pelo "
    "het een van dat niet zijn met voor ook maar "
    "w nie się na z do że jest i jak "
    "och att det som för av är inte på om "
    "bir ve bu için ile çok ama olarak "
    "yang dan ini itu untuk dengan dari tidak"
).split()
SYMBOLS = "[#*$%&|<>]"
#: Scripts that none of these words is written in; texts mostly in them are not judged by stop words.
OTHER_SCRIPTS = ("Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Bengali", "Tamil", "Thai", "Georgian", "Hangul", "Hiragana", "Katakana", "Han")
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """The row fails where top / bottom is below low or above high (either may be None), counted from least_words words on.

    top and bottom name base counts; without bottom, top counts by itself.  Nothing fails on a bottom of 0.  A rule of known
    scripts leaves out texts with more than half of their characters in OTHER_SCRIPTS.
    """

    name: str
    top: str
    bottom: str | None = None
    low: float | None = None
    high: float | None = None
    least_words: int = 0
    known_scripts: bool = False

    def failed(self, m: Column) -> Column:
        value = m[self.top] / F.nullif(m[self.bottom], F.lit(0)) if self.bottom else m[self.top]
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (value < self.low)
        if self.high is not None:
            bad = bad | (value > self.high)
        if self.known_scripts:
            bad = bad & ~m["other_script"]
        return F.coalesce(bad, F.lit(False)) & (m["n_words"] >= self.least_words)


TOO_SHORT = Rule("too_short", "n_words", low=10)
RULES = (
    TOO_SHORT,
    Rule("word_length", "word_chars", "n_words", low=2, high=20),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, least_words=50, known_scripts=True),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=0.3),
    Rule("symbol_lines", "n_symbol_lines", "n_lines", high=0.5),
)
#: Fails where more than this share of the words, in hundredths, lies in repeated windows.
MOST_REPEATED = 20


def repeated_words(w: Column) -> Column:
    """Words covered by a 5-word window that is found twice or more.

    Windows are compared by a 64-bit hash.  A text without a repeated window, the usual case, needs one hash set; else the
    sorted (hash, place) pairs show the repeated windows and the gaps between their places how many words these cover.
    """
    n = F.size(w)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(WINDOW))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

        return let(let(pairs, places), total)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def other_script(text: Column, word_chars: Column) -> Column:
    """Whether more than half of the characters of the words are in OTHER_SCRIPTS; each of these takes a second byte at least, so
    most texts are told by their bytes."""
    counted = F.regexp_count(text, F.lit("[" + "".join(rf"\p{{Is{x}}}" for x in OTHER_SCRIPTS) + "]"))
    return F.when((F.octet_length(text) - F.length(text)) * 2 > word_chars, counted * 2 > word_chars).otherwise(F.lit(False))


def measures(text: Column) -> Column:
    """All base counts of a text as one struct."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def counted(w: Column) -> Column:
        stop = sorted(set(STOP_WORDS))
        word_chars = F.length(text) - F.regexp_count(text, F.lit(f"[{BLANKS}]"))
        return let(lines, lambda found: let(word_chars, lambda chars: F.struct(
            F.size(w).cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(found).cast("long").alias("n_lines"),
            F.size(F.filter(found, lambda x: F.regexp_count(x, F.lit(SYMBOLS)) * 10 > F.length(x))).cast("long").alias("n_symbol_lines"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
            other_script(text, chars).alias("other_script"),
        )))

    return let(words(text), counted)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the struct column ``quality``: the base counts, base_failed, failed (names of the rules broken) and kept.

    Null, empty and blank texts have counts of 0 and fail by their length.  Rows are judged one by one and by their whole text,
    however long it is, so repeated rows and other columns don't matter and an empty table gives an empty table; a column
    named quality is replaced.
    """

    def judged(m: Column) -> Column:
        too_repeated = m["n_repeat_words"] * 100 > m["n_words"] * MOST_REPEATED
        base_failed = TOO_SHORT.failed(m) | too_repeated
        broken = {"repeats": too_repeated} | {r.name: r.failed(m) for r in rules}
        names = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in broken.items()]), lambda x: x.isNotNull())
        counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_symbol_lines", "n_stop_words", "other_script")
        return let(names, lambda found: F.struct(*[m[c].alias(c) for c in counts], base_failed.alias("base_failed"), found.alias("failed"), ((F.size(found) == 0) & ~base_failed).alias("kept")))

    return docs.withColumn("quality", let(measures(docs[text]), judged))
