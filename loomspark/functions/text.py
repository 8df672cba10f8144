"""Tokenizer and label expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.tokens import trim_all

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: Letters that most texts are made of come first, as a match tries the parts of a class in order.
WORD = r"[a-z0-9\p{L}\p{M}\p{N}]+"
TOKEN = rf"[{CJK}]+|{WORD}"
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
ARABIC_MARKS = r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]"
NO_HEADING = "(no heading)"


def light_stem(t: Column) -> Column:
    """ASCII words of four letters on lose ing, else ed, else a single s."""
    n = F.length(t)
    cut = (
        F.when(t.endswith("s"), F.when(t.endswith("ss"), t).otherwise(F.substring(t, F.lit(1), n - 1)))
        .when(t.endswith("ed"), F.substring(t, F.lit(1), n - 2))
        .when((n >= 5) & t.endswith("ing"), F.substring(t, F.lit(1), n - 3))
        .otherwise(t)
    )
    # As many bytes as characters: ASCII alone.
    return F.when((n >= 4) & (F.octet_length(t) == n), cut).otherwise(t)


def bare_arabic(t: Column) -> Column:
    """Arabic words without vowel signs and stretching; other scripts keep theirs."""
    return F.when(t.rlike(ARABIC), F.regexp_replace(t, ARABIC_MARKS, "")).otherwise(t)


def cjk_ngrams(run: Column) -> Column:
    """Each character of a run and, behind it, the pair it begins."""
    n = F.length(run)
    pair = lambda i: F.when(i < n, F.array(F.substring(run, i, F.lit(1)), F.substring(run, i, F.lit(2)))).otherwise(F.array(F.substring(run, i, F.lit(1))))
    return F.flatten(F.transform(F.sequence(F.lit(1), n), pair))


def special_script(text: Column) -> Column:
    """Whether a text has letters that tokens are made of in another way."""
    return text.rlike(rf"[{CJK}]|{ARABIC}")


def raw_tokens(text: Column) -> Column:
    """Tokens in order as they stand in the text, in lower case; CJK runs whole."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    every = lambda pattern: F.regexp_extract_all(lower, F.lit(pattern), F.lit(0))
    return F.when(special_script(lower), every(TOKEN)).otherwise(every(WORD))


def terms_of(token: Column) -> Column:
    """What one raw token counts as: a word's stem, or the characters and pairs of a CJK run."""
    other = F.when(token.rlike(rf"^[{CJK}]+$"), cjk_ngrams(token)).otherwise(F.array(light_stem(bare_arabic(token))))
    return F.when(F.octet_length(token) == F.length(token), F.array(light_stem(token))).otherwise(other)


def tokenize(text: Column) -> Column:
    """Tokens in order, with repeats.  What a text is made of is asked once a text: most have words alone."""
    tokens = raw_tokens(text)
    return F.when(special_script(F.coalesce(text, F.lit(""))), F.flatten(F.transform(tokens, terms_of))).otherwise(F.transform(tokens, light_stem))


def leaf(breadcrumb: Column) -> Column:
    """The last part of a breadcrumb."""
    return F.element_at(F.split(breadcrumb, " > "), -1)


def section_heading(breadcrumb: Column) -> Column:
    """The last part of a breadcrumb, empty where it says that there is none."""
    return F.when(trim_all(leaf(breadcrumb)) != NO_HEADING, trim_all(leaf(breadcrumb))).otherwise(F.lit(""))


def section_preview(text: Column) -> Column:
    """The first letters of a text without marks, in quotes; empty where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?m)^#+(?U)\s*", ""), r"[`*_>#|]", "")
    preview = F.substring(trim_all(F.regexp_replace(plain, r"(?U)\s+", " ")), 1, 44)
    return F.when(preview != "", F.concat(F.lit("“"), preview, F.lit("…”"))).otherwise(F.lit(""))


def section_label(breadcrumb: Column, text: Column) -> Column:
    """What a manifest calls a section: its heading, a preview of the text, or both."""
    heading, quoted = section_heading(breadcrumb), section_preview(text)
    short = F.when(F.length(heading) > 36, F.concat(F.substring(heading, 1, 35), F.lit("…"))).otherwise(heading)
    return F.when((heading != "") & (quoted != ""), F.concat_ws(" — ", short, quoted)).when(heading != "", heading).when(quoted != "", quoted).otherwise("(untitled section)")


def id_span(ids: Column) -> Column:
    """First and last of section ids in an array, by number; empty for none."""
    numbers = F.transform(ids, lambda x: F.substring(x, 2, 12).try_cast("int"))
    low, high = F.array_min(numbers), F.array_max(numbers)
    return F.when(low.isNull(), "").when(low == high, F.concat(F.lit("s"), low)).otherwise(F.concat(F.lit("s"), low, F.lit("–s"), high))


def source_name(name: Column) -> Column:
    """A display name that can't break out of a comment."""
    base = F.substring(F.regexp_replace(name, r"^.*[/\\]", ""), 1, 120)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"[\r\n\x00]", ""), "-->", "_"), r"[^A-Za-z0-9_.\- ()\[\]]+", "_")
    out = F.regexp_replace(F.regexp_replace(clean, "_+", "_"), r"^[_.]+|[_.]+$", "")
    return F.when(out != "", out).otherwise("document")


def expanded_ids(json: Column, most: int = 12) -> Column:
    """Section ids in a JSON array: well-formed, once each, at most so many; none where it can't be read."""
    found = F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x.rlike(r"^s[0-9]+$"))), 1, most)


def redact_paths(message: Column) -> Column:
    """Log text without file paths."""
    return F.regexp_replace(message, r"(?:[A-Za-z]:)?(?:[/\\][\w.\-]+){2,}", "<path>")
