"""Understanding of tasks: aspects, query terms and asked names.  Tasks are the small side, so this is plain Python, and a
table of tasks is read by vectorised functions."""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- tokens ----------------------------------------------------------------------------------------------------------

#: Scripts that are read by characters, letters of Arabic, and the signs its words are read without.
_CJK = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}"
_TOKEN = regex.compile(rf"[{_CJK}]+|[\p{{L}}\p{{M}}\p{{N}}]+")
_RUN = regex.compile(rf"[{_CJK}]+")
_ARABIC = re.compile("[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")
_MARKS = re.compile("[ً-ٰٟۖ-ۭـ]")

#: Words that a query is read without, by language, in the form they have after stemming.
STOP_WORDS = {
    "en": """a an the of on in at to for from by with as into about over after before between and or but if than then so what who
        whom whose which where when why how do doe does did doing is are was were be been being it its this that these those can
        could would should may might will shall i me my you your he him his she her we us our they them their just only also very
        too more most some any all each few other such own same mr mrs ms miss dr""",
    "es": """el la los las un una unos unas de del al en con por para como qué que quién quien cuál cual cuáles cuales dónde donde
        cuándo cuando cómo este esta estos estas ese esa eso esto hay es son fue ser estar su sus se le les lo y o pero sobre""",
    "hi": """यह वह जो कि का की के को से में पर है हैं था थे थी क्या कौन किस किसे किसके किसकी किसका कहाँ कहां क्यों कैसे बारे लिए भी और या तो ही एक
        इस उस ये वे नहीं हुआ हुई हुए गया गई गए आया आयी आए""",
    "ru": """что кто какой какая какие какое где когда почему как это эта этот эти том того для при или но же бы ли из от до по со об
        про чём чем на в во к ко у за под над был была были есть он она они мы вы я и а с""",
    "ar": "في من إلى الى على عن مع هذا هذه ذلك تلك التي الذي الذين ما ماذا هل كيف أين اين لماذا لم لن لا إن ان أن كان كانت هو هي هم نحن أنا انا و أو او ثم قد كل بعض",
}
_STOP = frozenset(w for words in STOP_WORDS.values() for w in words.split())
#: Phrases without content, titles before names, and capitalised words that are no given names.
_FILLER = re.compile(r"\b(?:early\s+on|at\s+first|at\s+the\s+(?:start|beginning)|in\s+the\s+(?:beginning|end)|to\s+begin\s+with)\b", re.I | re.A)
_TITLES = frozenset("mr mrs ms miss dr sir lady lord dame".split())
_NO_NAME = frozenset(
    """red blue black white green great little new old north south east west series annual quarterly total headed head king queen prince
    princess chapter section part book volume league union united federal national international addressable market""".split()
)
#: Fixed value: two capitalised words in a row, as a name.
_NAME_PAIR = re.compile(r"\b([A-Z][a-z]{1,40})\s+([A-Z][a-z]{1,40})\b", re.A)


def stem(t: str) -> str:
    if not t.isascii() or len(t) < 4:
        return t
    for end, least in (("ing", 5), ("ed", 4)):
        if len(t) >= least and t.endswith(end):
            return t[: -len(end)]
    return t[:-1] if t.endswith("s") and not t.endswith("ss") else t


def tokens(text: str) -> list[str]:
    """As functions.text.tokenize."""
    out: list[str] = []
    for part in _TOKEN.findall(text.lower()):
        if _RUN.fullmatch(part):
            for at in range(len(part)):
                out += [part[at], part[at : at + 2]][: 2 if at + 1 < len(part) else 1]
        else:
            out.append(stem(_MARKS.sub("", part) if _ARABIC.search(part) else part))
    return out


def _titled_names(task: str) -> tuple[list[str], set[str]]:
    """For 'Given Surname' pairs: what a text with titles says instead, and the given names that it leaves out."""
    instead: list[str] = []
    given: set[str] = set()
    for m in _NAME_PAIR.finditer(task):
        first, last = m[1].lower(), m[2].lower()
        hyphened = m.start() > 0 and task[m.start() - 1] == "-"
        if not hyphened and first not in _TITLES and not {first, stem(first), last, stem(last)} & _NO_NAME:
            instead += ["miss", "mr", "mrs", stem(last)]
            given.add(stem(first))
    return instead, given


def query_terms(task: str) -> list[str]:
    """The terms a task is ranked by: repeats count, stop words, single characters and filler phrases don't."""
    instead, given = _titled_names(task)
    out = [t for t in tokens(_FILLER.sub(" ", task)) if len(t) > 1 and t not in _STOP and t not in given]
    return out + [t for t in dict.fromkeys(instead) if len(t) > 1 and t not in out]


# --- aspects ---------------------------------------------------------------------------------------------------------

MOST_ASPECTS, LEAST_LETTERS = 6, 3
#: Words that may join two asks.
_JOIN = regex.compile(r"\s+(?:and|also|y|и|und|et|और)\s+|،\s*و", regex.I)
#: What a question begins with.
_ASKS = regex.compile(
    r"(?:what|which|who|whom|whose|where|when|why|how|can|could|would|should|is|are|was|were|did|do|does"
    r"|qué|que|quién|quien|cuál|cual|cuáles|cuales|dónde|donde|cuándo|cuando|cómo|como|por\s+qué|por\s+que"
    r"|что|кто|какой|какая|какие|какое|где|когда|почему|как"
    r"|क्या|कौन|किस|किसे|किसके|किसकी|किसका|कहाँ|कहां|क्यों|कैसे"
    r"|ماذا|لماذا|أين|اين|كيف|هل|ما|من)(?![\p{L}\p{M}\p{N}])",
    regex.I,
)
#: Fixed value: a comma at the end, Latin or Arabic.
_COMMA_END = regex.compile(r"[,،]\s*$")


def _question(part: str) -> str:
    return part.strip().lstrip("¿¡").strip()


def _marked(part: str) -> bool:
    return "?" in part or "؟" in part


def _at_joins(part: str) -> list[str]:
    """Cut at the first joining word if it joins two asks, then both sides likewise."""
    m = _JOIN.search(part)
    if not m:
        return [part]
    before, right = part[: m.start()], part[m.end() :]
    left = _COMMA_END.sub("", before)
    two_asks = bool(left.strip() and _question(right)) and (bool(_ASKS.match(_question(right))) or (_marked(left) and _marked(right)) or before.rstrip().endswith((",", "،")))
    return _at_joins(left) + _at_joins(right) if two_asks else [part]


def _at_commas(part: str) -> list[str]:
    """Cut at commas if all that they separate are questions."""
    pieces = [p.strip() for p in regex.split(r"[,،]\s+", part) if p.strip()]
    return pieces if len(pieces) > 1 and all(_marked(p) or _ASKS.match(_question(p)) for p in pieces) else [part]


def split_aspects(task: str | None) -> list[str]:
    """The separate asks of a task, six at most; the task itself where there are no others, [""] for an empty one."""
    task = (task or "").strip()
    lines = [s.strip() for line in regex.split(r"[\n;]+", task) for s in regex.split(r"(?<=[?؟])\s+", line)]
    parts = [s for s in lines if len(s) >= LEAST_LETTERS] or [task]
    found = [q for p in parts for j in _at_joins(p) for c in _at_commas(j) if len(q := _question(c)) >= LEAST_LETTERS]
    once = {q.lower(): q for q in reversed(found)}
    return [once[k] for k in dict.fromkeys(q.lower() for q in found)][:MOST_ASPECTS] or [task]


# --- names -----------------------------------------------------------------------------------------------------------

#: Titles in a question for a name, and words before a surname that are no given names.
_TITLE = r"\b(?:Mr|Mrs|Ms|Miss|Dr|Sir|Lady|Lord|Dame|Rev|Capt|Col)\.?\s+([A-Za-z][A-Za-z'-]{1,38})"
_NOT_GIVEN = frozenset("mr mrs ms miss dr sir lady lord dame rev capt col the a an young elder older old little dear poor good late new".split())
_ASKS_LINE = re.compile(r"^\s*(?:what|who|whose|which|when|where|how)\b", re.I | re.M | re.A)


def asked_surname(task: str) -> str | None:
    """The surname in lower case where a task asks for someone's first or given name."""
    if re.search(r"\b(?:first|given)\s+name\b", task, re.I | re.A):
        for end in (r"'s\b", r"\b"):
            if m := re.search(_TITLE + end, task.strip(), re.I | re.A):
                return m[1].lower()
    return None


def has_given_name(text: str, surname: str) -> bool:
    """Whether the surname stands behind a given name: in capitals, or in title case and not behind a title or the like."""
    if re.search(rf"\b[A-Z]{{2,30}}\s+{re.escape(surname.upper())}\b", text, re.A):
        return True
    titled = surname[:1].upper() + surname[1:]
    return any(m[1].lower() not in _NOT_GIVEN for m in re.finditer(rf"\b([A-Z][a-z]{{1,30}})\s+{re.escape(titled)}\b", text, re.A))


def answer_shaped(task: str) -> bool:
    return asked_surname(task) is not None or bool(_ASKS_LINE.search(task.strip()))


# --- columns ---------------------------------------------------------------------------------------------------------


def aspects(task: Column) -> Column:
    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(split_aspects, na_action=None)

    return split(task)


def terms(task: Column) -> Column:
    @F.pandas_udf("array<string>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda t: query_terms(t or ""), na_action=None)

    return read(task)


def given_name(text: Column, name: Column) -> Column:
    """Whether a text has the surname behind a given name, as has_given_name; false for null."""
    edge = r"(?![A-Za-z0-9_])"
    quoted = lambda x: F.concat(F.lit(r"\s+\Q"), x, F.lit(r"\E" + edge))
    capitals = F.regexp_like(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])[A-Z]{2,30}"), quoted(F.upper(name))))
    titled = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    before = F.regexp_extract_all(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]{1,30})"), quoted(titled)), F.lit(1))
    given = F.exists(before, lambda w: ~F.lower(w).isin(*sorted(_NOT_GIVEN)))
    return F.coalesce((F.length(name) > 0) & (capitals | given), F.lit(False))


def surname(task: Column) -> Column:
    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda t: asked_surname(t or ""), na_action=None)

    return read(task)
