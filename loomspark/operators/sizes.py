"""What an artifact costs, by arithmetic: a text is read once for its sizes, and any selection is measured from these.

The meter drops comments, shortens runs of blank lines and trims both ends of the whole text.  So a section counts by its
parts: line breaks at either end, what lies between them, and white space at the ends of that.  A comment that a section
leaves open swallows what follows up to the next end of a comment; for that the sizes behind the first such end are kept too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.tokens import token_count, utf16_length
from loomspark.operators.selection import CUT_MARK, END, LEAST_BODY, LEAST_PARTIAL, LEAST_PREFIX, MOST_LINES, NOTE, SHRINK

#: Tokens and letters of the mark of a cut.
MARK_TOKENS, MARK_LENGTH = len(CUT_MARK) // 4, len(CUT_MARK)
_SPACE = r"(?U)[\s\x{FEFF}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- sizes -----------------------------------------------------------------------------------------------------------

PIECES = ("k", "b", "a", "c", "lead", "tail", "blank", "open")
PIECE = "struct<k:int,b:int,a:int,c:int,lead:int,tail:int,blank:boolean,open:boolean>"


def piece(text: Column) -> Column:
    """Sizes of a text: k, its length if it is all line breaks, else -1; b and a, line breaks before and after; c, length between
    them; lead and tail, white space at the ends of that; blank, if it is nothing else; open, if it ends within a comment."""
    bare = F.regexp_replace(text, r"<!--[\s\S]*?-->", " ")

    def of(t: Column) -> Column:
        ends = F.regexp_replace(t["t"], r"\A\n+", "")
        return let(F.struct(t["t"].alias("t"), t["open"].alias("open"), ends.alias("e"), F.regexp_replace(ends, r"\n+\z", "").alias("core")), sized)

    def sized(x: Column) -> Column:
        core = F.regexp_replace(x["core"], r"\n{3,}", "\n\n")
        size = utf16_length(core)
        return F.struct(
            F.when(x["core"] == "", F.length(x["t"])).otherwise(-1).alias("k"), (F.length(x["t"]) - F.length(x["e"])).alias("b"), (F.length(x["e"]) - F.length(x["core"])).alias("a"), size.alias("c"),
            (size - utf16_length(F.regexp_replace(core, r"\A" + _SPACE, ""))).alias("lead"), (size - utf16_length(F.regexp_replace(core, _SPACE + r"\z", ""))).alias("tail"),
            (F.regexp_replace(core, _SPACE, "") == "").alias("blank"), x["open"].alias("open"),
        )

    opened = F.contains(bare, F.lit("<!--"))
    return F.when(text.isNotNull(), let(F.struct(F.when(opened, F.substring_index(bare, "<!--", 1)).otherwise(bare).alias("t"), opened.alias("open")), of))


def behind_comment(text: Column) -> Column:
    """Sizes of what follows the first end of a comment; null where there is none."""
    at = F.instr(text, "-->")
    return piece(F.when(at > 0, F.substring(text, at + 3, F.length(text))))


def crumb_line(breadcrumb: Column) -> Column:
    return F.concat(F.lit("<!-- section: "), breadcrumb, F.lit(" -->\n"))


def section_sizes(text: Column, breadcrumb: Column) -> Column:
    """struct<z, y, cz, cy, u, cu>: sizes of a section's text and of the line that tells its breadcrumb, alone and behind an open
    comment, and the lengths of both."""
    line = crumb_line(breadcrumb)
    return F.struct(piece(text).alias("z"), behind_comment(text).alias("y"), piece(line).alias("cz"), behind_comment(line).alias("cy"), utf16_length(text).alias("u"), utf16_length(line).alias("cu"))


def packed_sizes(size: Column) -> Column:
    """section_sizes as a short text for rows that are moved: numbers of z, y, cz, cy by commas, each behind a semicolon, u and cu last;
    nothing for what is null, 0 and 1 for what is true or not."""
    part = lambda p: F.when(p.isNotNull(), F.array_join(F.array(*[F.coalesce(p[c].cast("int").cast("string"), F.lit("")) for c in PIECES]), ",")).otherwise("")
    number = lambda n: F.coalesce(n.cast("string"), F.lit(""))
    return let(size, lambda s: F.array_join(F.array(*[part(s[c]) for c in ("z", "y", "cz", "cy")], number(s["u"]), number(s["cu"])), ";"))


def _kept(run: Column) -> Column:
    """A run of line breaks, shortened."""
    return F.when(run < 3, run).otherwise(2)


_STATE = ("n", "gap", "run", "open")


def _state(n: Column, gap: Column, run: Column, is_open: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), gap.cast("int").alias("gap"), run.cast("int").alias("run"), is_open.alias("open"))


def _read(s: Column, p: Column) -> Column:
    """State (n up to the last letter, white space behind it, line breaks behind that) after a piece."""
    gap = s["gap"] + _kept(s["run"] + p["b"])
    words = _state(F.when(s["n"] > 0, s["n"] + gap + p["c"] - p["tail"]).otherwise(p["c"] - p["lead"] - p["tail"]), p["tail"], p["a"], p["open"])
    return F.when(p["k"] >= 0, _state(s["n"], s["gap"], s["run"] + p["k"], p["open"])).when(p["blank"], _state(s["n"], gap + p["c"], p["a"], p["open"])).otherwise(words)


def _fed(s: Column, whole: Column, behind: Column) -> Column:
    closed = let(_state(s["n"], s["gap"] + _kept(s["run"]) + 1, F.lit(0), F.lit(False)), lambda x: _read(x, behind))
    return F.when(~s["open"], _read(s, whole)).when(behind.isNull(), _state(*[s[c] for c in _STATE])).otherwise(closed)


def artifact_tokens(sections: Column, header: Column) -> Column:
    """Content tokens of an artifact: sections (array of structs with crumb and sizes in the order of the file), header its length."""

    def step(s: Column, e: Column) -> Column:
        new = ~s["crumb"].eqNullSafe(e["crumb"]) | (s["raw"] == 0)
        size = e["size"]
        at = _state(*[s[c] for c in _STATE])
        crumbed = F.when(new, _fed(at, size["cz"], size["cy"])).otherwise(at)
        read = let(crumbed, lambda x: _fed(x, size["z"], size["y"]))
        raw = s["raw"] + size["u"] + 2 + F.when(new, size["cu"]).otherwise(0)
        return let(read, lambda x: F.struct(x["n"].alias("n"), x["gap"].alias("gap"), F.when(x["open"], x["run"]).otherwise(x["run"] + 2).cast("int").alias("run"), x["open"].alias("open"), e["crumb"].alias("crumb"), raw.cast("int").alias("raw")))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("gap"), F.lit(0).alias("run"), F.lit(False).alias("open"), F.lit(None).cast("string").alias("crumb"), F.lit(0).alias("raw"))
    size = lambda s: F.when(s["n"] > 0, s["n"]).otherwise(header + s["raw"] + len(END))
    return F.aggregate(sections, zero, step, lambda s: F.greatest(F.lit(1), F.floor(size(s) / 4).cast("int")))


def header_length(name: Column) -> Column:
    """Length of an artifact's first lines, the blank one behind them included."""
    return utf16_length(F.concat(F.lit("<!-- Compiled context from: "), name, F.lit(f" -->\n{NOTE}\n\n")))


# --- cuts ------------------------------------------------------------------------------------------------------------


def cut(text: Column, full: Column, most: Column, terms: Column) -> Column:
    """struct<text, tokens>: a text in at most so many tokens with the mark of the cut, around terms if there are any; null where
    nothing useful is left of it.

    The body is the head of the text, or the lines that have rare terms, then their neighbours, then lines from the top.  It is
    shortened by shares until it fits; only lengths are tried, and the text is cut once.
    """
    room = most - MARK_TOKENS

    def shortened(body: Column) -> Column:
        astral = utf16_length(body) != F.length(body)
        size = lambda n: F.when(astral, utf16_length(F.substring(body, F.lit(1), n))).otherwise(n) + MARK_LENGTH
        steps = F.ceil(F.log(F.greatest(F.length(body), F.lit(LEAST_BODY)) / LEAST_BODY) / 0.16).cast("int") + 2
        length = F.aggregate(F.sequence(F.lit(1), steps), F.length(body), lambda n, _: F.when((F.floor(size(n) / 4) > most) & (n > LEAST_BODY), F.floor(n * SHRINK).cast("int")).otherwise(n))
        made = lambda n: let(F.floor(size(n) / 4).cast("int"), lambda k: F.when(k.between(LEAST_PARTIAL, most), F.struct(F.concat(F.substring(body, F.lit(1), n), F.lit(CUT_MARK)).alias("text"), k.alias("tokens"))))
        return let(length, made)

    head = F.substring(text, F.lit(1), F.greatest(F.lit(LEAST_PREFIX), F.floor(F.length(text) * room / full).cast("int")))
    asked = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.length(t) > 1)
    body = F.when(F.size(asked) > 0, let(F.split(text, "\n"), lambda lines: _around(lines, asked, room, head))).otherwise(head)
    return F.when(most < LEAST_PARTIAL, None).when(full <= most, F.struct(text.alias("text"), full.cast("int").alias("tokens"))).when(room >= LEAST_PARTIAL, let(body, shortened))


def _around(lines: Column, asked: Column, room: Column, head: Column) -> Column:
    lower = F.transform(lines, lambda x: F.lower(x))
    last = F.size(lines) - 1

    def found(low: Column) -> Column:
        rare = F.filter(asked, lambda t: F.size(F.filter(low, lambda x: F.contains(x, t))).between(1, MOST_LINES))
        hit = lambda r: F.filter(F.transform(low, lambda x, i: F.when(F.exists(F.when(F.size(r) > 0, r).otherwise(asked), lambda t: F.contains(x, t)), i)), lambda i: i.isNotNull())
        return let(rare, hit)

    def grown(hits: Column) -> Column:
        joined = lambda at: F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n")
        near = F.filter(F.flatten(F.transform(hits, lambda i: F.array(i - 1, i + 1))), lambda j: j.between(0, last))

        def take(s: Column, j: Column) -> Column:
            cost = token_count(F.concat(F.get(lines, j), F.lit("\n")))
            more = let(cost, lambda k: F.when(k <= s["left"], F.struct(F.array_append(s["kept"], j).alias("kept"), (s["left"] - k).alias("left"))).otherwise(s))
            return F.when((s["left"] <= 0) | F.array_contains(s["kept"], j), s).otherwise(more)

        start = F.struct(hits.alias("kept"), (room - token_count(joined(hits))).cast("int").alias("left"))
        kept = F.aggregate(F.concat(near, F.sequence(F.lit(0), last)), start, take, lambda s: F.array_sort(s["kept"]))
        return F.when(F.size(hits) > 0, let(kept, joined)).otherwise(head)

    return let(let(lower, found), grown)
