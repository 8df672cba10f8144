"""Token and cost meters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Budgets (default, most) and the least budget of each surface.
DEFAULT_BUDGET, MOST_BUDGET = 4000, 200_000
LEAST_BUDGET = {"web": 100, "compile": 500, "expand": 200}
PRICE_PER_MILLION = 3.0


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trim_all(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def token_count(text: Column) -> Column:
    """Estimated tokens: a quarter of the length, one at least; null text counts as empty."""
    return F.greatest(F.lit(1), F.floor(utf16_length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def content_tokens(text: Column) -> Column:
    """Tokens without comments and runs of blank lines; of the raw text where nothing else is left."""
    bare = trim_all(F.regexp_replace(F.regexp_replace(text, r"<!--[\s\S]*?-->", " "), r"\n{3,}", "\n\n"))
    return token_count(F.when(F.length(bare) > 0, bare).otherwise(text))


def half_up(x: Column) -> Column:
    """Nearest integer; halves go up, also below zero."""
    return F.floor(x + 0.5)


def clamp_budget(value: Column, surface: str = "compile") -> Column:
    """A budget from untrusted text or number: whole, within the surface's bounds, the default where it is no number."""
    number = value.cast("string").try_cast("double")
    whole = F.when(number.isNull() | F.isnan(number), F.lit(float(DEFAULT_BUDGET))).otherwise(F.signum(number) * F.floor(F.abs(number)))
    return F.greatest(F.lit(LEAST_BUDGET[surface]), F.least(whole, F.lit(float(MOST_BUDGET)))).cast("int")


def tokens_saved(raw: Column, used: Column) -> Column:
    return F.greatest(F.lit(0), raw - used)


def reduction_pct(raw: Column, used: Column) -> Column:
    """Saved share in percent with one decimal, 0 for an empty source; negative where more is used than there was."""
    return F.when(raw > 0, half_up((raw - used) * 1000 / raw) / 10).otherwise(F.lit(0.0))


def cost_usd(tokens: Column, per_million: float = PRICE_PER_MILLION) -> Column:
    return tokens / 1e6 * per_million


#: Budgets offered where a source's size is unknown or large, and the bounds and shares of the smaller ones.
PRESETS, PRESET_LOW, PRESET_HIGH, HALF, FIFTH = (1000, 4000, 8000), 100, 20_000, 0.5, 0.2


def budget_presets(raw: Column) -> Column:
    """struct<quick, standard, deep>: for a small source all, half and a fifth of its tokens, in steps of 50, each below the next."""
    step = lambda x: F.greatest(F.lit(PRESET_LOW), F.least(F.lit(PRESET_HIGH), half_up(x / 50) * 50))
    deep = step(F.greatest(raw, F.lit(PRESET_LOW)))
    standard = step(F.least(deep, F.greatest(F.lit(2 * PRESET_LOW), raw * HALF)))
    quick = step(F.least(standard - 50, F.greatest(F.lit(PRESET_LOW), raw * FIFTH)))
    large = raw.isNull() | (raw == 0) | (raw >= PRESETS[2])
    pick = lambda fixed, own, name: F.when(large, F.lit(fixed)).otherwise(own).cast("int").alias(name)
    return F.struct(pick(PRESETS[0], F.least(quick, standard), "quick"), pick(PRESETS[1], F.least(standard, deep), "standard"), pick(PRESETS[2], deep, "deep"))


def packaging_note(content: Column, wire: Column, over: float = 0.1) -> Column:
    """What is sent beside the content where that is more than `over` of it, else null."""
    note = F.concat(F.format_number(content, 0), F.lit(" content, about "), F.format_number(wire, 0), F.lit(" as sent"))
    return F.when((content > 0) & (wire > content) & ((wire - content) / content > over), note)


def setting(value: Column, default: float, low: float, high: float, whole: bool = True) -> Column:
    """A number from a setting's text within its bounds; the default where there is none or it is no finite number."""
    number = F.trim(value).try_cast("double")
    good = F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))
    number = F.when(good, number).otherwise(F.lit(float(default)))
    number = F.signum(number) * F.floor(F.abs(number)) if whole else number
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number))


def max_of(x: Column) -> Column:
    """Aggregate: the maximum, at least 0."""
    return F.coalesce(F.greatest(F.max(x), F.lit(0)), F.lit(0))
