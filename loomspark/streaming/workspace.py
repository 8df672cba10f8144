"""A session's workspace from its events, and what of it is out of date; all by aggregates, as each field has a last writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events that clear what was compiled, and those that change what a run would give.
CLEARS = ("DOCUMENT_SELECTED", "COMPILE_CLEARED")
CHANGES = (*CLEARS, "DOCUMENT_RESTORED", "TASK_CHANGED", "BUDGET_CHANGED", "COMPILE_SUCCEEDED", "PROVE_INCLUDE_CHANGED", "PROVE_INCLUDE_CLEARED")
TIERS = ("quick", "standard", "deep")
EVENT = (
    "session string, at long, type string, task string, budget int, file string, sample_key string, tier string, presets struct<quick:int,standard:int,deep:int>, "
    "id string, kind string, included boolean, tokens int, tokens_saved long, usd_saved double, note string"
)


def workspace_states(events: DataFrame) -> DataFrame:
    """The state of each session after its events (EVENT, in the order of at, which is unique in a session).

    session, task, budget, file, sample_key, compiled_task and compiled_budget (null where nothing is compiled), source
    (available, restorable or missing when it was), expanded (ids put into the proof, sorted), saved_tokens and saved_usd,
    intent (an asked run that nobody took), note, hydrated and revision, which grows with every change that a run depends on.
    """
    is_ = lambda *types: F.col("type").isin(*types)
    last = lambda value, when: F.max_by(value, F.when(when, F.col("at")))
    when = lambda cond: F.max(F.when(cond, F.col("at")))
    hydrated, compiled = is_("WORKSPACE_HYDRATED"), is_("COMPILE_SUCCEEDED")
    tier = F.when(F.col("tier") == "quick", F.col("presets.quick")).when(F.col("tier") == "standard", F.col("presets.standard")).when(F.col("tier") == "deep", F.col("presets.deep"))
    picks = is_("PRESETS_CHANGED") & tier.isNotNull()
    named = lambda c: hydrated | (is_("DOCUMENT_SELECTED") & F.col(c).isNotNull())
    marks = events.groupBy("session").agg(
        when(hydrated).alias("h"), when(compiled).alias("c"), when(is_(*CLEARS)).alias("x"), when(compiled | is_(*CLEARS) | is_("PROVE_INCLUDE_CLEARED") | hydrated).alias("reset"),
        last(F.col("task"), hydrated | is_("TASK_CHANGED")).alias("task"), last(F.coalesce(F.when(picks, tier), F.col("budget")), hydrated | is_("BUDGET_CHANGED") | picks).alias("budget"),
        last(F.col("file"), named("file") | is_("DOCUMENT_RESTORED")).alias("file"), last(F.col("sample_key"), named("sample_key")).alias("sample_key"),
        last(F.struct("task", "budget"), compiled).alias("got"), last(F.struct("id", "kind"), is_("RUN_INTENT_CREATED")).alias("asked"), when(is_("RUN_INTENT_CREATED")).alias("asked_at"),
        last(F.col("note"), hydrated | is_("DOC_SIZE_NOTE_CHANGED")).alias("note"), F.sum((is_(*CHANGES) | picks).cast("long")).alias("revision"),
    )
    rows = events.join(marks.select("session", "h", "reset", "c", "asked", "asked_at"), "session")
    since = lambda c: F.col("at") > F.coalesce(c, F.lit(-1).cast("long"))
    kept = compiled & since(F.col("h"))
    took = is_("RUN_INTENT_CLAIMED") & since("asked_at") & (F.col("id") == F.col("asked.id")) & (F.col("kind") == F.col("asked.kind"))
    # What the session had when it was taken up again counts on; a document at hand is known from before the compile.
    before = F.coalesce(F.col("at") < F.col("c"), F.lit(False))
    sums = rows.groupBy("session").agg(
        F.sum(F.when(kept, F.greatest(F.coalesce("tokens_saved", F.lit(0).cast("long")), F.lit(0).cast("long"))).when(hydrated & (F.col("at") == F.col("h")), F.coalesce("tokens_saved", F.lit(0).cast("long"))).otherwise(0)).alias("saved_tokens"),
        F.sum(F.when(kept, F.greatest(F.coalesce("usd_saved", F.lit(0.0)), F.lit(0.0))).when(hydrated & (F.col("at") == F.col("h")), F.coalesce("usd_saved", F.lit(0.0))).otherwise(0.0)).alias("saved_usd"),
        F.coalesce(F.max(took.cast("int")), F.lit(0)).alias("taken"),
        F.max_by(F.col("file"), F.when((is_("DOCUMENT_RESTORED") | (is_("DOCUMENT_SELECTED") & F.col("file").isNotNull())) & before, F.col("at"))).alias("had_file"),
        F.max_by(F.col("sample_key"), F.when(named("sample_key") & before, F.col("at"))).alias("had_sample"),
    )
    toggled = rows.filter(is_("PROVE_INCLUDE_CHANGED") & since("reset")).groupBy("session", "id").agg(F.max_by("included", "at").alias("included"))
    expanded = toggled.filter("included").groupBy("session").agg(F.array_sort(F.collect_list("id")).alias("expanded"))
    out = marks.join(sums, "session").join(expanded, "session", "left")
    live = F.col("c").isNotNull() & (F.col("c") > F.greatest(F.coalesce("x", F.lit(-1).cast("long")), F.coalesce("h", F.lit(-1).cast("long"))))
    intent = F.when(F.col("asked").isNotNull() & (F.col("taken") == 0) & (F.col("asked_at") > F.coalesce("h", F.lit(-1).cast("long"))), F.col("asked.id"))
    source = F.when(F.col("had_file").isNotNull(), "available").when(F.col("had_sample").isNotNull(), "restorable").otherwise("missing")
    return out.select(
        "session", "task", "budget", "file", "sample_key", F.when(live, F.col("got.task")).alias("compiled_task"), F.when(live, F.col("got.budget")).alias("compiled_budget"), F.when(live, source).alias("source"),
        F.coalesce("expanded", F.array().cast("array<string>")).alias("expanded"), "saved_tokens", "saved_usd", intent.alias("intent"), "note", F.col("h").isNotNull().alias("hydrated"), "revision",
    )


def workspace_status(compiled_task: Column, task: Column, compiled_budget: Column, budget: Column, compiled: Column, source: Column, valid: Column, busy: Column) -> Column:
    """struct of what is out of date and whether compiling is possible; an agent reads anew, so only another question makes its result old."""
    question = compiled & F.coalesce(F.trim(compiled_task) != F.trim(task), F.lit(False))
    room = compiled & F.coalesce(compiled_budget != budget, F.lit(False))
    return F.struct(
        question.alias("question_stale"), room.alias("budget_stale"), (question | room).alias("prove_stale"), question.alias("agent_stale"), (~source).alias("source_unavailable"),
        (source & valid & ~busy).alias("compile_available"),
    )
