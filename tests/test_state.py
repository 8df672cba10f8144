"""Keyed state against plain walks: one-shot handles, workspaces, bounded keys, streams of handles."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspark.agent import AgentCompare, Busy, Gate, Reader, compare, models_from, run_agent, server_events
from loomspark.operators.selection import Section, count_tokens
from loomspark.streaming import state as T
from loomspark.streaming.workspace import CHANGES, CLEARS, EVENT, workspace_states

T0 = datetime(2024, 1, 1)


def at(m):
    return T0 + timedelta(minutes=m)


def test_one_shot_in_order_of_time(spark):
    rows = [("a", "use", at(0)), ("a", "store", at(1)), ("a", "use", at(2)), ("a", "use", at(3)), ("a", "store", at(4)), ("a", "use", at(18)), ("b", "store", at(5)), ("b", "use", at(21)), ("c", "use", at(6))]
    got = {(r.handle, r.ts): r.outcome for r in T.one_shot(spark.createDataFrame(rows, "handle string, kind string, ts timestamp")).collect()}
    assert got == {("a", at(0)): "gone", ("a", at(2)): "ok", ("a", at(3)): "gone", ("a", at(18)): "ok", ("b", at(21)): "gone", ("c", at(6)): "gone"}


def test_one_shot_bound_counts_what_is_held(spark):
    """Used handles make room: only those that are still held push the oldest out."""
    rows = [("x", "store", at(0)), *[(f"u{i}", k, at(1 + i / 100 + j / 1000)) for i in range(8) for j, k in enumerate(("store", "use"))], ("y", "store", at(2)), ("x", "use", at(3)), ("z", "store", at(4)), ("z2", "store", at(5)), ("y", "use", at(6)), ("z", "use", at(7)), ("z2", "use", at(8))]
    frame = spark.createDataFrame([(*r, p) for r in rows for p in ("p", "q")], "handle string, kind string, ts timestamp, pool string")
    got = {(r.pool, r.handle): r.outcome for r in T.one_shot(frame, most=2, pool="pool").collect()}
    want = {f"u{i}": "ok" for i in range(8)} | {"x": "ok", "y": "gone", "z": "ok", "z2": "ok"}
    assert got == {(p, h): o for p in "pq" for h, o in want.items()}
    assert T.one_shot(frame.limit(0)).count() == 0


def plain_one_shot(rows, most, seconds):
    """One walk over all events of a pool."""
    held, out = {}, []
    for h, kind, t in sorted(rows, key=lambda x: (x[2], x[1], x[0])):
        if kind == "store":
            held = {k: v for k, v in held.items() if t - v <= timedelta(seconds=seconds) and k != h}
            while len(held) >= most:
                del held[min(held, key=held.__getitem__)]
            held[h] = t
        else:
            at_ = held.pop(h, None)
            out.append((h, t, "ok" if at_ is not None and t - at_ <= timedelta(seconds=seconds) else "gone"))
    return sorted(out)


@pytest.mark.parametrize(("most", "seconds", "handles"), [(3, 600, 12), (1, 90, 4), (8, 2000, 30), (1000, 100, 5)])
def test_one_shot_in_slices_equals_one_walk(spark, most, seconds, handles):
    """Entries that are used make room, bursts push others out, and slices begin in the middle of it."""
    r = random.Random(most)
    pools = {p: [(f"h{r.randrange(handles)}", r.choice(("store", "store", "use")), T0 + timedelta(seconds=r.randrange(3000) if r.random() < 0.8 else 1500 + r.randrange(40))) for _ in range(400)] for p in "pq"}
    frame = spark.createDataFrame([(*e, p) for p, es in pools.items() for e in set(es)], "handle string, kind string, ts timestamp, pool string")
    got = T.one_shot(frame, most, seconds, pool="pool", slice_rows=45).collect()
    for p, es in pools.items():
        assert sorted((x.handle, x.ts, x.outcome) for x in got if x.pool == p) == plain_one_shot(set(es), most, seconds)
    one = T.one_shot(frame.filter("pool = 'p'").drop("pool"), most, seconds, slice_rows=45).collect()
    assert sorted((x.handle, x.ts, x.outcome) for x in one) == plain_one_shot(set(pools["p"]), most, seconds)


def test_look_ups_as_of_their_time(spark):
    r = random.Random(3)
    rows = [(i, f"h{r.randrange(4) if r.random() < 0.7 else 0}", r.choice(("store", "use")), r.choice(("v", "w")), T0 + timedelta(seconds=r.randrange(4000))) for i in range(600)]
    rows.append((600, "none", "use", "x", at(1)))
    got = {x.id: (x.found, x.age, x.value) for x in T.look_ups(spark.createDataFrame(rows, "id int, handle string, kind string, value string, ts timestamp"), 300).collect()}
    stores = [x for x in rows if x[2] == "store"]
    for i, h, kind, _, t in rows:
        if kind == "use":
            last = max(((s[4], s[3]) for s in stores if s[1] == h and s[4] <= t), default=None)
            age = (t - last[0]).total_seconds() if last else None
            assert got[i] == ((True, age, last[1]) if last and age <= 300 else (False, None, None))
    assert len(got) == sum(x[2] == "use" for x in rows) and T.look_ups(spark.createDataFrame(rows[:0], "id int, handle string, kind string, value string, ts timestamp"), 300).count() == 0


def streamed(spark, tmp_path, name, frame, make):
    """What a stream gives of a table in two runs, the second from the checkpoint of the first."""
    rows = frame.orderBy("ts").collect()
    for k, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120), k
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_streams_equal_batches_over_a_restart(spark, tmp_path):
    r = random.Random(9)
    asked = spark.createDataFrame([(f"k{r.randrange(3)}", T0 + timedelta(seconds=i), r.choice(("/api/agent", "/api/answer", "/api/compile"))) for i in range(200)], "key string, ts timestamp, route string")
    got = streamed(spark, tmp_path / "rate", "rate", asked, lambda x: T.rate_limit_stream(x, 20, 30))
    want = T.rate_limit(asked, 20, 30).collect()
    assert sorted((x.key, x.ts, x.allowed, x.used) for x in got) == sorted((x.key, x.ts, x.allowed, x.used) for x in want)
    assert {x.allowed for x in want} == {True, False}
    events = spark.createDataFrame([(r.choice("pq"), f"h{r.randrange(9)}", r.choice(("store", "use")), T0 + timedelta(seconds=i)) for i in range(300)], "pool string, handle string, kind string, ts timestamp")
    got = streamed(spark, tmp_path / "once", "once", events, lambda x: T.one_shot_stream(x, 4, 60))
    want = T.one_shot(events, 4, 60, pool="pool").collect()
    assert sorted((x.pool, x.handle, x.ts, x.outcome) for x in got) == sorted((x.pool, x.handle, x.ts, x.outcome) for x in want)
    assert {x.outcome for x in want} == {"ok", "gone"}


def test_counters_are_observed(spark, data):
    from loomspark.plans.queries import conversation_docs
    from loomspark.operators.chunking import chunk_markdown

    seen = T.RunCounters()
    docs = seen.watch("compiles", conversation_docs(spark, data))
    chunks = seen.watch("tokens", seen.watch("sections", chunk_markdown(docs)), F.col("tokens"))
    asked = spark.createDataFrame([("k", at(i), "/api/agent") for i in range(12)], "key string, ts timestamp, route string")
    refused = seen.watch("rate_limited", T.rate_limit(asked).filter("not allowed"))
    rows = chunks.collect()
    n = refused.count()
    assert seen.totals() == {"compiles": conversation_docs(spark, data).count(), "sections": len(rows), "tokens": sum(r.tokens for r in rows), "rate_limited": n} and n == 0
    more = T.RunCounters()
    none = more.watch("rate_limited", T.rate_limit(asked, points=24).filter("not allowed"))
    none.collect()
    assert more.totals() == {"rate_limited": none.count()} and none.count() > 0


def test_keys_are_bounded_by_their_first_coming():
    m = T.BoundedKeys(2)
    for k in "abac":
        m.put(k, 1)
    assert list(m.held) == ["b", "c"]


def test_handles_stream(spark, tmp_path):
    rows = [("a", "store", at(0)), ("a", "use", at(29)), ("a", "use", at(31)), ("b", "use", at(1))]
    frame = spark.createDataFrame(rows, "handle string, kind string, ts timestamp")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = T.live_handles_stream(stream).writeStream.format("memory").queryName("handles").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert {(r.handle, r.ts, r.found) for r in spark.table("handles").collect()} == {("a", at(29), True), ("a", at(31), False), ("b", at(1), False)}


def fold(events):
    """A session's state, event by event."""
    s = {"task": None, "budget": None, "file": None, "sample_key": None, "got": None, "expanded": set(), "saved_tokens": 0, "saved_usd": 0.0, "intent": None, "note": None, "hydrated": False, "revision": 0}
    for e in events:
        t = e["type"]
        picks = t == "PRESETS_CHANGED" and e["tier"] in e["presets"]
        s["revision"] += t in CHANGES or picks
        if t == "WORKSPACE_HYDRATED":
            s |= {k: e[k] for k in ("task", "budget", "file", "sample_key", "note")} | {"got": None, "expanded": set(), "saved_tokens": e["tokens_saved"], "saved_usd": e["usd_saved"], "intent": None, "hydrated": True}
            s["at_hand"] = None
        elif t == "DOCUMENT_SELECTED":
            s |= {k: e[k] for k in ("file", "sample_key") if e[k] is not None}
        elif t == "DOCUMENT_RESTORED":
            s["file"] = e["file"]
        elif t == "TASK_CHANGED":
            s["task"] = e["task"]
        elif t == "BUDGET_CHANGED":
            s["budget"] = e["budget"]
        elif t == "DOC_SIZE_NOTE_CHANGED":
            s["note"] = e["note"]
        elif t == "COMPILE_SUCCEEDED":
            s |= {"got": (e["task"], e["budget"]), "expanded": set(), "saved_tokens": s["saved_tokens"] + max(0, e["tokens_saved"]), "saved_usd": s["saved_usd"] + max(0.0, e["usd_saved"])}
        elif t == "PROVE_INCLUDE_CHANGED":
            s["expanded"] = s["expanded"] | {e["id"]} if e["included"] else s["expanded"] - {e["id"]}
        elif t == "PROVE_INCLUDE_CLEARED":
            s["expanded"] = set()
        elif t == "RUN_INTENT_CREATED":
            s["intent"] = (e["id"], e["kind"])
        elif t == "RUN_INTENT_CLAIMED" and s["intent"] == (e["id"], e["kind"]):
            s["intent"] = None
        if picks:
            s["budget"] = e["presets"][e["tier"]]
        if t in CLEARS:
            s |= {"got": None, "expanded": set()}
    return s


def test_workspaces_equal_a_fold(spark):
    r = random.Random(4)
    types = [*CHANGES, "PROVE_INCLUDE_CHANGED", "PROVE_INCLUDE_CHANGED", "WORKSPACE_HYDRATED", "PRESETS_CHANGED", "DOC_SIZE_NOTE_CHANGED", "COMPILE_FAILED", "RUN_INTENT_CREATED", "RUN_INTENT_CLAIMED"]
    sessions = {}
    for n in range(150):
        sessions[str(n)] = [{
            "type": r.choice(types), "task": f"t{r.randrange(3)}", "budget": r.randrange(5) * 100, "file": r.choice([None, "f", "g"]), "sample_key": r.choice([None, "k"]), "tier": r.choice(["quick", "deep", None]), "presets": {"quick": 1, "standard": 2, "deep": 3},
            "id": f"s{r.randrange(3)}", "kind": r.choice("ab"), "included": r.random() < 0.6, "tokens": 1, "tokens_saved": r.randrange(-5, 50), "usd_saved": r.randrange(-5, 50) / 4, "note": f"n{r.randrange(3)}",
        } for _ in range(r.randrange(1, 40))]
    names = [c.strip().split(" ")[0] for c in EVENT.replace("struct<quick:int,standard:int,deep:int>", "s").split(", ")]
    rows = [tuple({**e, "session": s, "at": i, "presets": tuple(e["presets"].values())}[c] for c in names) for s, es in sessions.items() for i, e in enumerate(es)]
    got = {x.session: x for x in workspace_states(spark.createDataFrame(rows, EVENT)).collect()}
    for s, es in sessions.items():
        want, x = fold(es), got[s]
        assert (x.task, x.budget, x.file, x.sample_key, x.note, x.hydrated, x.revision) == tuple(want[k] for k in ("task", "budget", "file", "sample_key", "note", "hydrated", "revision")), s
        assert (x.compiled_task, x.compiled_budget) == (want["got"] or (None, None)) and set(x.expanded) == want["expanded"] and x.intent == (want["intent"] or [None])[0]
        assert x.saved_tokens == want["saved_tokens"] and abs(x.saved_usd - want["saved_usd"]) < 1e-9


def test_comparisons():
    asked = []
    done = compare("q", "word " * 100_000, "<!-- x -->short context here", lambda p, m: asked.append(p) or "a ", count=(seen := []).append)
    assert done.full_answer == done.answer == "a" and done.full_tokens <= 60_001 and done.tokens == 4 and done.reduction_pct == 100.0 and seen == ["parity_runs"] and len(asked[0]) < 250_000
    gate = Gate(1)
    with gate, pytest.raises(Busy), gate:
        pass
    now, held = [0.0], AgentCompare()
    held.clock = lambda: now[0]
    handle = held.store("q", "full text", "context")

    def fails(prompt, most):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        held.compare(handle, fails)
    assert held.compare(handle, lambda p, m: "b").answer == "b" and held.compare(handle, lambda p, m: "b") is None and held.compare("no", fails) is None
    late = held.store("q", "full", "c")
    now[0] = 16 * 60
    assert held.compare(late, fails) is None


def test_events_of_a_run():
    ranked = [Section("s0", 0, "D", "the answer is here", count_tokens("the answer is here"), 1.0)]
    run = lambda emit: run_agent(Reader(ranked, "answer", "d", 4), lambda p, m: "x", 100, on_step=emit)
    assert [e.split("\n")[0] for e in server_events(run)] == ["event: step", "event: step", "event: done"]
    assert list(server_events(lambda emit: 1 / 0))[0].startswith("event: error")


def test_models_from_settings():
    made = models_from({"A": " key ", "B": ""}, [("A", ["m1", "m2"], lambda k, n: (k, n)), ("B", ["m3"], lambda k, n: (k, n))])
    assert made == [("m1", ("key", "m1")), ("m2", ("key", "m2"))]


def test_stored_tables_are_swept(spark):
    from loomspark.sources.shared import drop_stored, store, sweep_stored

    a, b = store(spark.range(3), "a"), store(spark.range(4), "b")
    drop_stored(spark, a)
    assert b.count() == 4 and sweep_stored(spark) >= 2 and sweep_stored(spark) == 0
