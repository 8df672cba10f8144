"""The fold inside the JVM against the plain fold, on random files and tasks; sizes and cuts against plain text work."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import query as Q
from loomspark.operators import sizes as Z
from loomspark.operators.selection import Section, assemble, content_count, count_tokens, select, truncate
from loomspark.plans import compile as C

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "lorem", "ipsum", "dolor", "sit", "amet"]
BITS = ["a", "word ", "\n", "\n\n", "\n\n\n\n", " ", "<!-- x -->", "<!--", "-->", "é", "😀", "\t", "B C"]


def named(sections, task):
    """Scores and order of a task that asks for a name."""
    surname = Q.asked_surname(task)
    if surname is None:
        return sections
    top = max([0.0, *(s["score"] for s in sections)])
    hit = {s["ord"]: Q.has_given_name(s["text"], surname) for s in sections}
    for s in sections:
        s["score"] += 0.6 * top if top > 0 and hit[s["ord"]] else 0.0
    if not sections[0]["multi"]:
        sections = sorted(sections, key=lambda s: (-s["score"], s["ord"]))
    by_ord, order = {s["ord"]: s for s in sections}, [s["ord"] for s in sections]
    for at in order[:20]:
        after = at + 1
        if after in by_ord and by_ord[after]["breadcrumb"] == by_ord[at]["breadcrumb"] and hit[after] and not hit[at] and order.index(after) > order.index(at):
            order.remove(after)
            order.insert(order.index(at), after)
    return [by_ord[o] for o in order]


def plain(rows, task):
    """A task's selection by the plain fold, as compile tells it."""
    rows = named(sorted((dict(r) for r in rows), key=lambda r: (r["turn"], r["ord"]) if r["multi"] else (-r["score"], r["ord"])), task["task"])
    ranked = [Section(r["id"], r["ord"], r["breadcrumb"], r["text"], r["tokens"], r["score"], tuple(r["matched_queries"] or ())) for r in rows]
    done = select(ranked, task["token_budget"], task["name"], Q.query_terms(task["task"]), rows[0]["best"] or [], task["task"], task["forced"] or [], content=True)
    return done.text, content_count(assemble(task["name"], done.selected)), done.stopped_early, [(s.id, s.text, s.tokens, s.full_tokens) for s in done.selected], [s.id for s in done.omitted]


def some_text(r):
    kind = r.random()
    if kind < 0.1:
        return "".join(r.choice(BITS) for _ in range(r.randint(0, 30)))
    lines = [" ".join(r.choice(WORDS if r.random() < 0.9 else ["Jane Bennet", "Miss Bennet", "ANNA BENNET", "needle", "thread"]) for _ in range(r.choice((2, 5, 12, 40)))) for _ in range(r.choice((1, 1, 2, 5, 12)))]
    return "\n".join(lines)


def cases(seed, n):
    r = random.Random(seed)
    chunks, tasks, scored = [], [], []
    for f in range(n):
        file_id, k = f"f{f}", r.randint(1, 14)
        words = r.sample(WORDS, r.randint(1, 9))
        sections = []
        for o in range(k):
            text = some_text(r)
            if r.random() < 0.5:
                text = " ".join(w for w in text.split(" ") if w in words or not w.isalpha())
            sections.append({"file_id": file_id, "ord": o, "id": f"s{o}", "breadcrumb": r.choice(["A", "A > B", "C --> d", "E > (no heading)"]), "text": text, "tokens": count_tokens(text)})
        chunks += sections
        for t in range(3):
            ask = r.choice(["", " ".join(r.sample([*WORDS, "needle", "thread"], r.randint(1, 3))), "What is Miss Bennet's first name?", "Who is Mr. Bennet, his given name, and needle"])
            multi = r.random() < 0.5
            total = sum(s["tokens"] for s in sections)
            task = {"task_id": f"{file_id}-{t}", "file_id": file_id, "task": ask, "token_budget": r.choice((30, 45, 60, 100, 160, 400, max(41, total - 3), total, total + 2, 5000)), "name": "doc", "forced": r.sample([s["id"] for s in sections], min(k, r.choice((1, 1, 2, 3)))) if r.random() < 0.4 else None}
            tasks.append(task)
            levels = r.choice(([0.0], [1.0], [0.0, 0.3, 0.5, 0.9, 1.0], [2.0, 1.99, 1.97, 0.1]))
            turns = r.sample(range(k), k)
            best = [f"s{r.randrange(k)}" for _ in range(r.randint(2, 3))] if multi else None
            for s, turn in zip(sections, turns, strict=True):
                near = sorted(r.sample(range(3), r.choice((0, 0, 1, 2)))) if multi else None
                scored.append({"task_id": task["task_id"], "file_id": file_id, "ord": s["ord"], "score": r.choice(levels), "turn": turn if multi else None, "matched_queries": near or None, "best": best, "multi": multi})
    return chunks, tasks, scored


CHUNKS = "file_id string, ord int, id string, breadcrumb string, text string, tokens int"
TASKS = "task_id string, file_id string, task string, token_budget int, name string, forced array<string>"
SCORED = "task_id string, file_id string, ord int, score double, turn int, matched_queries array<int>, best array<string>, multi boolean"


def differing(spark, chunks, tasks, scored):
    """[(task, got, want)] where the fold and the plain one differ."""
    of = lambda rows, schema: spark.createDataFrame([[r[c.split()[0]] for c in schema.split(", ")] for r in rows], schema)
    out = C.packed(of(scored, SCORED), of(chunks, CHUNKS), of(tasks, TASKS)).collect()
    got = {r.task_id: (r.markdown, r.tokens_used, r.stopped_early, [(s.id, s.text, s.tokens, s.full_tokens) for s in r.selected_sections], [s.id for s in r.omitted_sections]) for r in out}
    texts = {(c["file_id"], c["ord"]): c for c in chunks}
    rows = {}
    for s in scored:
        rows.setdefault(s["task_id"], []).append(s | texts[s["file_id"], s["ord"]])
    want = {t["task_id"]: plain(rows[t["task_id"]], t) for t in tasks}
    assert got.keys() == want.keys()
    return [(t, got[t["task_id"]], want[t["task_id"]]) for t in tasks if got[t["task_id"]] != want[t["task_id"]]], want


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_matches_the_plain_one(spark, seed):
    wrong, want = differing(spark, *cases(seed, 60))
    assert not wrong, wrong[0]
    # The cases do cut, stop early, take nothing and take everything.
    assert any(s[3] is not None for w in want.values() for s in w[3]) and any(w[2] for w in want.values()) and any(not w[4] for w in want.values())


def test_sizes_of_any_selection(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        sections = [(j, r.choice(["x", "y", "z --> q"]), "".join(r.choice(BITS) for _ in range(r.choice((0, 2, 9, 60))))) for j in range(r.randint(0, 5))]
        rows.append((i, sections, content_count(assemble("doc", [Section(f"s{o}", o, c, x, 1) for o, c, x in sections]))))
    df = spark.createDataFrame(rows, "i int, s array<struct<o:int,crumb:string,text:string>>, want int")
    size = F.transform("s", lambda x: F.struct(x["crumb"].alias("crumb"), Z.section_sizes(x["text"], x["crumb"]).alias("size")))
    assert df.filter(Z.artifact_tokens(size, Z.header_length(F.lit("doc"))) != F.col("want")).count() == 0


def test_cuts(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gam", "de", "xy", "Wort", "😀", "é"]
    rows = []
    for i in range(400):
        text = "\n".join(" ".join(r.choice(words) for _ in range(r.choice((0, 1, 3, 9, 30)))) for _ in range(r.choice((1, 3, 8, 40, 120))))
        terms, most = r.sample(["alpha", "wort", "zz", "de", "x", "xy"], r.randint(0, 3)), r.choice((20, 39, 45, 47, 60, 100, 200, 500))
        rows.append((i, text, count_tokens(text), most, terms, truncate(text, count_tokens(text), most, terms)))
    df = spark.createDataFrame(rows, "i int, text string, full int, most int, terms array<string>, want struct<text:string,tokens:int>")
    wrong = df.withColumn("got", Z.cut(F.col("text"), F.col("full"), F.col("most"), F.col("terms"))).filter(~F.col("got").eqNullSafe(F.col("want")))
    assert wrong.count() == 0


def test_index_finds_the_best_and_skips(spark):
    """Top lists of two sets of questions from one index are those of all scores, and most blocks are not read."""
    from loomspark.operators.index import build_index, top_blocks, top_sections, weights
    from loomspark.operators.ranking import bm25

    r = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    text = lambda: " ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=r.choice((0, 4, 20, 60))))
    rows = [("f", i, None if i % 97 == 0 else text() + (" zebra" if i % 150 == 3 else "")) for i in range(1200)] + [("g", i, text()) for i in range(7)]
    chunks = spark.createDataFrame(rows, "file_id string, ord int, text string").withColumn("breadcrumb", F.lit("x"))
    index = build_index(chunks, span=16)
    for n in range(2):
        tasks = [(i, "fg"[i % 5 == 0], q, [*r.sample(vocabulary, r.randint(1, 4)), *(["zebra"] if i % 2 else [])]) for i in range(12) for q in range(2)] + [(99, "f", 0, []), (98, "none", 0, ["bal"])]
        asked = spark.createDataFrame(tasks, "task_id int, file_id string, qi int, terms array<string>")
        got = sorted((x.task_id, x.qi, x.pos, x.ord, round(x.s, 6)) for x in top_sections(index, asked, 5).collect())
        best = {}
        for x in bm25(chunks, asked, boost=False, zeros=False).filter("s > 0").collect():
            best.setdefault((x.task_id, x.qi), []).append((-round(x.s, 6), x.ord))
        assert got == sorted((*key, pos, o, -s) for key, found in best.items() for pos, (s, o) in enumerate(sorted(found)[:5]))
        every = weights(index, asked).join(index.blocks, ["file_id", "term"]).select("task_id", "qi", "block").distinct().count()
        assert top_blocks(index, weights(index, asked), 5).count() < every


def test_first_of_a_ranking_needs_no_zeros(spark):
    """The first of each task's ranking from rows that score alone: tasks with many, few and no scores, files of few sections."""
    from loomspark.operators import ranking

    r = random.Random(7)
    sections = [("f", o * 3) for o in range(90)] + [("g", o) for o in range(4)]
    tasks = [(t, "g" if t % 5 == 4 else "f") for t in range(20)]
    every = [(t, f, o, round(r.random(), 1) if r.random() < (0, 0.02, 0.2, 0.9, 0.5)[t % 5] else 0.0) for t, f in tasks for g, o in sections if f == g]
    schema = "task_id int, file_id string, ord int, score double"
    want = ranking.ranked(spark.createDataFrame(every, schema)).filter("pos < 12").select("task_id", "file_id", "ord", "pos")
    some = spark.createDataFrame([x for x in every if x[3] > 0], schema)
    got = ranking.first_ranked(some, spark.createDataFrame(sections, "file_id string, ord int"), spark.createDataFrame(tasks, "task_id int, file_id string"), 12)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_index_moves_texts_once(spark):
    """Making the blocks of an index takes one exchange, of texts; their counts are made where the texts are."""
    from loomspark.operators import index as ix

    chunks = spark.createDataFrame([("f", i, f"w{i % 7} w{i % 3} other") for i in range(50)], "file_id string, ord int, text string")
    plans, keep = [], ix.store
    ix.store = lambda df, what: plans.append((what, df._jdf.queryExecution().executedPlan().toString())) or keep(df, what)
    try:
        ix.build_index(chunks, span=16)
    finally:
        ix.store = keep
    blocks = "\n".join(p for what, p in plans if what == "index-blocks")
    assert [what for what, _ in plans] == ["index-blocks", "index-files"] and blocks.count("Exchange ") == 1


def test_terms_too_many_to_be_known_everywhere(spark, monkeypatch):
    """Terms that meet the texts of their file find what terms known to every task find: small files, large ones in lots, null texts."""
    from loomspark.operators import matching

    rows = [(f"f{i % 9}", i, f"alpha beta w{i}\nalpha x" if i % 5 else None) for i in range(300)]
    chunks = spark.createDataFrame(rows, "file_id string, ord int, text string")
    asked = spark.createDataFrame([(f"f{i % 8}", t) for i in range(10) for t in ("alpha", "w1", "x", "", None)] + [("none", "x"), (None, "x")], "file_id string, term string")
    want = sorted(map(tuple, matching.term_lines(chunks, asked).collect()))
    # As many partitions as in a large run: groups of both sides must still meet, and some find nothing.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert want and sorted(map(tuple, matching.term_lines(chunks, asked, most_bytes=0).collect())) == want
        monkeypatch.setattr(matching, "LOT_BYTES", 100)
        assert sorted(map(tuple, matching.term_lines(chunks, asked, most_bytes=0).collect())) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranked_rows_carry_no_lists_of_their_task(spark):
    """What holds for a whole task is kept once a task, not with each of its sections."""
    from loomspark.operators.fold import ranked_facts

    of = lambda rows, schema: spark.createDataFrame([[r[c.split()[0]] for c in schema.split(", ")] for r in rows], schema)
    chunks, tasks, scored = cases(3, 2)
    facts, told = ranked_facts(of(scored, SCORED), of(chunks, CHUNKS), of(tasks, TASKS))
    assert not {"best", "wanted"} & set(facts.columns) and told.columns == ["task_id", "best", "wanted"] and told.count() == len(tasks)


def test_ceilings_share_a_ranking(spark, monkeypatch):
    """A task under several ceilings is ranked once, and selected as tasks of their own would be."""
    of = lambda rows, schema: spark.createDataFrame([[r[c.split()[0]] for c in schema.split(", ")] for r in rows], schema)
    chunks, tasks, scored = cases(11, 4)
    made, keep = [], C.store
    stored = lambda df, what: made.append((what, keep(df, what))) or made[-1][1]
    for m in ("loomspark.operators.fold", "loomspark.plans.compile"):
        monkeypatch.setattr(f"{m}.store", stored)
    ceilings = (45, 100, 400)
    shared = C.selections(of(scored, SCORED), of(chunks, CHUNKS), of(tasks, TASKS), ceilings)[1]
    facts = [df.count() for what, df in made if what == "facts"]
    assert facts == [len(scored)]
    several = [t | {"task_id": f"{t['task_id']}@{n}", "token_budget": n} for t in tasks for n in ceilings]
    alone = C.selections(of([s | {"task_id": f"{s['task_id']}@{n}"} for s in scored for n in ceilings], SCORED), of(chunks, CHUNKS), of(several, TASKS))[1]
    rows = lambda df: sorted(map(str, df.select("task_id", "selected", "used", "stopped", "n_sections", "budget").collect()))
    assert rows(shared) == rows(alone) and len(rows(alone)) == len(several)
