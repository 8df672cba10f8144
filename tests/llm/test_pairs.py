"""Joins, decontamination and the pipeline against brute force."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm.decontamination import clean, decontamination, fingerprint
from loomspark.llm.graph import components
from loomspark.llm.ngram_join import Parameters, boundary, exact_shingles, least_difference, near_duplicates, needed, ngram_join, parity, shingles
from loomspark.llm.packing import packing
from loomspark.llm.quality_rules import quality_rules

R = random.Random(11)
WORDS = [f"{a}{b}" for a in "bdfglmnprst" for b in ("a", "on", "ir", "ul", "est")]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def changed(t, k):
    w = t.split()
    for _ in range(k):
        w[R.randrange(len(w))] = R.choice(WORDS) + "x"
    return " ".join(w)


def corpus():
    rows = []
    for n in (5, 6, 8, 9, 12, 20, 60, 200):
        base = text(n)
        rows += [base, base.upper(), base, *[changed(base, 1) for _ in range(4)], base + " " + text(max(1, n // 9)), *[changed(base, max(1, n // 40)) for _ in range(6)]]
    hub = text(150)
    rows += [hub, *[changed(hub, R.choice((2, 3, 4, 5))) for _ in range(60)]]
    shared = text(60)
    rows += [text(40) + " " + shared + " " + text(R.randint(5, 60)) for _ in range(40)]
    rows += [None, "", " \n", "one", "one", "ONE", "two words", "x" * 5000, text(9000)]
    return list(enumerate(rows))


def brute(rows):
    sets = {i: exact_shingles(t) for i, t in rows}
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in combinations([x for x in sets.items() if x[1]], 2):
        o = len(a & b)
        if 100 * o >= 75 * (len(a) + len(b) - o):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i, _ in rows}


@pytest.mark.parametrize("p", [Parameters(), Parameters(frequent=4, most_pairs_of=2), Parameters(frequent=4, most_pairs_of=2, most_listed=5, star_rounds=0), Parameters(frequent=4, most_pairs_of=2, most_listed=3, hot=4), Parameters(frequent=4, most_pairs_of=2, most_listed=3, hot=6, most_hot=3, star_rounds=0)])
def test_ngram_join(spark, p):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame.repartition(5), p=p).collect()}
    assert got == brute(rows)


def test_ngram_join_on_odd_tables(spark):
    frame = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (1, "A b\tc d e f"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(frame).collect()} == {(3, 2, 1), (None, 2, 1), (1, 2, 1), (None, 0, None)}
    assert ngram_join(frame.limit(0)).count() == 0 and near_duplicates(frame.limit(0)).count() == 0
    twice = spark.createDataFrame([(3, "a b c d e f", "x"), (3, "a b c d e f", "x"), (4, "", "y"), (5, None, "z")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.lang) for r in near_duplicates(twice).collect()) == [(3, "x"), (4, "y"), (5, "z")]


def test_links_by_each_rows_own_text(spark):
    """A row without an id links two others; an id with two texts is linked by each of them."""
    a = text(40)
    w = a.split()
    new = ["xa", "xb", "xc", "xd"]
    b = " ".join([*w[:36], *new])
    c = " ".join([*reversed(new), *w[4:36], *new])
    assert 100 * len(exact_shingles(a) & exact_shingles(c)) < 75 * len(exact_shingles(a) | exact_shingles(c))
    got = ngram_join(spark.createDataFrame([(5, a), (None, b), (9, c)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (None, 5), (9, 5)}
    other, alone = text(30), text(25)
    rows = [(1, a), (1, other), (2, b), (3, other + " q"), (4, alone), (None, alone + " q"), (None, text(12))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 36, 1), (1, 26, 1), (2, 36, 1), (3, 27, 1), (4, 21, 4), (None, 22, 4), (None, 8, None)], key=repr)


def test_bitmaps_bound_the_difference():
    for _ in range(50):
        a, b = shingles(text(R.randint(1, 900))), shingles(text(R.randint(1, 900)))
        assert least_difference(parity(a), parity(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_needed_and_boundary():
    assert [needed(n, 75) for n in (1, 3, 4, 5, 100)] == [1, 3, 3, 4, 75]
    assert boundary({4: 10}, 100.0, Parameters()) > boundary({4: 10}, 0.0, Parameters()) >= 2


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def _items():
    return [(i, text(n)) for i, n in enumerate((6, 15, 30, 45, 59))] + [(50, None), (51, " "), (52, "only three words"), (53, "zyx")]


def plain_hits(docs, items):
    """All windows that a shingle of the item points at, and those between, one by one."""
    words = lambda t: (t or "").lower().split()
    shingle = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or [tuple(w)]
    items = {i: words(t) for i, t in items if i is not None and words(t)}
    sets = {i: set(shingle(w)) for i, w in items.items()}
    weight = {g: math.log(1 + len(items) / sum(g in s for s in sets.values())) for s in sets.values() for g in s}
    out = {}
    for d, t in docs:
        w = words(t)
        for i, iw in items.items():
            m, last = len(iw), max(len(w) - len(iw), 0)
            size = min(5, m)
            grams = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)] or [tuple(w)]
            starts = sorted({min(max(k - j, 0), last) for k, g in enumerate(grams) for j, h in enumerate(shingle(iw)) if g == h})
            starts = {*starts, *(s for a, b in zip(starts, starts[1:]) if b - a < m for s in range(a, b))}
            for s in starts:
                own = set(shingle(w[s : s + m]))
                shared = sum(weight[g] for g in own & sets[i])
                sim = shared / (sum(weight[g] for g in sets[i]) + math.log(1 + len(items)) * len(own - sets[i]))
                if sim >= 0.75 - 1e-9:
                    out[d, i] = max(out.get((d, i), (0, 0)), (round(sim, 9), -s))
    return {k: (v[0], -v[1]) for k, v in out.items()}


def found_hits(spark, docs, items):
    frame = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, item_id int, wanted_id string")
    got = decontamination(frame.repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in got}


def test_decontamination(spark):
    items = _items()
    docs = [(i, text(50) + " " + items[i % 5][1].upper() + "\n" + text(R.randint(0, 80))) for i in range(10)]
    docs += [(20, text(30) + " " + changed(items[4][1], 1) + " " + text(20)), (21, text(300)), (22, None), (23, ""), (24, "Only three words"), (25, "these are only three words"), (26, " ".join(items[4][1].split()[:25]) + " " + text(40)), (3, "z " + items[0][1])]
    docs += [(None, "q " + items[2][1]), (30, "here are only three words in a longer text zyx"), (31, text(20_000) + " " + items[3][1] + " " + text(500) + " " + items[3][1]), (32, "zyx"), (33, " ".join(items[4][1].split()[:55]))]
    got = found_hits(spark, docs, items)
    assert got == plain_hits(docs, items)
    assert set(got) >= {(i, i % 5) for i in range(10)} | {(24, 52), (25, 52), (30, 52), (30, 53), (31, 3), (32, 53), (33, 4), (3, 0), (None, 2)} and got[0, 0] == (1.0, 50) and got[31, 3][1] == 20_000
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination(frame.limit(0), bench).count() == 0 and decontamination(frame, bench.limit(0)).count() == 0


def test_decontamination_of_changed_passages(spark):
    """Words put in, left out and replaced; shingles that many items share; passages told twice."""
    common = text(12)
    items = [(i, (common + " " if i % 2 else "") + text(R.randint(8, 50))) for i in range(30)]
    docs = []
    for n in range(300):
        w = R.choice(items)[1].split()
        for _ in range(R.randint(0, 3)):
            at = R.choice((0, 1, 2, len(w) - 1, R.randrange(len(w))))
            kind = R.randrange(3)
            w[at : at + (kind > 0)] = [R.choice(WORDS)] if kind < 2 else []
            if not w:
                w = ["x"]
        parts = [text(R.randint(0, 30)), " ".join(w), R.choice((common, text(5), " ".join(w[:20])))]
        docs.append((n, " ".join(parts)))
    got, want = found_hits(spark, docs, items), plain_hits(docs, items)
    assert got == want and 100 < len(want)


def test_clean_keeps_columns_and_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    rows = [(1, "x one two three four five six y", 1, "a"), (1, "other", 2, "b"), (2, None, 3, "c"), (None, "", 4, "d"), (None, "one two three four five six", 5, "e"), (3, "fine", 6, "f"), (3, "fine", 6, "f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, hit_0 int, `__id` string")
    assert sorted(r.hit_0 for r in clean(frame, items).collect()) == [3, 6, 6] and clean(frame, items).columns == frame.columns
    assert clean(frame.limit(0), items).count() == 0 and clean(frame, items.limit(0)).count() == 7


def test_near_duplicates_keep_columns(spark):
    rows = [(2, "a b c d e f g", "x"), (1, "A b c d e f g", "y"), (5, None, "z"), (None, "", "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `__id` string").withColumn("id_0", F.col("doc_id"))
    got = near_duplicates(frame)
    assert got.columns == frame.columns and sorted(r["__id"] for r in got.collect()) == ["n", "y", "z"]


def test_fingerprints_of_near_texts_are_near(spark):
    base = text(40)
    rows = spark.createDataFrame([(base, changed(base, 1)) for _ in range(50)], "a string, b string")
    got = rows.select(F.bit_count(fingerprint(F.split("a", " ")).bitwiseXOR(fingerprint(F.split("b", " ")))).alias("d")).collect()
    assert max(r.d for r in got) <= 15


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns in, nothing but what the stages keep out; an empty table gives no piece."""
    good = "the rain in the town fell on a stone and it was cold for all of us in there until the night came over the hills"
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, good.upper(), "en", None, None), (None, None, None, None, None), (3, "", "", "", 0), (4, good + " one two three four five six seven", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("rows", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).withColumns({c: F.lit(1) for c in ("score", "quality", "id_0", "hit_0", "sequence_id")}).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    assert {r.doc_id for r in out} == {1} and sum(r.length for r in out) == out[0].doc_tokens
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_against_plain_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = set(rows)
    for (name, stage), plain in zip(corpus_pipeline.STAGES, ("toxicity", "quality", "join", "leaks", None), strict=True):
        df = stage(spark, docs, data)
        if plain is None:
            want = {r.doc_id for r in packing(docs).select("doc_id").distinct().collect()}
            assert want == kept
            break
        assert df.columns == docs.columns
        df.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= kept
        if plain == "toxicity":
            from loomspark.llm.queries import op1_toxicity

            assert now == {r.doc_id for r in op1_toxicity(spark, data).filter("predicted = 0").collect()}
        if plain == "quality":
            from tests.llm.test_text_operators import plain_quality

            for i in now:
                n_words, _, n_symbols, _, n_repeat = plain_quality(rows[i])
                assert n_words >= 10 and 100 * n_repeat <= 20 * n_words and n_symbols <= 0.1 * n_words
        elif plain == "join":
            assert now == {i for i, (_, c) in brute([(i, rows[i]) for i in sorted(kept)]).items() if i == c}
        elif plain == "leaks":
            items = [exact_shingles(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            held = {i for i in kept if any(s <= exact_shingles(rows[i]) for s in items if s)}
            assert not held & now and len(kept - now) <= len(held) + 5
        kept = now
    assert corpus_pipeline.run(spark, data).count() > 0
    assert quality_rules(docs).filter("not quality.kept").count() == 0
