"""Clustering and near-dedup of vectors, and the divergence of sources, against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomspark.llm.centroids import Parameters as Centroids
from loomspark.llm.centroids import Round, assigned, centroid_clusters, squared
from loomspark.llm.divergence import Parameters as Audit
from loomspark.llm.divergence import divergence, segments, shares
from loomspark.llm.embedding_dedup import Budgets, Parameters, embedding_dedup, rotated

R = np.random.default_rng(5)


# --- clustering ------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k=16, rounds=3, width=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        cents = [[sum(x) // len(of[j]) for x in zip(*of[j], strict=True)] if of[j] else c for j, c in enumerate(cents)]
    done = [(i, *near(v)) for i, v in kept]
    spent = Counter()
    for _, d, j in done:
        spent[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, spent[j], sum(spent.values()), sha[j]) for i, d, j in done), key=repr)


def got_clusters(df, p=Centroids()):
    return sorted((tuple(r) for r in centroid_clusters(df, p=p).collect()), key=repr)


def test_clusters_match_brute_force(spark):
    base = R.normal(size=(6, 64))
    rows = [(i, (base[i % 6] + R.normal(size=64) * 0.4 * (i % 3)).tolist()) for i in range(400)]
    # Few values a component make many equal distances.
    rows += [(1000 + i, (R.integers(0, 2, 64) / 64.0).tolist()) for i in range(60)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)] + [(2000, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert got_clusters(df) == plain_clusters(rows)


@pytest.mark.parametrize("spread", [0, 1, 3])
def test_bounds_skip_and_keep_ties(spread):
    """Rounds with bounds give what all distances give, on grids full of ties, and look at fewer."""
    x = R.integers(-spread - 1, spread + 2, (3000, 4)).astype(np.int32)
    cents = x[R.choice(len(x), 12)].astype(np.int64)
    state, looked = (np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 12))), 0
    moved = None
    for step in range(5):
        own, far, low, best, n = assigned(x, *state, Round(cents, moved, step == 4))
        every = np.stack([squared(x, c) for c in cents], axis=1)
        assert (own == every.argmin(axis=1)).all()
        assert (far**2 >= every.min(axis=1)).all() and (low**2 <= every).all()
        assert (best[best >= 0] == every.min(axis=1)[best >= 0]).all() and (step < 4 or (best >= 0).all())
        looked += n if step else 0
        then = np.array([x[own == j].astype(np.int64).sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else cents[j] for j in range(12)])
        moved, cents, state = np.sqrt(((then - cents) ** 2).sum(axis=1)) * (1 + 1e-12), then, (own, far, low)
    assert looked < 4 * x.shape[0] * 12


def test_clusters_of_odd_tables(spark):
    good = [float(x) for x in R.normal(size=64)]
    rows = [(1, good), (1, good), (None, good), (2, None), (3, good[:63]), (4, [*good[:63], None]), (5, [*good[:63], float("nan")]), (6, [*good[:63], float("inf")]), (7, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    want = plain_clusters(rows)
    assert got_clusters(df) == want and len(want) == 3
    none = centroid_clusters(df.limit(0))
    assert none.count() == 0 and none.columns == centroid_clusters(df).columns
    assert centroid_clusters(df.filter("vec_id > 2")).count() == 0


# --- near-dedup ------------------------------------------------------------------------------------------------------


def plain_links(rows, least=0.93):
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, up = Counter(), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ok):
        for b in ok[n + 1 :]:
            x, y = rows[a], rows[b]
            if x[2] == y[2] and len(x[1]) == len(y[1]):
                s, t = np.array(x[1], np.float64), np.array(y[1], np.float64)
                if s @ t / math.sqrt((s @ s) * (t @ t)) >= least:
                    links[a] += 1
                    links[b] += 1
                    up[root(b)] = root(a)
    ids = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        ids[root(k)].append(i)
    small = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, links[k], small[root(k)], i == small[root(k)]) for k, (i, _, _) in enumerate(rows)), key=repr)


def got_links(df, p=Parameters()):
    return sorted((tuple(r) for r in embedding_dedup(df, p=p).collect()), key=repr)


def turned(v, cos):
    """A vector of any length at that cosine to v."""
    w = R.normal(size=len(v))
    w -= (w @ v) / (v @ v) * v
    return (cos * v / np.linalg.norm(v) + math.sqrt(1 - cos * cos) * w / np.linalg.norm(w)) * R.uniform(0.5, 3)


def vectors(width=64):
    rows = []
    for label in (0, 1):
        for _ in range(25):
            v = R.normal(size=width)
            rows += [(v, label), *[(turned(v, c), label) for c in (0.9295, 0.93005, 0.9301, 0.94, 0.96, 0.99)]]
        v = R.normal(size=width)
        rows += [(turned(v, 0.965), label) for _ in range(60)] + [(v, label)] * 9
        for _ in range(30):
            # A chain, linked from each to the next.
            v = turned(v, 0.935)
            rows.append((v, label))
        rows += [(R.normal(size=width), label) for _ in range(80)]
    R.shuffle(ids := np.arange(len(rows)))
    return [(int(i), [float(np.float32(x)) for x in v], label) for i, (v, label) in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("p", [Parameters(), Parameters(lot=7, rows_a_task=40, hot=3), Parameters(block=16, grid=2), Parameters(block=5, grid=5, width=1.0)])
def test_links_match_brute_force(spark, p):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    want = plain_links(rows)
    assert got_links(df, p) == want and sum(x[1] for x in want) > 3000


def test_links_of_odd_tables(spark):
    a, b = [float(x) for x in R.normal(size=8)], [1.0, 0.0, 0.0]
    rows = [(3, a, 1), (3, a, 1), (None, a, 1), (9, [2 * x for x in a], 1), (4, a, None), (5, None, 1), (6, [], 1), (7, [0.0] * 8, 1), (8, [*a[:7], None], 1), (10, [*a[:7], float("nan")], 1),
            (11, [*a[:7], float("-inf")], 1), (12, b, 1), (13, [-0.0 + x for x in b], 1), (14, [1.0, -0.0, 0.0], 1), (15, a, 2), (None, b, 5), (16, [5.0], 1), (17, [0.1], 1), (18, [-5.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, own_0 int, node string")
    assert got_links(df) == plain_links(rows)
    assert embedding_dedup(df.limit(0)).count() == 0 and embedding_dedup(df.filter("vec_id in (5, 7)")).count() == 2
    huge = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [1e200, -1e200], 1)]
    assert got_links(spark.createDataFrame(huge, "vec_id long, embedding array<double>, label int")) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_budgets_are_safe():
    """Whole numbers never rule out what is near, nor take in what isn't."""
    t, v = Budgets.of(64, Parameters()), R.normal(size=64)
    for cos in np.linspace(0.92, 0.94, 400):
        w = turned(v, float(cos))
        q = rotated(np.stack([v, w]), Parameters()).astype(np.int64)
        parts = np.add.reduceat((q[0] - q[1]) ** 2, t.starts[:-1])
        if cos >= 0.93:
            assert parts.sum() <= t.maybe and (parts <= np.array(t.blocks)).any()
        else:
            assert parts.sum() > t.surely


# --- divergence ------------------------------------------------------------------------------------------------------


def plain_divergence(rows, least, top):
    import re

    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs = [(s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))) for t, x, s in rows if x == lang]
        df = Counter(w for _, ws in docs for w in set(ws))
        kept = sorted((w for w in df if df[w] >= least), key=lambda w: w.encode())
        count = defaultdict(Counter)
        for s, ws in docs:
            count[s].update(w for w in ws if w in df and df[w] >= least)
        whole = sum(count.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        ps = {s: {w: share(c, w) for w in kept} for s, c in count.items()}
        q = {w: share(whole, w) for w in kept}
        for s in ps:
            pairs = [(sum(f(ps[s][w], ps[o][w]) for w in kept), o) for o in ps if o != s]
            terms = [(f(ps[s][w], q[w]), w) for w in kept if count[s][w] and ps[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ordered, 1) if part == "pair" or k <= top]
    return sorted(out)


def text_rows():
    rnd = random.Random(3)
    vocab = [a + b for a in ("ka", "Mö", "日本", "zu", "é", "𝒳") for b in ("", "n", "ST", "ß", "ﬀ", "")]
    rows = []
    for i in range(300):
        pool = vocab[: rnd.randint(3, len(vocab))]
        rows.append((rnd.choice([" ", "-", "9", "\n", "_"]).join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "ä", None, "Z"])))
    return [*rows, (None, "en", "bare"), ("", "", ""), ("one two", "de", "only"), (None, "xx", "p"), ("", "xx", "q"), ("1 2 [`{ \x7f", "xx", "q"), rows[0], rows[0]]


@pytest.mark.parametrize("p", [Audit(), Audit(least_documents=2, chunk_terms=3, top_terms=4, segment=9)])
def test_divergence_matches_brute_force(spark, p):
    rows = text_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, term int").repartition(4)
    got = sorted(tuple(r) for r in divergence(df, p=p).collect())
    assert got == plain_divergence(rows, p.least_documents, p.top_terms) and len(got) > 100
    assert divergence(df.limit(0)).count() == 0


def test_long_texts_are_cut_between_terms():
    raw = "aB ccc,dd é日本語 x".encode() * 20
    assert b" ".join(segments(raw, 7)).split() == b" ".join(segments(raw, 10**6)).split()


def test_shares_are_exact_at_any_size():
    for n, total, v in ((0, 0, 1), (7, 9, 3), (10**13, 10**14, 10**8), (2**40, 2**47, 12345)):
        assert shares(np.array([n]), total, v)[0] == 1 + 10**9 * (n + 2) // (total + 2 * v)
