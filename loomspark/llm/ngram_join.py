"""N-gram Jaccard join, size-aware: subsets of small sets are enumerated, inverted lists of large sets are scanned.

Shingles have one order for all sets: rare before frequent ones, and by hash among these.  With a needed similarity t, sets
of sizes n <= m that are linked share at least a = ceil(t * m) shingles, so any c <= a of the shared ones lie in the first
n - a + c shingles of either.

* Small sets (n <= boundary) are keyed by all subsets of two shingles of that prefix (c = 2): a linked pair has a key in common.
* Large sets are keyed by the single shingles of theirs (c = 1), an inverted list; so are the small sets near the boundary,
  which may be linked with large ones.  The boundary is where the keys and the expected scans together are fewest.

Sets that share a key are candidates.  Copies are one set from the start.  Parity bitmaps bound the difference of a pair from
below without its shingles; what is left is verified on the texts.  Keys of frequent shingles, which only sets of mostly
frequent shingles have, go another way: their sets are first compared with one of them each, and only sets that are in
different components after that are compared with each other, so a large group of near copies costs no pair for each two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import checked_broadcast, drop_stored, free_name, most_frequent, release_memory, small_batches, store
from loomspark.llm.graph import components

_U = np.uint64
MIX = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


@dataclass(frozen=True)
class Parameters:
    words: int = 5
    #: Needed similarity, in hundredths.
    percent: int = 75
    #: The boundary is looked for up to this size.
    most_small: int = 64
    #: A shingle in so many documents is frequent; of these the most frequent are known to every task.
    frequent: int = 30
    most_frequent: int = 200_000
    #: Keys a task sorts at once, and sets of one key that are all compared with each other.
    keys_a_task: int = 500_000
    most_pairs_of: int = 8
    #: A candidate pair costs as much as so many keys.
    pair_cost: float = 20.0
    #: Bytes of ids of documents that are broadcast at most; more are joined by a shuffle.
    most_broadcast: int = 64_000_000
    star_rounds: int = 1
    #: Shingles that a verifying task keeps for the next pair.
    most_held: int = 100_000
    #: Lists of up to so many sets are compared in one task, longer ones by a join of their rows; and entries of such a task.
    most_listed: int = 4096
    entries_a_task: int = 100_000
    #: A list or a set with more rows than this in a join is hot: lists are met where their rows are, sets are dealt out in lots of
    #: that many; and hot lists that every task knows at most.
    hot: int = 5000
    most_hot: int = 100_000


# --- sets ------------------------------------------------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes.lower and bytes.split know A-Z and the ASCII blanks only, which is what is wanted."""
    return text.encode().lower().split() if text else []


#: A word's hash is the sum of its bytes' random numbers times powers of an odd base, modulo 2**64.
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=_U)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 16
_BLANKS = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses."""
    steps = lambda x: np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, x, _U)]), dtype=_U)
    return steps(_U(_BASE)), steps(_U(pow(_BASE, -1, 1 << 64)))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a lower-cased text."""
    out = []
    at = 0
    while at < len(raw):
        stop = len(raw)
        if stop - at > _SEGMENT:
            # A segment ends at a blank; a word longer than a segment is one of its own.
            cut = max(raw.rfind(c, at, at + _SEGMENT) for c in _BLANKS)
            if cut <= at:
                cut = min((k for c in _BLANKS if (k := raw.find(c, at + 1)) >= 0), default=len(raw))
            stop = cut
        b = np.frombuffer(raw, np.uint8, stop - at, at)
        at = stop
        power, inverse = _powers(max(_SEGMENT, 1 << (len(b) - 1).bit_length()))
        letter = np.concatenate([[False], ~_BLANK[b], [False]])
        edges = np.flatnonzero(letter[1:] != letter[:-1])
        sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[b] * power[: len(b)], dtype=_U)])
        starts = edges[::2]
        out.append((sums[edges[1::2]] - sums[starts]) * inverse[starts])
    return np.concatenate(out) if out else np.zeros(0, _U)


def distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; of all words as one where there are fewer than k."""
    a = word_hashes(text.encode().lower()) if text else np.zeros(0, _U)
    if not len(a):
        return a
    k = min(k, len(a))
    n = len(a) - k + 1
    # The number of words goes in, so that fewer words make another shingle.
    h = a[:n] * MIX[0] + _U(k)
    for i in range(1, k):
        h ^= h >> _U(31)
        h += a[i : n + i]
        h *= MIX[i % len(MIX)]
    h ^= h >> _U(29)
    h *= MIX[0]
    h ^= h >> _U(32)
    return distinct(h)


def exact_shingles(text: str | None, k: int = 5) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


#: Words of 64 bits that every bitmap has at least, and that bitmaps are folded to where lists are compared.
SKETCH = 16


def bitmap_bits(n: int) -> int:
    return max(64 * SKETCH, 1 << (2 * n - 1).bit_length())


def parity(s: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles fall on i."""
    bits = bitmap_bits(len(s))
    return np.packbits(np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def least_difference(a: bytes, b: bytes) -> int:
    """Two sets differ in at least so many shingles; bitmaps of different sizes are folded first."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(_ONES[x ^ y].sum())


#: The id goes through Python as text, so that nulls don't turn whole numbers into floats.  copy is a hash of the text, by which
#: a class finds a text of its own, whatever the ids of its rows are.
SETS = "doc_id string, copy long, n long, node long, bitmap binary, shingle long, found long"


def sets_of(parts: Iterator[pd.DataFrame], p: Parameters) -> Iterator[pd.DataFrame]:
    """A row a document: size, hash and bitmap of its set; and a row a shingle that is found more than once in the task."""
    counts: dict[int, int] = {}
    names = [c.split()[0] for c in SETS.split(", ")]
    for pdf in parts:
        for at in range(0, len(pdf), 1000):
            part = pdf.iloc[at : at + 1000]
            sets = [shingles(t, p.words) for t in part["text"]]
            # Nullable integers from the start: through floats the hashes would lose bits.
            node = pd.array([xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63) if len(s) else None for s in sets], dtype="Int64")
            none = pd.array([None] * len(sets), dtype="Int64")
            yield pd.DataFrame({"doc_id": list(part["doc_id"]), "copy": part["copy"].to_numpy(np.int64), "n": [len(s) for s in sets], "node": node, "bitmap": [parity(s) if len(s) else None for s in sets], "shingle": none, "found": none}, columns=names)
            seen, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, _U), return_counts=True)
            many = n > 1
            for h, k in zip(seen[many].tolist(), n[many].tolist(), strict=True):
                counts[h] = counts.get(h, 0) + k
            if len(counts) > 150_000:
                # What stays rare in the task goes, with an error of one for each time.
                counts = {h: k - 2 for h, k in counts.items() if k > 2}
    if counts:
        order = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: p.most_frequent]
        none = pd.array([None] * len(order), dtype="Int64")
        yield pd.DataFrame({"doc_id": None, "copy": 0, "n": 0, "node": none, "bitmap": None, "shingle": pd.array([h - (1 << 63) for h, _ in order], dtype="Int64"), "found": pd.array([k for _, k in order], dtype="Int64")}, columns=names)
    counts.clear()
    release_memory()


# --- keys ------------------------------------------------------------------------------------------------------------


def needed(n: int, percent: int) -> int:
    """Shingles that a set of size n shares at least with any set it is linked with."""
    return max(1, -(-percent * n // 100))


def key_count(n: int, small: bool, percent: int) -> int:
    a = needed(n, percent)
    return math.comb(n - a + 2, 2) if small else n - a + 1


def boundary(sizes: dict[int, int], scans: float, p: Parameters) -> int:
    """The size up to which sets count as small: the cheapest by keys made and list entries scanned.

    sizes: sets by size, those above most_small under most_small + 1.  scans: entries read for a key of an inverted list; a
    subset of two shingles is found elsewhere so rarely that its scans are left out.
    """
    best = (math.inf, 2)
    for b in range(2, p.most_small + 1):
        near = -(-p.percent * (b + 1) // 100)
        cost = sum(k * key_count(n, True, p.percent) for n, k in sizes.items() if 2 < n <= b) + sum(k * key_count(n, False, p.percent) * (1 + scans) for n, k in sizes.items() if n >= near)
        best = min(best, (cost, b))
    return best[1]


class Frequent:
    """Membership in the frequent shingles, most of it by one look in a table of bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.hashes >> _U(44)).astype(np.int64)] = True

    def of(self, s: np.ndarray) -> np.ndarray:
        out = self.table[(s >> _U(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.hashes, s[at]), len(self.hashes) - 1)
            out[at] = self.hashes[place] == s[at]
        return out


def keys_of(s: np.ndarray, frequent: Frequent, bound: int, p: Parameters) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of a set, which are of frequent shingles only, and how many of its shingles are rare."""
    n = len(s)
    if n < 3:
        # Such sets are linked with copies of themselves only.
        return np.zeros(0, _U), np.zeros(0, bool), n
    often = frequent.of(s)
    order = np.concatenate([s[~often], s[often]])
    n_rare, a = n - int(often.sum()), needed(n, p.percent)
    keys, hot = [], []
    if n <= bound:
        first = order[: n - a + 2]
        i, j = np.triu_indices(len(first), 1)
        keys.append((first[i] * MIX[1]) ^ (first[j] * MIX[2]))
        hot.append(i >= n_rare)
    if 100 * n >= p.percent * (bound + 1):
        keys.append(order[: n - a + 1])
        hot.append(np.arange(n - a + 1) >= n_rare)
    return np.concatenate(keys), np.concatenate(hot), n_rare


RECORD = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<i4"), ("rare", "<i4")])


def packed_keys(parts: Iterator[pd.DataFrame], frequent: Frequent, bound: int, n_buckets: int, p: Parameters) -> Iterator[pd.DataFrame]:
    """(bucket, records): the keys of all sets, dealt out by key; those of frequent shingles, under negative numbers, by set."""
    held: list[np.ndarray] = []
    size = 0
    seen: set[int] = set()

    def flush() -> pd.DataFrame:
        every, hot = np.concatenate([h for h, _ in held]), np.concatenate([h for _, h in held])
        bucket = (every["key"] >> _U(20)) % _U(n_buckets)
        spread = (every["node"].view(_U) >> _U(20)) % _U(n_buckets)
        bucket = np.where(hot, -1 - spread.astype(np.int64), bucket.astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        runs = np.split(every[order], cut)
        return pd.DataFrame({"bucket": bucket[order][np.concatenate([[0], cut])], "records": [r.tobytes() for r in runs]})

    for pdf in parts:
        for t in pdf["text"]:
            s = shingles(t, p.words)
            if len(s) < 3:
                continue
            node = xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)
            if node in seen:
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen.add(node)
            keys, hot, rare = keys_of(s, frequent, bound, p)
            r = np.empty(len(keys), RECORD)
            r["key"], r["node"], r["n"], r["rare"] = keys, node, len(s), rare
            held.append((r, hot))
            size += len(r)
            if size > 250_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()
    held.clear()
    release_memory()


FOUND = "kind int, key long, a long, b long"
PAIR, LISTED = 0, 1


def candidates(bucket: pd.DataFrame, p: Parameters) -> pd.DataFrame:
    """Pairs (a < b) of a bucket's lists by kind PAIR; entries (key, a, b: rare shingles) of lists that are too long for that by kind LISTED."""
    r = np.unique(np.frombuffer(b"".join(bucket["records"]), RECORD))
    if bucket["bucket"].iloc[0] < 0:
        return pd.DataFrame({"kind": LISTED, "key": r["key"].view(np.int64), "a": r["node"], "b": r["rare"]})
    edges = np.flatnonzero(np.concatenate([[True], r["key"][1:] != r["key"][:-1], [True]]))
    sizes = np.diff(edges)
    pairs: list[np.ndarray] = []
    long: list[np.ndarray] = []
    for k in np.unique(sizes[sizes > 1]).tolist():
        starts = edges[:-1][sizes == k]
        if k > p.most_pairs_of:
            long += [r[s : s + k] for s in starts]
            continue
        i, j = np.triu_indices(k, 1)
        # In blocks, so that lists of many entries don't make all their pairs at once.
        for at in range(0, len(starts), max(1, 100_000 // len(i))):
            x = r[starts[at : at + max(1, 100_000 // len(i)), None] + i]
            y = r[starts[at : at + max(1, 100_000 // len(i)), None] + j]
            near = 100 * np.minimum(x["n"], y["n"]).astype(np.int64) >= p.percent * np.maximum(x["n"], y["n"]).astype(np.int64)
            a, b = x["node"][near], y["node"][near]
            pairs.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))
    found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    out = [pd.DataFrame({"kind": PAIR, "key": 0, "a": found[:, 0], "b": found[:, 1]})]
    if long:
        rest = np.concatenate(long)
        out.append(pd.DataFrame({"kind": LISTED, "key": rest["key"].view(np.int64), "a": rest["node"], "b": rest["rare"]}))
    return pd.concat(out, ignore_index=True)


# --- links -----------------------------------------------------------------------------------------------------------


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, p: Parameters) -> DataFrame:
    """The pairs (a, b) of nodes that are linked: by sizes, then bitmaps, then the shingles of the texts."""
    of = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"m_{x}"), F.col("rep").alias(f"rep_{x}"))
    sized = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    sized = sized.filter(100 * F.least("n_a", "n_b") >= p.percent * F.greatest("n_a", "n_b"))

    @F.pandas_udf("boolean")
    def may_link(n_a: pd.Series, n_b: pd.Series, m_a: pd.Series, m_b: pd.Series) -> pd.Series:
        # |A ^ B| = |A| + |B| - 2 o, and o / (|A| + |B| - o) must reach the similarity.
        return pd.Series([(100 + p.percent) * least_difference(x, y) <= (100 - p.percent) * (i + j) for i, j, x, y in zip(n_a, n_b, m_a, m_b, strict=True)], dtype=bool)

    left = store(sized.filter(may_link("n_a", "n_b", "m_a", "m_b")).select("a", "b", "rep_a", "rep_b"), "pairs")
    ids = checked_broadcast(left.select(F.col("rep_a").alias("rep")).union(left.select("rep_b")).distinct(), p.most_broadcast)
    texts = store(docs.join(ids, F.xxhash64(docs["text"]) == ids["rep"]).groupBy("rep").agg(F.array_min(F.collect_set("text")).alias("text")), "texts")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        held: dict[str, set] = {}
        size = 0

        def of(t: str) -> set:
            nonlocal size
            if t not in held:
                if size > p.most_held:
                    held.clear()
                    size = 0
                held[t] = exact_shingles(t, p.words)
                size += len(held[t])
            return held[t]

        def one(x: str, y: str) -> bool:
            s, t = of(x), of(y)
            o = len(s & t)
            return 100 * o >= p.percent * (len(s) + len(t) - o)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    def with_text(pairs: DataFrame, x: str, other: str) -> DataFrame:
        """pairs with the text of one side; a set with very many pairs is dealt out in lots, each with a copy of its text."""
        rep, lot = f"rep_{x}", f"lot_{x}"
        lots = checked_broadcast(left.groupBy(rep).agg(F.ceil(F.count("*") / p.hot).alias("lots")).filter("lots > 1"), p.most_broadcast)
        text = texts.select(F.col("rep").alias(rep), F.col("text").alias(f"t_{x}")).join(lots, rep, "left")
        text = text.withColumn(lot, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("lots", F.lit(1).cast("long")) - 1))).drop("lots")
        dealt = pairs.join(lots, rep, "left").withColumn(lot, F.coalesce(F.pmod(F.xxhash64(other), F.col("lots")), F.lit(0).cast("long"))).drop("lots")
        return dealt.join(text, [rep, lot]).drop(lot)

    # Sorted by one side within a partition, so that its set is built once for all its pairs.
    out = store(with_text(with_text(left, "b", "a"), "a", "b").filter(linked("t_a", "t_b")).select("a", "b"), "linked")
    drop_stored(docs.sparkSession, left, texts)
    return out


def _by_list(rows: DataFrame, facts: DataFrame, p: Parameters) -> DataFrame:
    """rows joined by key to facts (key, k, …), of which k says how many rows a list has.

    The rows of hot lists stay where they are: these lists are few, so all tasks know their facts.  The others are dealt by key.
    """
    hot = F.broadcast(most_frequent(facts.filter(F.col("k") > p.hot), "k", p.most_hot))
    rest = facts.join(hot.select("key"), "key", "left_anti")
    return rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(rest, "key"))


def _stars(listed: DataFrame, labels: DataFrame | None, p: Parameters) -> DataFrame:
    """Pairs of each list's middle with its others; given labels, of the middle of all but the first's component with the others.

    The middle is the set with the fewest rare shingles: copies are changed here and there, which makes new shingles, and what
    they were made from has none of these.
    """
    if labels is None:
        middle = store(listed.groupBy("key").agg(F.min(F.struct("rare", "a")).alias("m"), F.count("*").alias("k")).select("key", "k", F.col("m.a").alias("b")), "middles")
        other = _by_list(listed, middle, p).filter("a != b")
        held = [middle]
    else:
        rows = store(_labelled(listed, labels), "labelled")
        first = store(rows.groupBy("key").agg(F.min(F.struct("rare", "a", "label")).alias("m"), F.count("*").alias("k")).select("key", "k", F.col("m.label").alias("l0")), "firsts")
        apart = _by_list(rows, first, p).filter("label != l0").drop("k")
        middle = store(apart.groupBy("key").agg(F.min(F.struct("rare", "a", "label")).alias("m")).join(first.select("key", "k"), "key").select("key", "k", F.col("m.a").alias("b"), F.col("m.label").alias("l1")), "middles")
        other = _by_list(rows, middle, p).filter("label != l1")
        held = [rows, first, middle]
    out = store(other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    drop_stored(listed.sparkSession, *held)
    return out


def _labelled(listed: DataFrame, labels: DataFrame) -> DataFrame:
    return listed.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))


def _members(listed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, n, sketch) of the listed sets: size, and the bitmap folded to 1024 bits."""

    @F.pandas_udf("binary")
    def folded(bitmaps: pd.Series) -> pd.Series:
        out = []
        for raw in bitmaps:
            x = np.frombuffer(raw, np.uint64)
            while len(x) > SKETCH:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            out.append(x.tobytes())
        return pd.Series(out, dtype="object")

    nodes = listed.select("a").distinct().join(classes.select(F.col("node").alias("a"), "n", "bitmap"), "a")
    return nodes.select("a", "n", folded("bitmap").alias("sketch"))


def _pairs_of_lists(pdf: pd.DataFrame, p: Parameters) -> pd.DataFrame:
    """Pairs (a < b) of different components in one list (key), but for those that sizes or sketches rule out."""
    pdf = pdf.sort_values(["key", "a"], kind="stable")
    key, node, label, n = (pdf[c].to_numpy(np.int64) for c in ("key", "a", "label", "n"))
    sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(-1, SKETCH)
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(edges)
    found = [np.zeros((0, 2), np.int64)]

    def judge(i: np.ndarray, j: np.ndarray) -> None:
        keep = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= p.percent * np.maximum(n[i], n[j]))
        i, j = i[keep], j[keep]
        differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        may = (100 + p.percent) * differ <= (100 - p.percent) * (n[i] + n[j])
        if may.any():
            found.append(np.unique(np.stack([node[i[may]], node[j[may]]], axis=1), axis=0))

    for k in np.unique(sizes[sizes > 1]).tolist():
        starts = edges[:-1][sizes == k]
        for row in range(k - 1):
            # One set of each list of this size against those behind it: memory grows with the lists, not with their squares.
            step = max(1, 50_000 // (k - 1 - row))
            for at in range(0, len(starts), step):
                s = starts[at : at + step, None]
                j = s + np.arange(row + 1, k)
                judge(np.broadcast_to(s + row, j.shape).ravel(), j.ravel())
    out = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})


def _rest(listed: DataFrame, labels: DataFrame, members: DataFrame, p: Parameters) -> DataFrame:
    """All pairs of a list's sets that are in different components, but for those that sizes or sketches rule out."""
    rows = store(_labelled(listed.select("key", "a"), labels), "labelled")
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    # Of each list that is in several components yet, its size and its largest component.
    sizes = store(parts.groupBy("key").agg(F.sum("n").alias("k"), F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("labels")).filter("labels > 1").select("key", "k", F.col("m.label").alias("most")), "apart")
    full = _by_list(rows, sizes, p).join(members, "a")
    n_tasks = 1 + listed.count() // p.entries_a_task
    short = full.filter(F.col("k") <= p.most_listed).withColumn("g", F.pmod(F.xxhash64("key"), F.lit(n_tasks)))
    pairs = short.groupBy("g").applyInPandas(lambda pdf: _pairs_of_lists(pdf, p), "a long, b long")
    # A list without end is never brought together.  The sets outside of its largest component meet all others of about their
    # size, in bands a factor of the similarity wide: what is linked is in the same band or in neighbouring ones.
    words = [F.call_function("conv", F.hex(F.substring("sketch", 8 * i + 1, 8)), F.lit(16), F.lit(-10)).cast("long").alias(f"x{i}") for i in range(SKETCH)]
    band = F.floor(F.log(F.col("n")) / math.log(100 / p.percent) + 1e-9).alias("band")
    long = full.filter(F.col("k") > p.most_listed).select("key", "a", "label", "most", "n", band, *words)
    outer = long.filter("label != most").select("*", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("near_band")).drop("band", "most")
    inner = long.select("key", F.col("band").alias("near_band"), *[F.col(c).alias(f"{c}_b") for c in ("a", "label", "most", "n", *(f"x{i}" for i in range(SKETCH)))])
    differ = F.lit(0)
    for i in range(SKETCH):
        differ = differ + F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"x{i}_b")))
    may = (100 + p.percent) * differ <= (100 - p.percent) * (F.col("n") + F.col("n_b"))
    near = 100 * F.least("n", "n_b") >= p.percent * F.greatest("n", "n_b")
    # Two sets outside of the largest component meet once.
    apart = (F.col("label_b") == F.col("most_b")) | (F.col("label") < F.col("label_b"))
    joined = outer.join(inner, ["key", "near_band"]).filter(apart & near & may)
    out = store(pairs.union(joined.select(F.least("a", "a_b").alias("a"), F.greatest("a", "a_b").alias("b"))).distinct(), "rest")
    drop_stored(listed.sparkSession, rows, sizes)
    return out


def ngram_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, n_shingles, component_id): the component is the smallest doc_id reachable by links, the own one included.

    Sets are compared by 64-bit hashes until the last step, which compares shingles.  A null, empty or blank text has no
    shingle and is linked with nothing; fewer than five words are one shingle.  Rows that repeat, even under one doc_id,
    are copies and stay; different texts under one doc_id, or under none, are linked by what each of them holds.  A null doc_id is
    left out of the minimum, but its links count.  Other columns don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    sets = store(named.mapInPandas(lambda parts: sets_of(parts, p), SETS).withColumn("doc_id", F.col("doc_id").cast(kind)), "sets")
    rows = sets.filter("shingle is null")
    classes = store(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("copy").alias("rep"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "classes")
    often = sets.filter("shingle is not null").groupBy("shingle").agg(F.sum("found").alias("found")).filter(F.col("found") >= p.frequent)
    hot = most_frequent(often, "found", p.most_frequent).select("shingle").toPandas()["shingle"].to_numpy(np.int64)
    frequent = Frequent(hot.view(_U) + _U(1 << 63) if len(hot) else np.zeros(0, _U))

    sizes = {r.n: r.k for r in classes.groupBy(F.least("n", F.lit(p.most_small + 1)).alias("n")).agg(F.count("*").alias("k")).collect()}
    total = classes.agg(F.count("*").alias("k"), F.sum(F.col("n") / 4 + 1).alias("keys"), F.sum("n").alias("n")).first()
    if not total.k:
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    repeated = sets.agg(F.sum("found")).first()[0] or 0
    bound = boundary(sizes, p.pair_cost * 2 * repeated / max(1, total.n), p)
    n_buckets = max(spark.sparkContext.defaultParallelism, math.ceil(total.keys / p.keys_a_task))

    shared = spark.sparkContext.broadcast(frequent)
    keys = docs.select("text").mapInPandas(lambda parts: packed_keys(parts, shared.value, bound, n_buckets, p), "bucket long, records binary")
    # As many partitions as there are buckets of keys_a_task keys, so that what a task sorts stays the same at every size.
    keys = keys.repartition(n_buckets, "bucket")
    found = store(keys.groupBy("bucket").applyInPandas(lambda pdf: candidates(pdf, p), FOUND), "candidates")
    listed = found.filter(F.col("kind") == LISTED).select("key", "a", F.col("b").alias("rare"))
    linked = [_verified(found.filter(F.col("kind") == PAIR).select("a", "b").union(stars := _stars(listed, None, p)), classes, docs, p)]
    drop_stored(spark, stars)
    labels = components(linked[0])
    held = [sets, classes, found]
    if not listed.isEmpty():
        members = store(_members(listed, classes), "members")
        held.append(members)
        for step in range(p.star_rounds + 1):
            more = _stars(listed, labels, p) if step < p.star_rounds else _rest(listed, labels, members, p)
            new = _verified(more, classes, docs, p)
            drop_stored(spark, more)
            linked.append(new)
            if not new.isEmpty():
                drop_stored(spark, labels)
                labels = components(reduce(DataFrame.union, linked))
    reached = classes.select("node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = reached.groupBy("label").agg(F.min("least").alias("component_id"))
    of = reached.join(smallest, "label").select("node", "component_id")
    out = rows.join(of, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    done = store(out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")), "joined")
    drop_stored(spark, *held, *linked, labels)
    return done


def near_duplicates(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """docs without all but one document of each component: the one with the smallest doc_id; repeated rows become one.

    Documents without words are linked with nothing and stay.  Null ids are one id, and of its rows one stays for each text.
    Columns of any name stay as they are, an empty table stays empty.
    """
    joined = ngram_join(docs.select("doc_id", "text"), p=p)
    name = free_name(docs, "id")
    ids = joined.groupBy(F.col("doc_id").alias(name)).agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"), F.count("*").alias("k"))
    same = F.col("doc_id").eqNullSafe(F.col(name))
    left = docs.join(checked_broadcast(ids.filter("not kept").select(name), p.most_broadcast), same, "left_anti")
    repeated = ids.filter("kept and k > 1").select(name)
    if repeated.isEmpty():
        return left
    repeated = checked_broadcast(repeated, p.most_broadcast)
    once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, same, "left_anti").unionByName(once)
