"""Toxicity: a bidirectional gated recurrent network with attention pooling over every overlapping window of a text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import nn
from loomspark.llm.common import release_memory, small_batches

TOKEN = re.compile(r"[^\W_]+")
THRESHOLD = 0.3


@dataclass(frozen=True)
class Parameters:
    window: int = 32
    stride: int = 24
    word_size: int = 8
    char_size: int = 12
    hidden: int = 8
    #: Most labelled documents, not toxic and toxic, that the network is trained on; of these every word is read.
    most_documents: tuple[int, int] = (3000, 1500)
    vocabulary: int = 20_000
    ngrams: int = 60_000
    #: Words and n-grams in fewer labelled documents are unknown.
    least_documents: int = 3
    passes: int = 4
    #: Share of a batch's distinct words that are read by their characters alone.
    unknown: float = 0.2
    #: A batch takes in documents until it has so many windows.
    batch_windows: int = 400
    rate: float = 0.02
    seed: int = 7


class Encoder:
    """Words to vocabulary places (0: unknown) and to the places of their character n-grams."""

    def __init__(self, words: dict[str, int], ngrams: dict[str, int]):
        self.words, self.ngrams = words, ngrams

    @classmethod
    def learn(cls, docs: list[tuple[list[str], int]], p: Parameters) -> tuple[Encoder, np.ndarray, np.ndarray]:
        """The encoder, and for words and n-grams how much likelier (log odds) a toxic document holds them."""
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        grams: tuple[Counter, Counter] = (Counter(), Counter())
        for t, y in docs:
            counts[y].update(set(t))
        for y in (0, 1):
            for w, n in counts[y].items():
                for g in set(cls.pieces(w)):
                    grams[y][g] += n
        n_docs = [sum(y == k for _, y in docs) for k in (0, 1)]
        n_words = [sum(c.values()) for c in counts]

        def top(found: tuple[Counter, Counter], most: int, totals: list[int]) -> tuple[list[str], np.ndarray]:
            both = found[0] + found[1]
            kept = sorted((x for x, n in both.items() if n >= p.least_documents), key=lambda x: (-both[x], x))[:most]
            odds = [np.log((found[1][x] + 0.5) / (totals[1] + 1)) - np.log((found[0][x] + 0.5) / (totals[0] + 1)) for x in kept]
            return kept, np.array(odds, np.float32)

        words, word_odds = top(counts, p.vocabulary, n_docs)
        ngrams, ngram_odds = top(grams, p.ngrams, n_words)
        return cls({w: i + 1 for i, w in enumerate(words)}, {g: i for i, g in enumerate(ngrams)}), word_odds, ngram_odds

    @staticmethod
    def pieces(word: str) -> Iterator[str]:
        w = f"<{word}>"
        return (w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1))

    def encode(self, words: list[str]) -> tuple[np.ndarray, nn.Runs]:
        get, flat, sizes = self.ngrams.get, [], []
        for w in words:
            found = [k for k in map(get, self.pieces(w)) if k is not None]
            flat += found
            sizes.append(len(found))
        at = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        return at, nn.Runs(np.array(flat, np.int64), np.array(sizes, np.int64))


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def windows(n: int, p: Parameters) -> np.ndarray:
    """Starts of the overlapping windows that cover n words; the last one ends with the text."""
    return np.unique(np.minimum(np.arange(0, max(1, n - (p.window - p.stride)), p.stride), max(0, n - p.window)))


class Network:
    def __init__(self, encoder: Encoder, p: Parameters, word_odds: np.ndarray, ngram_odds: np.ndarray):
        r = np.random.default_rng(p.seed)
        draw = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        n, d = p.hidden, p.word_size + p.char_size
        self.encoder, self.p = encoder, p
        self.w: nn.Params = {
            "word": draw(len(encoder.words) + 1, p.word_size, scale=0.1), "char": draw(max(1, len(encoder.ngrams)), p.char_size, scale=0.3),
            "in_f": draw(d, 3 * n, scale=0.4), "in_b": draw(d, 3 * n, scale=0.4), "b_f": np.zeros(3 * n, np.float32), "b_b": np.zeros(3 * n, np.float32),
            "u_f": draw(n, 3 * n, scale=0.3), "u_b": draw(n, 3 * n, scale=0.3),
            "att": draw(2 * n, n, scale=0.4), "att_v": draw(n, scale=0.6), "out": draw(2 * n, scale=0.4), "out_b": np.array([-1.0], np.float32),
        }
        # The first number of a word or n-gram starts at its log odds; training moves it with the others.
        self.w["word"][1:, 0] = word_odds / 2
        self.w["char"][: len(ngram_odds), 0] = ngram_odds / 2
        self.w["word"][0] = 0

    # --- words ---

    def embed(self, at: np.ndarray, chars: nn.Runs) -> np.ndarray:
        return np.concatenate([self.w["word"][at], chars.means(self.w["char"])], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What words feed into the gates of both directions: all that scoring needs of them."""
        return np.concatenate([x @ self.w["in_f"] + self.w["b_f"], x @ self.w["in_b"] + self.w["b_b"]], axis=1)

    def projected(self, words: list[str]) -> np.ndarray:
        return self.project(self.embed(*self.encoder.encode(words)))

    # --- windows ---

    def forward(self, xf: np.ndarray, xb: np.ndarray, lengths: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        """Window logits from projected inputs (T, B, 3 hidden); xb is reversed already."""
        mask = (np.arange(xf.shape[0])[:, None] < lengths).astype(np.float32)
        hf, cf = nn.gru(xf, mask, self.w["u_f"], keep)
        hb, cb = nn.gru(xb, mask, self.w["u_b"], keep)
        h = np.concatenate([hf, nn.reverse(hb, lengths)], axis=2)
        a = np.tanh(h @ self.w["att"])
        e = np.where(mask > 0, a @ self.w["att_v"], -1e9)
        weight = np.exp(e - e.max(axis=0))
        weight *= mask
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, h)
        return pooled @ self.w["out"] + self.w["out_b"][0], (mask, cf, cb, h, a, weight, pooled, lengths)

    def backward(self, dlogit: np.ndarray, cache: tuple) -> tuple[nn.Params, np.ndarray, np.ndarray]:
        mask, cf, cb, h, a, weight, pooled, lengths = cache
        g = {"out": pooled.T @ dlogit, "out_b": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * self.w["out"]
        dweight = np.einsum("bh,tbh->tb", dpooled, h)
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        da = de[:, :, None] * self.w["att_v"] * (1 - a * a)
        g["att_v"], g["att"] = np.einsum("tb,tbn->n", de, a), np.einsum("tbh,tbn->hn", h, da)
        dh = weight[:, :, None] * dpooled + da @ self.w["att"].T
        n = self.p.hidden
        dxf, g["u_f"] = nn.gru_back(dh[:, :, :n], cf)
        dxb, g["u_b"] = nn.gru_back(nn.reverse(dh[:, :, n:], lengths), cb)
        return g, dxf, dxb

    def gather(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word places (T, B) of windows, front to back and back to front; what is past the end repeats the last word."""
        t = np.arange(self.p.window)[:, None]
        return ids[starts + np.minimum(t, lengths - 1)], ids[starts + np.maximum(lengths - 1 - t, 0)]

    def score_windows(self, table: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n, out = 3 * self.p.hidden, []
        for i in range(0, len(starts), 2048):
            s, k = starts[i : i + 2048], lengths[i : i + 2048]
            f, b = self.gather(ids, s, k)
            out.append(self.forward(table[f, :n], table[b, n:], k, keep=False)[0])
        return np.concatenate(out)


def train(rows: list[tuple[str, int]], p: Parameters = Parameters()) -> Network:
    """Multi-instance training: a document is as toxic as its worst window, so only that window is corrected."""
    docs = [(tokens(t), y) for t, y in rows]
    docs = [(t, y) for t, y in docs if t]
    encoder, *odds = Encoder.learn(docs, p)
    network = Network(encoder, p, *odds)
    if not docs:
        return network
    every = sorted({w for t, _ in docs for w in t})
    number = {w: i for i, w in enumerate(every)}
    known, chars = encoder.encode(every)
    texts = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t, _ in docs]
    spans = [windows(len(t), p) for t in texts]
    rng = np.random.default_rng(p.seed)
    adam = nn.Adam(network.w, p.rate)
    for epoch in range(p.passes):
        adam.rate = p.rate * (1 if epoch < p.passes - 2 else 0.3)
        batch, size = [], 0
        order = rng.permutation(len(docs))
        for k, i in enumerate(order):
            batch.append(i)
            size += len(spans[i])
            if size >= p.batch_windows or k == len(order) - 1:
                used, ids = np.unique(np.concatenate([texts[i] for i in batch]), return_inverse=True)
                at = np.where(rng.random(len(used)) < p.unknown, 0, known[used])
                adam.step(_gradients(network, at, chars.take(used), ids, [len(texts[i]) for i in batch], [spans[i] for i in batch], np.array([docs[i][1] for i in batch], np.float32)))
                batch, size = [], 0
    return network


def _gradients(network: Network, at: np.ndarray, chars: nn.Runs, ids: np.ndarray, sizes: list[int], spans: list[np.ndarray], y: np.ndarray) -> nn.Params:
    """Gradients of a batch of documents: ids are its words as places in (at, chars), spans the starts of its windows."""
    p, n = network.p, 3 * network.p.hidden
    x = network.embed(at, chars)
    table = network.project(x)
    first = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.concatenate([s + f for s, f in zip(spans, first, strict=False)])
    lengths = np.concatenate([np.minimum(p.window, k - s) for s, k in zip(spans, sizes, strict=True)])
    logits = network.score_windows(table, ids, starts, lengths)
    edges = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
    worst = np.array([a + int(np.argmax(logits[a:b])) for a, b in zip(edges, edges[1:], strict=False)])
    f, b = network.gather(ids, starts[worst], lengths[worst])
    logit, cache = network.forward(table[f, :n], table[b, n:], lengths[worst])
    grads, dxf, dxb = network.backward(((nn.sigmoid(logit) - y) / len(y)).astype(np.float32), cache)
    dtable = np.zeros_like(table)
    nn.add_rows(dtable[:, :n], f.ravel(), dxf.reshape(-1, n))
    nn.add_rows(dtable[:, n:], b.ravel(), dxb.reshape(-1, n))
    dx = dtable[:, :n] @ network.w["in_f"].T + dtable[:, n:] @ network.w["in_b"].T
    grads |= {"in_f": x.T @ dtable[:, :n], "in_b": x.T @ dtable[:, n:], "b_f": dtable[:, :n].sum(axis=0), "b_b": dtable[:, n:].sum(axis=0)}
    grads["word"] = np.zeros_like(network.w["word"])
    nn.add_rows(grads["word"], at, dx[:, : p.word_size])
    grads["word"][0] = 0
    grads["char"] = chars.means_back(dx[:, p.word_size :], network.w["char"])
    return grads


class Scorer:
    """Scores whole texts; the projected words are kept up to a bound."""

    MOST = 120_000

    def __init__(self, network: Network):
        self.network, self.at = network, {}
        self.table = np.zeros((self.MOST, 6 * network.p.hidden), np.float32)

    def places(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.at]
        if new:
            if len(self.at) + len(new) > len(self.table):
                self.at.clear()
                new = list(set(words))
                if len(new) > len(self.table):
                    self.table = np.zeros((len(new), self.table.shape[1]), np.float32)
            first = len(self.at)
            self.table[first : first + len(new)] = self.network.projected(new)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def score(self, texts: list[str | None]) -> list[float]:
        """The highest window's probability of each text; 0 for a text without words."""
        out = np.zeros(len(texts))
        held, words, size = [], [], 0
        for i, t in enumerate(texts):
            found = tokens(t)
            # A very long text goes through in overlapping parts, each cut where a window starts.
            step = 4096 * self.network.p.stride
            for a in range(0, max(1, len(found) - (self.network.p.window - self.network.p.stride)) if found else 0, step):
                part = found[a : a + step + self.network.p.window - self.network.p.stride]
                held.append((i, size, len(part)))
                words += part
                size += len(part)
                if size > 100_000:
                    self._flush(out, held, words)
                    held, words, size = [], [], 0
        if held:
            self._flush(out, held, words)
        return out.tolist()

    def _flush(self, out: np.ndarray, held: list[tuple[int, int, int]], words: list[str]) -> None:
        p, ids = self.network.p, self.places(words)
        spans = [windows(n, p) for _, _, n in held]
        starts = np.concatenate([s + at for s, (_, at, _) in zip(spans, held, strict=True)])
        lengths = np.concatenate([np.minimum(p.window, n - s) for s, (_, _, n) in zip(spans, held, strict=True)])
        logits = self.network.score_windows(self.table, ids, starts, lengths)
        best = nn.sigmoid(np.maximum.reduceat(logits, np.concatenate([[0], np.cumsum([len(s) for s in spans])[:-1]])))
        np.maximum.at(out, [i for i, _, _ in held], best)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, p: Parameters) -> list[tuple[str, int]]:
    """Whole labelled texts: of either class the most_documents ids that come first by a hash; a tie of labels goes to toxic.

    The ids are chosen on the labels alone.  They are bounded, so they are broadcast; rows of one id with one text become one
    before they are moved.
    """
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("y")).groupBy("k").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    chosen = None
    for y in (0, 1):
        part = rows.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(p.most_documents[y])
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    found = texts.groupBy("k", "y", F.xxhash64("t").alias("h")).agg(F.first("t").alias("t"))
    seen: dict[str, int] = {}
    for r in found.select("t", "y").toLocalIterator():
        seen[r["t"]] = max(r["y"], seen.get(r["t"], 0))
    return sorted(seen.items())


def scored(text: Column, network: Network, spark) -> Column:
    """Score column; the network's size is bounded by its parameters, so it is broadcast."""
    shared = spark.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for s in parts:
            yield pd.Series([x for i in range(0, len(s), 250) for x in scorer.score(s.iloc[i : i + 250].tolist())], dtype="float64")
        del scorer
        release_memory()

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD, p: Parameters = Parameters()) -> DataFrame:
    """docs with score, the highest probability over all overlapping windows of the whole text, and predicted (1 from threshold on).

    labels has (key, 0/1 label) rows, of which those on rows of docs train the network; rows with nulls are left out, and
    without any the untrained network still gives a score.  Null, empty and wordless texts score 0, and an empty table gives
    an empty table.  A very long text is scored window by window to its end, in parts of bounded size; a training text is
    held whole by the driver.  Equal texts get equal scores, repeated rows stay, and columns of docs named score or predicted
    are replaced.
    """
    small_batches(docs.sparkSession)
    network = train(sample(docs, labels, key, text, label, p), p)
    return docs.withColumn("score", scored(docs[text], network, docs.sparkSession)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
