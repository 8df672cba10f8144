"""Packing: bounded-space online best fit into token windows, leftovers merged at the end."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import release_memory, small_batches, store
from loomspark.llm.token_counts import SPACE, in_chunks, load

#: The id goes through Python as text, so that nulls don't turn whole numbers into floats.
PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces that never cross a cut of the library's own: Latin words before a blank, mark or end, marks before a blank or such a
#: word, else all up to the next blank.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = ".,!#*$%&|?:;()"
CUT = re.compile(f"[{_LETTERS}]+(?=[ \n{_MARKS}]|$)|[{_MARKS}]+(?=[ \n{_LETTERS}]|$)|[^{SPACE}]+")
_BEYOND = re.compile("[^\x00-įı-ɏ]")
_PLAIN = re.compile(f"[{_LETTERS}]+").fullmatch
#: Letters and bytes of ids of the distinct pieces that a worker remembers, a fixed share for each piece included.
MOST_KNOWN, A_PIECE = 48_000_000, 100


def cuts(text: str) -> list[str]:
    """A text in pieces whose ids are independent of each other."""
    # Lower case is what the tokenizer makes of these letters anyway, and leaves fewer distinct pieces.
    if "<|" not in text and (text.isascii() or not _BEYOND.search(text)):
        text = text.lower()
    return CUT.findall(text)


@dataclass(frozen=True)
class Parameters:
    size: int = 2048
    end_id: int = 1
    #: Open windows of a partition.
    open_windows: int = 64
    #: Partitions whose leftovers are merged together.
    merged_partitions: int = 64


class Ids:
    """Token ids of texts as little-endian 32-bit bytes; equals encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.known: dict[str, bytes] = {}
        self.size = 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces; plain words go through together, as the ids show where each of them ends."""
        plain: list[str] = []
        other: list[str] = []
        for w in pieces:
            (plain if _PLAIN(w) else other).append(w)
        for i in range(0, len(plain), 200):
            part = plain[i : i + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cut) != len(part):
                self.one_by_one(part)
                continue
            raw, at = ids.tobytes(), 0
            for w, to in zip(part, cut.tolist(), strict=True):
                self.known[w] = raw[at:to]
                at = to
        self.one_by_one(other)

    def one_by_one(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        rows = [cuts(t) for t in texts]
        words = set().union(*rows)
        new = [w for w in words if w not in self.known]
        self.size += sum(map(len, new)) + len(new) * A_PIECE
        if self.size > MOST_KNOWN:
            # What these texts have in common with earlier ones stays.
            self.known = {w: self.known[w] for w in words if w in self.known}
            self.size = sum(map(len, words)) + len(words) * A_PIECE
        self.learn(new)
        look = self.known.__getitem__
        return [b"".join(map(look, r)) for r in rows]


@lru_cache(maxsize=2)
def worker_ids(path: str) -> Ids:
    """One for all tasks of a Python worker, as they share most words."""
    return Ids(path)


class Packer:
    """Places pieces best-fit into at most `most` open windows; emits the fullest when none has room."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        #: (room, number) in order, and each open window's pieces.
        self.room: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, piece, length: int) -> tuple[int, list] | None:
        """Takes a piece in; returns a window that had to go for it."""
        out = None
        i = bisect_left(self.room, (length, -1))
        if i < len(self.room):
            room, k = self.room.pop(i)
        else:
            if len(self.room) == self.most:
                _, full = self.room.pop(0)
                out = full, self.held.pop(full)
            room, k = self.size, self.new()
            self.held[k] = []
        self.held[k].append(piece)
        if room > length:
            insort(self.room, (room - length, k))
        else:
            # Pieces are shorter than a window, so one that fills it has found it open, and no other had to go.
            out = k, self.held.pop(k)
        return out


def _row(doc_id, start: int, ids: bytes, total: int, sequence: int, offset: int) -> tuple:
    return doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset


def pack_partition(parts: Iterator[pd.DataFrame], path: str, p: Parameters, number: int) -> Iterator[pd.DataFrame]:
    """Rows of closed windows, and last the pieces of the open ones with their ids and a null sequence."""
    tokens, packer, end = worker_ids(path), Packer(p.size, p.open_windows), p.end_id.to_bytes(4, "little")
    columns = [c.split()[0] for c in PIECE.split(", ")] + ["ids", "number"]
    out: list[tuple] = []

    def closed(window: list, k: int) -> None:
        at = 0
        for doc_id, start, ids, total in window:
            out.append((*_row(doc_id, start, ids, total, (number << 32) + k, at), None, number))
            at += len(ids) // 4

    for pdf in parts:
        rows = zip(pdf["doc_id"], pdf["text"], strict=True)
        ids_of = (x for c in in_chunks(pdf["text"], 2_000_000) for x in tokens.of(c))
        for (doc_id, _), ids in zip(rows, ids_of, strict=True):
            ids += end
            total = len(ids) // 4
            whole = total // p.size
            for i in range(whole):
                closed([(doc_id, i * p.size, ids[i * p.size * 4 : (i + 1) * p.size * 4], total)], packer.new())
            if total > whole * p.size and (gone := packer.place((doc_id, whole * p.size, ids[whole * p.size * 4 :], total), total - whole * p.size)):
                closed(gone[1], gone[0])
        if out:
            yield pd.DataFrame(out, columns=columns)
            out = []
    for k in sorted(packer.held):
        out += [(doc_id, start, len(ids) // 4, None, total, None, k, ids, number) for doc_id, start, ids, total in packer.held[k]]
    if out:
        yield pd.DataFrame(out, columns=columns)
    out = []
    packer.held.clear()
    release_memory()


def merge(group: tuple, left: pd.DataFrame, p: Parameters) -> pd.DataFrame:
    """Leftover windows one behind the other, cut where a window of full size ends; only the last one may need padding."""
    out, sequence, at = [], (1 << 62) + (int(group[0]) << 32), 0
    for r in left.sort_values(["number", "offset", "start", "ids_crc32"], na_position="first", kind="stable").itertuples(index=False):
        ids, start = r.ids, int(r.start)
        while ids:
            part = ids[: (p.size - at) * 4]
            out.append(_row(r.doc_id, start, part, int(r.doc_tokens), sequence, at))
            ids, start, at = ids[len(part) :], start + len(part) // 4, at + len(part) // 4
            if at == p.size:
                sequence, at = sequence + 1, 0
    return pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])


def packing(docs: DataFrame, path: str = "word_bpe_49k.json", p: Parameters = Parameters(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; it is cut into windows of full size and a rest, and the rest is placed best-fit.  What
    stays open in a partition is merged with its neighbours' rest.  Sequences are gapless and at most `size` long.  A null or
    empty text is end_id alone, repeated rows are packed as often as they occur, other columns don't matter, and an empty
    table has no pieces.  The pieces are written to the shared folder once, so a lost executor doesn't number them anew.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def partition(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return pack_partition(parts, path, p, TaskContext.get().partitionId())

    made = store(rows.mapInPandas(partition, PIECE + ", ids binary, number long"), "packing")
    names = [c.split()[0] for c in PIECE.split(", ")]
    left = made.filter("sequence_id is null").withColumn("g", F.floor(F.col("number") / p.merged_partitions))
    merged = left.groupBy("g").applyInPandas(lambda key, pdf: merge(key, pdf, p), PIECE)
    return made.filter("sequence_id is not null").select(names).unionByName(merged).withColumn("doc_id", F.col("doc_id").cast(kind))
