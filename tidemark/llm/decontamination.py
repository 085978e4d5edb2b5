"""Benchmark decontamination by embedded windows.

Words are the letters. CGK's random walk maps a string to one twice or three times as long:
output the letter at a pointer, then move the pointer on by a hashed bit of the letter and the
step; two strings at a small edit distance come into step again, so their images differ in few
places. Each repetition draws a walk and a sample of its places; the letters at the sampled
places are a bucket, in which item-sized windows of a text meet the items. Every window that
meets an item in any repetition is verified by its exact edit distance in words.

The items are the stated set that meets all texts: their words and buckets travel with the task,
and are counted before. A pass over the rows takes a set of about ``ITEM_WORDS`` words, or one
longer item; more items take further passes, each written before the next set is read, so the
driver and a task hold one set at a time. Items of like size share walks. A window can only match if enough of
its words are words of such an item, which running counts tell for all windows at once without
losing a match. Sampled places are looked up one after the other, and windows whose letters
begin no item's bucket stop there.

Recall: walks are added until the wanted share of copies of the items, edited at random up to
the distance limit, meets its item; this is done for every class of sizes.

Defined results: a null or empty text matches nothing; items without words match nothing; items
shorter than ``least_words`` words must stand whole; items are told by id, repeated ones each;
repeated rows are judged each; empty tables give rows without matches; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemark.llm.shared import bounded_batches, mix, word_hashes, written

#: Words of items in one set that meets all texts.
ITEM_WORDS = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bit(letters: np.ndarray, step: int, walk: int) -> np.ndarray:
    """The move of a walk at a step for each letter: 0 or 1."""
    key = np.uint64((walk * 1_000_003 + step + 1) * 0xD1342543DE82EF95 & (2**64 - 1))
    return (mix(letters ^ key) >> np.uint64(63)).astype(np.int64)


def best_window(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the part of ``text`` nearest to the whole ``item``; the first of equals."""
    m = len(text)
    row, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    places = np.arange(m + 1)
    for w in item:
        # a part is told by cost and start in one number, so that the least keeps its start
        cost = np.empty(m + 1, np.int64)
        cost[0] = row[0] + 1
        diagonal, up = row[:-1] + (text != w), row[1:] + 1
        cost[1:] = np.minimum(diagonal, up)
        origin = np.empty(m + 1, np.int64)
        origin[0] = 0
        origin[1:] = np.where(diagonal <= up, start[:-1], start[1:])
        packed = (cost - places) * (m + 2) + (m + 1 - origin)
        least = np.minimum.accumulate(packed)
        row = least // (m + 2) + places
        start = m + 1 - least % (m + 2)
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


class SizeClass:
    """Items of like size: their walks, buckets and words."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], recall: float, places: int):
        self.numbers = [n for n, _, _ in items]
        self.words = [w for _, w, _ in items]
        self.most = [d for _, _, d in items]
        self.width = max(len(w) + d for w, d in zip(self.words, self.most, strict=True))
        self.need = min(len(w) - d for w, d in zip(self.words, self.most, strict=True))
        known = np.unique(np.concatenate(self.words))
        self.shift = np.uint64(64 - max(16, int(len(known) * 64).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[known >> self.shift] = 1
        self.samples = self.repetitions(recall, places)

    def repetitions(self, recall: float, places: int) -> list[tuple[int, list[int], list[np.ndarray], np.ndarray]]:
        """(walk, places, prefixes of buckets, buckets), as many as the recall asks for; edited copies come from a fixed seed."""
        rng = np.random.default_rng(17)
        picked = rng.choice(len(self.words), min(len(self.words), 100), replace=False)
        pairs = [(k, edited(self.words[k], self.most[k], rng)) for k in picked for _ in range(max(3, 200 // len(picked)))]
        met = np.zeros(len(pairs), bool)
        shortest = min(map(len, self.words))
        out: list = []
        while not out or met.mean() < recall:
            walk = len(out)
            at = np.sort(np.random.default_rng(walk).choice(shortest, min(places, shortest), replace=False)).tolist()
            own = letters(self.words, walk, at)
            met |= (letters([w for _, w in pairs], walk, at) == own[[k for k, _ in pairs]]).all(1)
            prefixes, h = [], np.zeros(len(own), np.uint64)
            for j in range(len(at)):
                h = mix(h * _STEP ^ own[:, j])
                prefixes.append(np.unique(h))
            out.append((walk, at, prefixes, h))
        return out

    def candidates(self, words: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, item of the class) of windows that meet an item; ``end`` is the end of each word's text."""
        upto = np.zeros(len(words) + self.width + 1, np.int32)
        np.cumsum(self.table[words >> self.shift], out=upto[1 : len(words) + 1])
        upto[len(words) + 1 :] = upto[len(words)]
        starts = np.flatnonzero(upto[self.width : self.width + len(words)] - upto[: len(words)] >= self.need)
        ends = end[starts]
        found = []
        for walk, places, prefixes, buckets in self.samples:
            at, stop, origin, h, k = starts, ends, starts, np.zeros(len(starts), np.uint64), 0
            for step in range(places[-1] + 1):
                now = np.where(at < stop, words[np.minimum(at, len(words) - 1)], np.uint64(0))
                if step == places[k]:
                    h = mix(h * _STEP ^ now)
                    on = np.flatnonzero(among(h, prefixes[k]))
                    at, stop, origin, h, now, k = at[on], stop[on], origin[on], h[on], now[on], k + 1
                    if k == len(places) or not len(at):
                        break
                at = at + bit(now, step, walk)
            if len(origin):
                order = np.argsort(buckets, kind="stable")
                lo, hi = np.searchsorted(buckets[order], h), np.searchsorted(buckets[order], h, side="right")
                many = hi - lo
                which = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
                found.append((np.repeat(origin, many), order[which]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        packed = np.unique(np.concatenate([a * len(self.words) + b for a, b in found]))
        return packed // len(self.words), packed % len(self.words)


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with so many words put in, left out or replaced."""
    out = words.tolist()
    for _ in range(edits):
        kind = int(rng.integers(3))
        if kind == 0 or not out:
            out.insert(int(rng.integers(len(out) + 1)), int(rng.integers(2**63)))
        elif kind == 1:
            del out[int(rng.integers(len(out)))]
        else:
            out[int(rng.integers(len(out)))] = int(rng.integers(2**63))
    return np.array(out, np.uint64)


def letters(strings: list[np.ndarray], walk: int, places: list[int]) -> np.ndarray:
    """The letters of the strings' images at the places; 0 beyond an end."""
    end = np.cumsum([len(s) for s in strings])
    at = end - np.array([len(s) for s in strings])
    flat = np.concatenate([*strings, np.zeros(1, np.uint64)])
    out = np.zeros((len(strings), len(places)), np.uint64)
    for step in range(places[-1] + 1):
        now = np.where(at < end, flat[np.minimum(at, len(flat) - 1)], np.uint64(0))
        if step in places:
            out[:, places.index(step)] = now
        at = at + bit(now, step, walk)
    return out


class Items:
    """A set of items by classes of size, each up to a tenth longer than its shortest."""

    def __init__(self, ids: list, texts: list[str | None], share: float, recall: float, places: int, least_words: int):
        words, offsets = word_hashes(pa.array(texts, pa.large_string()))
        rows = sorted(((len(words[a:b]), n, words[a:b]) for n, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)) if b > a), key=lambda r: r[:2])
        self.ids = ids
        self.classes: list[SizeClass] = []
        held: list = []
        for size, n, w in rows:
            whole = size < least_words
            if held and (size > 1.1 * len(held[0][1]) + 1 or (len(held[0][1]) < least_words and not whole)):
                self.classes.append(SizeClass(held, recall, places))
                held = []
            held.append((n, w, 0 if whole else int(share * size)))
        if held:
            self.classes.append(SizeClass(held, recall, places))

    def matches(self, column: pa.Array) -> list[list[dict]]:
        """For each text the best match of every item that stands in it within its limit."""
        words, offsets = word_hashes(column)
        n = len(offsets) - 1
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(n)]
        if len(words):
            text = np.repeat(np.arange(n), np.diff(offsets))
            end = offsets[text + 1]
            for c in self.classes:
                starts, which = c.candidates(words, end)
                self.verify(c, words, offsets, text[starts], starts, which, out)
        return [[{"item_id": self.ids[k], "first": a, "last": b, "distance": d} for k, (a, b, d) in sorted(found.items())] for found in out]

    @staticmethod
    def verify(c: SizeClass, words: np.ndarray, offsets: np.ndarray, texts: np.ndarray, starts: np.ndarray, which: np.ndarray, out: list[dict]) -> None:
        done: dict[tuple[int, int], int] = {}
        for t, s, k in zip(texts.tolist(), starts.tolist(), which.tolist(), strict=True):
            item, most = c.words[k], c.most[k]
            if done.get((t, k), -1) >= s:  # lies in a stretch that is verified
                continue
            done[t, k] = s + most
            low = int(offsets[t])
            a, b = max(low, s - most), min(int(offsets[t + 1]), s + len(item) + 3 * most)
            part = words[a:b]
            if b - a < len(item) - most or among(item, np.sort(part)).sum() < len(item) - most:
                continue
            distance, first, stop = best_window(item, part)
            number = c.numbers[k]
            if distance <= most and stop > first and (number not in out[t] or distance < out[t][number][2]):
                out[t][number] = (a + first - low, a + stop - 1 - low, distance)


def item_sets(items: DataFrame, item_id: str, item_text: str, share: float, recall: float, places: int, least_words: int) -> tuple[int, Iterator[Items]]:
    """How many sets of about ``ITEM_WORDS`` words there are, and the sets, each read and built when its turn comes."""
    rows = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.size(F.split("text", "[\\x20\\x09-\\x0D]+")))).first()[0] or 0
    parts = total // ITEM_WORDS + 1

    def built() -> Iterator[Items]:
        for p in range(parts):
            block = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).orderBy("id", "text").collect()
            yield Items([r["id"] for r in block], [r["text"] for r in block], share, recall, places, least_words)

    return parts, built()


def match_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.2, recall: float = 0.95, places: int = 3, least_words: int = 5) -> DataFrame:
    """``id_col``, item_id, first, last, distance: every item that stands in a text within ``share`` of its words of edits.

    One row for each text and item, its best place in words from 0. Words are as in
    ``word_hashes``: without white space, A-Z as a-z, without ASCII punctuation.
    """
    bounded_batches(docs.sparkSession, 4)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("item_id", items.schema[item_id].dataType)])
    for name in ("first", "last", "distance"):
        schema = schema.add(name, "long")

    def met(one: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = to_arrow_schema(schema)
            for batch in batches:
                names = batch.column(0).to_pylist()
                found = [{"id": i} | m for i, ms in zip(names, one.matches(batch.column(1)), strict=True) for m in ms]
                yield pa.RecordBatch.from_pylist(found, kind)

        return rows.mapInArrow(run, schema)

    parts, sets = item_sets(items, item_id, item_text, share, recall, places, least_words)
    found = reduce(DataFrame.unionByName, (met(one) if parts == 1 else written(met(one), "matches") for one in sets))
    return found.withColumnRenamed("id", id_col)


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.2, recall: float = 0.95, places: int = 3, least_words: int = 5) -> DataFrame:
    """The rows of ``docs``, with all columns, in whose texts no item stands."""
    bounded_batches(docs.sparkSession, 4)
    at = docs.columns.index(text_col)

    def clean(rows: DataFrame, one: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not m for m in one.matches(batch.column(at))], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    parts, sets = item_sets(items, item_id, item_text, share, recall, places, least_words)
    for one in sets:
        docs = clean(docs, one) if parts == 1 else written(clean(docs, one), "clean")
    return docs
