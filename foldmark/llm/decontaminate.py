"""Benchmark passages in documents by the q-gram lemma.

A benchmark text of m bytes is found in a document if some stretch of the document is within k = rate * m edits of
it. Such a stretch shares at least m - q + 1 - k * q of the text's q-grams, all of them on diagonals (position in the
document minus position in the text) that lie within k of each other. Shared q-grams are counted per document, text
and band of 2(k + 1) diagonals; bands overlap by half, so that some band holds any k + 1 neighbouring diagonals. Bands
that reach the bound are verified by a banded alignment, the others cannot match.

Texts are compared as UTF-8 bytes of their lower case, of any script, and white space bytes as spaces. The benchmark is the query
set: it is cut into blocks of at most ``BLOCK_BYTES``, one broadcast and one pass over the documents per block, so
documents never move and no group forms, however often a passage occurs.

Benchmark texts shorter than ``LEAST`` bytes after trimming are too short for edits and the lemma; they are found as they stand, with no
letter or digit right before or after them where they begin or end with one themselves (scripts without spaces excepted).

Edge cases: null or empty texts contain nothing and are clean, and empty benchmark texts are not looked for; rows that repeat an item_id are all looked for, as are those
without one, which are reported as null; repeated
documents are each judged; an empty benchmark finds nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 10
RATE = 0.08
LEAST = 24
BLOCK_BYTES = 4 * 1024 * 1024
STRETCH = 1 << 20  # bytes of documents whose q-grams are looked up at a time
EXPANDED = 1 << 20  # hits that are expanded to (text, diagonal) at a time

SPACED = 0x2E80  # from here on, scripts are mostly written without spaces between words

FOLD = np.arange(256, dtype=np.uint8)
FOLD[9:14] = ord(" ")
SPACES = dict.fromkeys(range(9, 14), " ")


def folded(text: str | None) -> np.ndarray:
    return FOLD[np.frombuffer((text or "").lower().encode(), np.uint8)]


def _joined(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one word."""
    return a.isalnum() and b.isalnum() and ord(a) < SPACED and ord(b) < SPACED


def grams(codes: np.ndarray) -> np.ndarray:
    """The q-grams of a byte array as 64-bit digests: ten bytes as eight and two."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    two = codes[:-1].astype(np.uint64) << np.uint64(8) | codes[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    return eight[:n] * np.uint64(0x9E3779B97F4A7C15) + two[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Patterns:
    """A block of benchmark texts with the postings of their q-grams, and the short ones (item, text) beside them."""

    ids: list[int | None]
    texts: list[bytes]
    short: list[tuple[int | None, str]]

    @cached_property
    def words(self) -> ahocorasick.Automaton | None:
        """All short texts at once, each with the ids that have it."""
        if not self.short:
            return None
        found: dict[str, set[int | None]] = {}
        for item, text in self.short:
            found.setdefault(text, set()).add(item)
        out = ahocorasick.Automaton()
        for text, items in found.items():
            out.add_word(text, (len(text), items))
        out.make_automaton()
        return out

    @cached_property
    def codes(self) -> list[np.ndarray]:
        return [np.frombuffer(t, np.uint8) for t in self.texts]

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(t) for t in self.texts], np.int64)

    @cached_property
    def budget(self) -> np.ndarray:
        """Edits per text, few enough that the lemma still demands a shared q-gram."""
        return np.minimum((self.lengths * RATE).astype(np.int64), (self.lengths - Q) // Q)

    @cached_property
    def bound(self) -> np.ndarray:
        return self.lengths - Q + 1 - self.budget * Q

    @cached_property
    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct digests, where their postings begin, and (text, position) of the postings."""
        each = [grams(c) for c in self.codes]
        text = np.repeat(np.arange(len(each)), [len(g) for g in each])
        place = np.concatenate([np.arange(len(g)) for g in each])
        flat = np.concatenate(each)
        order = np.argsort(flat, kind="stable")
        found, first = np.unique(flat[order], return_index=True)
        return found, np.append(first, len(flat)), text[order], place[order]

    @cached_property
    def seen(self) -> np.ndarray:
        """Bitmap over the top bits of the digests that occur."""
        marks = np.zeros(1 << 22, bool)
        marks[self.postings[0] >> np.uint64(42)] = True
        return marks


def distance(pattern: np.ndarray, region: np.ndarray, most: int, width: int) -> int:
    """Least edits that turn the pattern into a stretch of the region, on diagonals 0 to ``width``; most + 1 if more."""
    far = most + 1
    steps = np.arange(width + 1)
    row = np.where(steps <= len(region), 0, far)
    padded = np.full(len(pattern) + width + 1, -1, np.int16)
    n = min(len(region), len(padded))
    padded[:n] = region[:n]
    inside = len(region)
    for i, char in enumerate(pattern):
        change = row + (padded[i : i + width + 1] != char)
        drop = np.append(row[1:], far) + 1
        best = np.minimum(change, drop)
        best = np.minimum.accumulate(best - steps) + steps
        row = np.where(i + 1 + steps <= inside, best, np.where(steps + i <= inside, drop, far))
        if row.min() > most:
            return far
    return int(min(row.min(), far))


def _bands(codes: np.ndarray, ends: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, text, band) whose count of shared q-grams reaches the bound."""
    found, first, text, place = p.postings
    starts = np.concatenate(([0], ends[:-1]))
    span = int(len(codes) + p.lengths.max() + 4)
    keys, counts = [], []

    def add(at: np.ndarray, slot: np.ndarray) -> None:
        size = first[slot + 1] - first[slot]
        hit = np.repeat(np.arange(len(at)), size)
        post = np.arange(len(hit)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[slot], size)
        doc = np.searchsorted(ends, at, side="right")[hit]
        which = text[post]
        diagonal = at[hit] - starts[doc] - place[post] + p.lengths.max()
        band = diagonal // (p.budget[which] + 1)
        pair = (doc * len(p.texts) + which) * span
        for shift in (0, 1):
            key, n = np.unique(pair + band + 1 - shift, return_counts=True)
            keys.append(key)
            counts.append(n)

    for begin in range(0, len(codes), STRETCH):
        digest = grams(codes[begin : begin + STRETCH + Q - 1])
        at = np.nonzero(p.seen[digest >> np.uint64(42)])[0]
        slot = np.minimum(np.searchsorted(found, digest[at]), len(found) - 1)
        real = found[slot] == digest[at]
        at, slot = at[real] + begin, slot[real]
        doc = np.searchsorted(ends, at, side="right")
        whole = at + Q <= ends[np.minimum(doc, len(ends) - 1)]
        at, slot = at[whole], slot[whole]
        total = np.cumsum(first[slot + 1] - first[slot])
        cuts = np.searchsorted(total, np.arange(EXPANDED, total[-1] if len(total) else 0, EXPANDED))
        for a, s in zip(np.split(at, cuts), np.split(slot, cuts)):
            if len(a):
                add(a, s)
        if len(keys) > 64:
            keys[:], counts[:] = map(list, zip(_summed(keys, counts)))
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, n = _summed(keys, counts)
    which = key // span % len(p.texts)
    enough = n >= p.bound[which]
    return key[enough] // span // len(p.texts), which[enough], key[enough] % span - 1


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def _short(text: str | None, p: Patterns) -> dict[int | None, int]:
    """The items of short texts that stand in a text by themselves."""
    found: dict[int | None, int] = {}
    if p.words is None or not text:
        return found
    line = text.lower().translate(SPACES)
    for last, (size, items) in p.words.iter(line):
        first = last + 1 - size
        if first and _joined(line[first - 1], line[first]) or last + 1 < len(line) and _joined(line[last], line[last + 1]):
            continue
        found.update(dict.fromkeys(items, 0))
    return found


def matches(texts: Iterable[str | None], p: Patterns) -> list[dict[int | None, int]]:
    """For each text, the item ids found in it with the fewest edits found."""
    texts = list(texts)
    parts = [folded(t) for t in texts]
    ends = np.cumsum([len(x) for x in parts]) if parts else np.zeros(0, np.int64)
    out: list[dict[int | None, int]] = [_short(t, p) for t in texts]
    if not p.texts or not len(ends) or not ends[-1]:
        return out
    docs, which, band = _bands(np.concatenate(parts), ends, p)
    top = int(p.lengths.max())
    for d, w, b in zip(docs.tolist(), which.tolist(), band.tolist()):
        k, item = int(p.budget[w]), p.ids[w]
        if out[d].get(item, k + 1) == 0:
            continue
        low = b * (k + 1) - top - k
        start = max(0, low)
        region = parts[d][start : max(0, low + 4 * k + 3 + len(p.texts[w]) + k)]
        if region.tobytes().find(p.texts[w]) >= 0:
            found = 0
        else:  # places before the document match nothing
            region = np.concatenate((np.full(start - low, -1, np.int16), region.astype(np.int16)))
            found = distance(p.codes[w], region, k, 4 * k + 3)
        if found <= k:
            out[d][item] = min(found, out[d].get(item, found))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[Patterns]:
    """The query set in blocks of bounded size, one at a time on the driver."""
    ids, texts, short, size = [], [], [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = folded(row["text"]).tobytes().strip()
        if not text:
            continue
        if len(text) < LEAST:
            short.append((row["item_id"], text.decode()))
        else:
            ids.append(row["item_id"])
            texts.append(text)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield Patterns(ids, texts, short)
            ids, texts, short, size = [], [], [], 0
    if size:
        yield Patterns(ids, texts, short)


def _search(docs: DataFrame, p: Patterns, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((p.ids, p.texts, p.short))
    loaded: list[Patterns] = []

    @F.pandas_udf("array<struct<item_id:long,edits:int>>")
    def find(texts: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(Patterns(*shared.value))
        found = matches(texts, loaded[0])
        return pd.Series([[{"item_id": i, "edits": e} for i, e in sorted(f.items(), key=lambda x: (x[0] is not None, x[0] or 0))] for f in found], dtype=object)

    return docs.withColumn(name, find("text"))


def marked(docs: DataFrame, benchmark: DataFrame, name: str = "found") -> DataFrame:
    """``docs`` with the array ``name`` of (item_id, edits) of the benchmark texts that each row contains."""
    empty = F.array().cast("array<struct<item_id:long,edits:int>>")
    out = docs
    columns = []
    for i, block in enumerate(_blocks(benchmark)):
        columns.append(f"_{name}_{i}")
        out = _search(out, block, columns[-1])
    every = F.array_sort(F.flatten(F.array(*columns))) if columns else empty
    return out.withColumn(name, every).drop(*columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, the item ids found in order, and the fewest edits among them."""
    rows = marked(docs.select("doc_id", "text"), benchmark)
    ids = F.array_distinct(F.transform("found", lambda x: x["item_id"]))
    return rows.select(
        "doc_id",
        (F.size("found") > 0).alias("contaminated"),
        F.array_join(ids.cast("array<string>"), ",", "null").alias("item_ids"),
        F.array_min(F.transform("found", lambda x: x["edits"])).alias("edits"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark text."""
    return marked(docs, benchmark, "_found").filter(F.size("_found") == 0).select(*docs.columns)
