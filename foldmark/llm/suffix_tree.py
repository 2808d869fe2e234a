"""Language-model scoring with a probabilistic suffix tree.

Symbols are words and one end per text; the start of a text is seen as an end. The root of the tree is the smoothed
unigram distribution over all training words. The tree grows level by level: the contexts of L symbols whose suffix of
L - 1 symbols is a state become states if a likelihood-ratio test says that what follows them diverges from what follows
that suffix, until no context of a length passes. The next-symbol distribution of a state discounts the counts of the
symbols seen ``LEAST`` times or more after it and gives the mass that is left to the others in proportion to the parent's
distribution. A text is scored symbol by symbol from the longest suffix that is a state.

Contexts, and next symbols of a context, count from ``LEAST`` occurrences at any corpus size, so the tree grows with the
corpus. It is a table in the shared folder of keys (64-bit digests of words, contexts and contexts with a next symbol) and of
what each adds to the score of a symbol: the log of the root for a word, the log of the left factor for a state, and for an
explicit next symbol what it has more than that and its probability in the parent. So the score of a text is a sum over its
keys. The ``HEAD`` most frequent keys are broadcast; texts meet the others in a join. Bitmaps of bounded size spare keys that
cannot be in the tables; they have no false negatives, and what they let through wrongly finds no partner.

What is counted at a level is what can still occur ``LEAST`` times: pairs of words that do, then stretches of L + 1 symbols whose
first and last L symbols do, as far as the level before counted them. The key of a symbol after a context is made of the context's key and
of the key of the same symbol after the parent, so a counted stretch is those two keys and a number. Training texts are cut into
symbols once, as a table of their digests that all levels read; it goes before the texts are scored, which are then cut anew.

Keys move packed: a row is a run of keys that agree in their top bits, the part, with a column of bytes for each of their values. Spark deals and
sorts the rows by part; tasks sum, join and test a part's keys as arrays. There are so many parts that one has a bounded number of keys
at any size of the corpus, and what many texts repeat is summed before it moves, so a frequent word or context adds one key per slice of
the texts. A level is three moves: counts by stretch; what occurs ``LEAST`` times by the parent's stretch, for its probability
there; and by context, for the test. Each goes in turns by ranges of parts. The tables of a level, and the shuffle files and broadcasts behind them,
are deleted as soon as the next ones stand, and a level's own probabilities as soon as the next level has met them. Texts are scored in as many portions as
keep the keys that they ask for below ``ROOM`` bytes a symbol.

Edge cases: a null or empty text is one end symbol; without training texts N is 0 and every symbol has the probability
of the unknown; repeated rows each count and are each scored; a null doc_id has the part of the empty text, 0; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.llm.common import crc_part
from foldmark.session import forget, materialize, shuffle_partitions

HELD_OUT_PARTS = 10
LEAST = 2  # occurrences from which a context, or a symbol after it, counts
ADD = 0.1
DISCOUNT = 0.5
STRICT = 4.0  # standard deviations by which the ratio statistic must exceed its mean under equality
STRETCH = 1 << 20  # symbols that are counted or scored at a time
HEAD = 1 << 21  # keys of the tree that are broadcast, the most frequent
MARK_BITS = 27  # a bitmap has at most 2 to this bits
PART = 1 << 19  # symbols of the corpus for each part of the keys
PIECE = 3 << 20  # bytes of text that are cut into symbols and scored at a time, beside the head
CODED = 8 << 20  # bytes of text whose symbols are a row of the table that all levels read
HELD = 1 << 19  # keys that a task gathers before it deals them out
SHARE = 3  # a pass counts about a third of the corpus's places, or moves a third of the tree's keys, so that its shuffle files stay small beside the symbols
LIGHT = 1 << 22  # places that are counted in one pass in any case
PORTIONS = 2  # at least, of the texts by what they hold; one is scored at a time, for the same reason
ROOM = 4  # bytes a symbol of training that the keys asked for in a portion may take
CLEANUP, CODEC = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.parquet.compression.codec"
SETTINGS = {CLEANUP: "false", CODEC: "snappy"}
ROOT = np.uint64(0x9E3779B97F4A7C15)  # the empty context
END = xxhash.xxh64_intdigest(b" ", 42)  # no word has a space
PACKED = "part long, source long, a binary, b binary, c binary, d binary"
ENTRIES, STATES, WORDS, GIVEN = 0, 1, 2, -1  # sources of packed rows: symbols after contexts, contexts, words, and what others are joined with
U8, I8, F8, I4, U2 = (np.dtype(x) for x in ("<u8", "<i8", "<f8", "<i4", "<u2"))


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digests of the distinct words of all texts, A-Z in lower case, the place among them of each word, and where each text's end; null has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds, coded = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
    words, places = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), coded.indices.to_numpy()
    digests = np.fromiter(map(xxhash.xxh64_intdigest, words, itertools.repeat(42)), U8, len(words))
    bounds -= bounds[0]
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # white space at an end of a text splits off an empty word
        real = places != empty
        places, bounds = places[real], np.append(0, np.cumsum(real))[bounds]
    return digests, places, bounds[1:]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the words of all texts, and where each text's end."""
    digests, places, ends = coded_words(texts)
    return digests[places], ends


def _binary(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    """Runs of an array, as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of text, a text at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def _framed(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts, as end, words, end, and the bounds of each text."""
    stops = ends + 2 * np.arange(1, len(ends) + 1)
    bounds = np.append(0, stops)
    stream, inner = np.full(bounds[-1], END, U8), np.ones(bounds[-1], bool)
    inner[bounds[:-1]] = inner[stops - 1] = False
    stream[inner] = words
    return stream, bounds


CODES = "size long, words binary, ends binary, symbols binary"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols of some texts in a row: the digests of their distinct words, where each text's words end, and the place of each word among the digests.

    Of the places first come the low bytes, then the next, and so on, which packs better.
    """
    for batch in _pieces(batches, CODED):
        digests, places, ends = coded_words(batch.column("text"))
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (digests, ends.astype(I4), places.astype(I4).view(np.uint8).reshape(-1, 4).T)]
        yield pa.RecordBatch.from_arrays([pa.array([len(places) + 2 * len(ends)]), *columns], [x.split()[0] for x in CODES.split(", ")])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The symbol stream of about ``STRETCH`` symbols at a time, and per place the symbols of its text before it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> tuple[np.ndarray, np.ndarray]:
        stream, inside = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return stream, inside

    for batch in batches:
        for digests, ends, places in zip(*(batch.column(c) for c in ("words", "ends", "symbols"))):
            digests, ends, places = (np.frombuffer(x.as_buffer(), t) for x, t in ((digests, U8), (ends, I4), (places, np.uint8)))
            places = np.ascontiguousarray(places.reshape(4, -1).T).view(I4).ravel()
            stream, bounds = _framed(digests[places], ends.astype(np.int64))
            held.append((stream, np.arange(len(stream)) - np.repeat(bounds[:-1], np.diff(bounds))))
            if sum(len(x) for x, _ in held) >= STRETCH:
                yield out()
    if held:
        yield out()


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols of each text, 8 bytes each."""
    for batch in batches:
        stream, bounds = _framed(*words_of(batch.column("text")))
        columns = [*(batch.column(c) for c in ("row", "doc_id", "held_out")), pa.array(np.diff(bounds)), _binary(bounds, stream)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "size", "symbols"])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """The batches in slices of bounded size, their symbol stream, where each text starts in it, and per place the symbols before it."""
    for batch in batches:
        column = batch.column("symbols")
        bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64) // 8 if len(column) else np.zeros(1, np.int64)
        at = 0
        while at < batch.num_rows:
            n = min(max(1, int(np.searchsorted(bounds, bounds[at] + STRETCH, side="right")) - 1 - at), 1 << 16)
            first, sizes = bounds[at : at + n], np.diff(bounds[at : at + n + 1])
            stream, starts = np.frombuffer(column.buffers()[2], "<u8", int(sizes.sum()), 8 * int(first[0])), first - first[0]
            yield batch.slice(at, n), stream, starts, np.arange(len(stream)) - np.repeat(starts, sizes)
            at += n


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Digest of two digests in their order."""
    x = a * np.uint64(0xC2B2AE3D27D4EB4F) + b * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def entry(context: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Key of a symbol after a context; ``up`` is that of the symbol after the parent, or at the root the symbol."""
    return mix(~context, up)


def has(marks: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """By a bitmap over the top bits of keys: false for keys that are surely not marked."""
    bits, words = marks
    slot = keys >> np.uint64(64 - bits)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _kept(df: DataFrame, **settings: str) -> DataFrame:
    """A table in the shared folder; the shuffle files behind it are deleted when it stands."""
    conf = df.sparkSession.conf
    before = {name: conf.get(name, default) for name, default in SETTINGS.items()}
    for name, value in ({CLEANUP: "true"} | settings).items():
        conf.set(name, value)
    try:
        return materialize(df, "suffix")
    finally:
        for name, value in before.items():
            conf.set(name, value)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and where each distinct key begins in it."""
    order = np.argsort(keys)
    ranked = keys[order]
    return order, np.nonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)])[0]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct keys in their order, and the sums of n."""
    order, first = _runs(keys)
    return order[first], np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted keys among sorted ones, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


NAMES = ["part", "source", "a", "b", "c", "d"]


def _row(part: int, source: int, *columns: np.ndarray | None) -> pa.RecordBatch:
    """One packed row."""
    held = [pa.array([None if x is None else np.ascontiguousarray(x).tobytes()], pa.binary()) for x in columns + (None,) * (4 - len(columns))]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([source], pa.int64()), *held], NAMES)


def _cut(bits: int, source: int, key: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Packed rows of columns, a row for each part of the keys, which stand in the order of their parts."""
    edges = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    full = np.nonzero(np.diff(edges))[0]
    bounds = np.append(edges[full], len(key))
    held = [_binary(bounds, x) for x in columns] + [pa.nulls(len(full), pa.binary())] * (4 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(np.full(len(full), source)), *held], NAMES)


def _spread(bits: int, source: int, found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Columns in any order, of which the first are the keys, dealt out as packed rows."""
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held)]
        order = np.argsort((columns[0] >> np.uint64(64 - bits)).astype(np.uint32), kind="stable")
        columns = [x[order] for x in columns]
        return _cut(bits, source, columns[0], *columns)

    for columns in found:
        held.append(columns)
        if sum(len(x[0]) for x in held) >= HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, tuple[bytes | None, ...]]]:
    for batch in batches:
        part, source, *columns = (batch.column(c).to_pylist() for c in NAMES)
        yield from zip(part, source, zip(*columns))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """What stands in each part, as source and columns."""
    for part, rows in itertools.groupby(_rows(batches), key=lambda row: row[0]):
        yield part, [row[1:] for row in rows]


def _all(rows: list, source: int, *types: np.dtype | None) -> list[np.ndarray]:
    """The columns of a source, by their types; those without one are left out."""
    return [np.concatenate([np.zeros(0, t), *(np.frombuffer(x[i], t) for s, x in rows if s == source)]) for i, t in enumerate(types) if t]


def _dealt(df: DataFrame) -> DataFrame:
    """Packed rows in tasks by their part, and there in its order."""
    return df.repartition("part").sortWithinPartitions("part", "source")


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def _size(packed: DataFrame) -> int:
    """Keys of packed rows."""
    return (packed.agg(F.sum(F.octet_length("a"))).first()[0] or 0) // 8


def _marks(packed: DataFrame, bits: int, key: Callable[[np.ndarray, np.ndarray | None], np.ndarray] | None = None) -> tuple[int, np.ndarray]:
    """The bitmap of packed keys that stand in one row per part."""
    wide = min(MARK_BITS, max(bits + 6, (16 * _size(packed)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, columns in _rows(batches):
            keys = np.frombuffer(columns[0], U8)
            if key:
                keys = key(keys, np.frombuffer(columns[1], U8))
            found = np.zeros(1 << (wide - bits), bool)
            found[(keys >> np.uint64(64 - wide)).astype(np.int64) - (part << (wide - bits))] = True
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())], ["part", "marks"])

    rows = packed.mapInArrow(run, "part long, marks binary").toArrow()
    words, each = np.zeros(1 << (wide - 6), np.uint64), 1 << (wide - bits - 6)
    for part, found in zip(rows.column("part").to_pylist(), rows.column("marks").to_pylist()):
        words[part * each : (part + 1) * each] = np.frombuffer(found, U8)
    return wide, words


def _bounds(bits: int, turn: int, turns: int) -> tuple[int, int]:
    """The parts of a turn: the first, and the one behind the last."""
    return (turn << bits) // turns, (turn + 1 << bits) // turns


def _in_turn(packed: DataFrame, bits: int, turn: int, turns: int) -> DataFrame:
    low, high = _bounds(bits, turn, turns)
    return packed.filter((F.col("part") >= low) & (F.col("part") < high))


def _in_range(keys: np.ndarray, bits: int, turn: int, turns: int) -> np.ndarray:
    low, high = (x << (64 - bits) for x in _bounds(bits, turn, turns))
    return (keys >= np.uint64(low)) & (keys <= np.uint64(high - 1))


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream, inside in _decoded(batches):
            key, n = np.unique(stream[inside >= 1], return_counts=True)  # the start is a context, not a symbol of the text
            yield _cut(bits, WORDS, key, key, n)

    return run


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _parts(batches):
        keys, n = _all(rows, WORDS, U8, I8)
        at, n = _summed(keys, n)
        yield _row(part, WORDS, keys[at], n)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All occurrences of packed keys, and their kinds."""
    for _, _, columns in _rows(batches):
        n = np.frombuffer(columns[1], I8)
        yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([len(n)])], ["total", "kinds"])


def _often(of: int, log: Callable[[np.ndarray], np.ndarray] | None = None):
    """The words that occur often enough, with their logs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, columns in _rows(batches):
            keys, n = np.frombuffer(columns[0], U8), np.frombuffer(columns[1], I8)
            keys, n = keys[n >= LEAST], n[n >= LEAST]
            yield _row(part, of, keys, log(n) if log else n)

    return run


def _single(bits: int):
    """Contexts of one symbol with their totals, as words are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((np.frombuffer(x[0], U8), np.frombuffer(x[1], I8)) for _, _, x in _rows(batches))
        found = ((mix(np.full(int((n >= LEAST).sum()), ROOT), keys[n >= LEAST]), n[n >= LEAST]) for keys, n in every)
        yield from _spread(bits, STATES, found)

    return run


def _count_level(level: int, shared, bits: int, turn: int, turns: int):
    """Counts of contexts of ``level`` symbols below states, and of the symbols after them, with their keys after the parents.

    ``shared`` has the marks of the shorter states, by their length, and of the stretches of ``level`` symbols, at the first level words, that were counted
    often enough: stretches are counted below states. What is counted in this turn is an equal share of the parts.
    """

    def ours(keys: np.ndarray) -> np.ndarray:
        return _in_range(keys, bits, turn, turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, often = shared.value
        for stream, inside in _decoded(batches):
            at = np.nonzero(inside >= level - 1)[0]
            up, context = stream[at], np.full(len(at), ROOT)
            for k in range(1, level):
                if k > 1:
                    on = has(states[k - 2], context)
                    at, up, context = at[on], up[on], context[on]
                context = mix(context, stream[at - k])
                up = entry(context, up)
            again = has(often, up)
            before = np.ones(len(stream), bool)  # also where it was not counted
            before[at] = again
            live = (inside[at] >= level) & before[at - 1]
            if level > 1:
                live &= has(states[-1], context)
            at, up, context, again = at[live], up[live], context[live], again[live]
            context = mix(context, stream[at - level])
            if level > 1:  # the numbers of the words are known
                key, n = np.unique(context[ours(context)], return_counts=True)
                yield _cut(bits, STATES, key, key, n)
            context, up = context[again], up[again]
            keys = entry(context, up)
            if turns > 1:
                mine = ours(keys)
                keys, context, up = keys[mine], context[mine], up[mine]
            order, first = _runs(keys)
            one = order[first]
            yield _cut(bits, ENTRIES, keys[one], context[one], up[one], np.diff(np.append(first, len(order))).astype(I4))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What occurs often enough, of both kinds."""
    for part, rows in _parts(batches):
        context, up, n = _all(rows, ENTRIES, U8, U8, I4)
        at, n = _summed(entry(context, up), n)
        at, n = at[n >= LEAST], n[n >= LEAST]
        yield _row(part, ENTRIES, context[at], up[at], n)
        context, n = _all(rows, STATES, U8, I8)
        at, n = _summed(context, n)
        yield _row(part, STATES, context[at[n >= LEAST]], n[n >= LEAST])


def _asking(bits: int, turn: int, turns: int):
    """Counted symbols after contexts, dealt by their keys after the parents, as far as these have their turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (tuple(np.frombuffer(x, t) for x, t in zip(columns, (U8, U8, I8))) for _, _, columns in _rows(batches))
        mine = ((_in_range(up, bits, turn, turns), context, up, n) for context, up, n in every)
        yield from _spread(bits, ENTRIES, ((up[on], context[on], n[on]) for on, context, up, n in mine))

    return run


def _upper(bits: int):
    """Symbols after contexts whose parents are states, with the logs of their probability there, dealt by context."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for _, rows in _parts(batches):
            keys, log = _all(rows, GIVEN, U8, F8)
            order = np.argsort(keys)
            up, context, n = _all(rows, ENTRIES, U8, U8, I8)
            at, there = _at(keys[order], up)
            context, up = context[there], up[there]
            yield context, entry(context, up), n[there], log[order[at[there]]]

    return lambda batches: _spread(bits, ENTRIES, found(batches))


def _step(n: np.ndarray) -> np.ndarray:
    """A step of frequency."""
    return np.floor(8 * np.log2(n)).astype(np.int64)


def _test(rows: list) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The contexts of a part that the test retains (context, total, left), and the symbols after them (key, step, more, log)."""
    context, key, n, upper = _all(rows, ENTRIES, U8, U8, I8, F8)
    known, totals = _all(rows, STATES, U8, I8)
    if not len(context):
        return (context, n, upper), (key, n.astype(U2), upper, upper)
    order, first = _runs(context)
    key, n, upper, each = key[order], n[order], upper[order], np.diff(np.append(first, len(order)))
    context, own, k = context[order[first]], np.add.reduceat(n, first), each
    above = np.minimum(np.add.reduceat(10.0**upper, first), 1 - 1e-9)
    gain = np.add.reduceat(n * (np.log(n) - upper * math.log(10.0)), first)
    ranked = np.argsort(known)
    at, there = _at(known[ranked], context)
    total = np.where(there, totals[ranked[at]], own) if len(known) else own
    unseen = (total - own) / total
    other = np.where(unseen > 0, total * unseen * np.log(np.where(unseen > 0, unseen, 1) / (1 - above)), 0.0)
    kept = there & (2 * (gain - own * np.log(total) + other) > k + STRICT * np.sqrt(2 * k))
    left = np.log10(np.maximum(1 - (own - k * DISCOUNT) / total, 1e-12) / (1 - above))
    on = np.repeat(kept, each)
    key, n, upper = key[on], n[on], upper[on]
    log = np.log10((n - DISCOUNT) / np.repeat(total[kept], each[kept]))
    return (context[kept], total[kept], left[kept]), (key, _step(n).astype(U2), log - upper - np.repeat(left[kept], each[kept]), log)


def _grown(bits: int):
    """The tested contexts, and the symbols after them dealt by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []

        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for part, rows in _parts(batches):
                states, entries = _test(rows)
                out.append(_row(part, STATES, *states))
                yield entries

        for batch in _spread(bits, ENTRIES, found()):
            yield batch
            yield from out
            out.clear()
        yield from out

    return run


def learned(symbols: DataFrame) -> tuple[list[DataFrame], int, int, int, int]:
    """The tree of texts, given as their symbols, in packed tables; N, V, the longest context and the bits of parts.

    The tables have words (key, n), contexts (key, n, left) and symbols after contexts (key, step of frequency, more).
    """
    spark = symbols.sparkSession
    size = symbols.agg(F.sum("size")).first()[0] or 0
    bits = min(MARK_BITS - 7, (max(4 * shuffle_partitions(spark), size // PART) - 1).bit_length())
    symbols = symbols.drop("size")
    words = _kept(_dealt(symbols.mapInArrow(_count_words(bits), PACKED)).mapInArrow(_sum_words, PACKED))
    total, kinds = (x or 0 for x in words.mapInArrow(_totals, "total long, kinds long").agg(F.sum("total"), F.sum("kinds")).first())
    often = words.mapInArrow(_often(WORDS), PACKED)
    above = words.mapInArrow(_often(GIVEN, lambda n: np.log10((n + ADD) / (total + ADD * (kinds + 1)))), PACKED)
    marked = ([], _marks(often, bits))
    tree, newest, places = [words], [], size
    for length in itertools.count(1):
        shared = spark.sparkContext.broadcast(marked)
        turns = min(1 << bits, max(1, math.ceil(SHARE * places / max(1, size))), math.ceil(places / LIGHT) or 1)
        levels = [_kept(_dealt(symbols.mapInArrow(_count_level(length, shared, bits, t, turns), PACKED)).mapInArrow(_counted, PACKED)) for t in range(turns)]
        level = _union(levels)
        shared.destroy()  # also its files, on the driver's disk too
        pairs, totals = (level.filter(F.col("source") == s) for s in (ENTRIES, STATES))
        often = _marks(pairs, bits, entry)
        met = [_kept(_dealt(pairs.mapInArrow(_asking(bits, t, turns), PACKED).unionByName(_in_turn(above, bits, t, turns))).mapInArrow(_upper(bits), PACKED)) for t in range(turns)]
        for table in newest:
            tree.append(_kept(table.withColumn("d", F.lit(None).cast("binary"))))  # without the probabilities, which were met
            forget(table)
        if length > 1:
            met.append(_kept(totals))
        forget(*levels)
        rows = _union([*met, words.mapInArrow(_single(bits), PACKED)] if length == 1 else met)
        newest = [_kept(_dealt(_in_turn(rows, bits, t, turns)).mapInArrow(_grown(bits), PACKED)) for t in range(turns)]
        forget(*met)
        grown = _union(newest)
        states = grown.filter(F.col("source") == STATES)
        places = states.mapInArrow(_totals, "total long, kinds long").agg(F.sum("total")).first()[0]
        if not places:
            forget(*newest)
            return tree, total, kinds, length - 1, bits
        marked = ([*marked[0], _marks(states, bits)], often)
        entries = grown.filter(F.col("source") == ENTRIES)
        above = entries.select("part", F.lit(GIVEN).cast("long").alias("source"), "a", F.col("d").alias("b"), F.lit(None).cast("binary").alias("c"), F.lit(None).cast("binary").alias("d"))


def indexed(keys: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Sorted keys with the place of the first key of each value of their top bits."""
    shift = 64 - max(1, len(keys).bit_length())
    slots = np.arange((1 << (64 - shift)) + 1, dtype=np.uint64)
    return keys, shift, np.searchsorted(keys >> np.uint64(shift), slots)


def find(index: tuple[np.ndarray, int, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key among the indexed, -1 where it is missing."""
    keys, shift, first = index
    out = np.full(len(wanted), -1)
    slot = wanted >> np.uint64(shift)
    at, stop = first[slot], first[slot + np.uint64(1)]
    open_ = np.nonzero(at < stop)[0]
    at, stop, wanted = at[open_], stop[open_], wanted[open_]
    while len(open_):
        here = keys[at] == wanted
        out[open_[here]] = at[here]
        on = ~here & (at + 1 < stop)
        open_, at, stop, wanted = open_[on], at[on] + 1, stop[on], wanted[on]
    return out


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a tree: the part, whether these are words, keys, a step of their frequency, and what each adds to a score."""
    for part, source, columns in _rows(batches):
        if source == ENTRIES:
            n, step = None, np.frombuffer(columns[1], U2).astype(np.int64)
        else:
            n = np.frombuffer(columns[1], I8)
            step = _step(n)
        adds = np.log10((n + ADD) / ADD) if source == WORDS else np.frombuffer(columns[2], F8)
        yield part, source == WORDS, np.frombuffer(columns[0], U8), step, adds


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, step, _ in _values(batches):
        found, n = np.unique(step, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["s", "n"])


def _chosen(floor: int, top: bool):
    """The keys from a step of frequency on, or those below it: keys, what they add, and whether they are words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, keys, step, adds in _values(batches):
            on = (step >= floor) == top
            if on.any():
                yield _row(part, GIVEN, keys[on], adds[on], np.full(int(on.sum()), words))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _parts(batches):
        keys, adds, words = _all(rows, GIVEN, U8, F8, np.dtype(bool))
        order = np.argsort(keys)
        yield _row(part, GIVEN, keys[order], adds[order], words[order])


def _head(tree: DataFrame, bits: int, most: int = HEAD) -> tuple[tuple, list[DataFrame], tuple[int, np.ndarray], float]:
    """The most frequent keys in order, whether each is a word, and what it adds; tables of the other keys; the marks of these, and how often about they occur."""
    size, floor = 0, 1 << 20
    steps = sorted(map(tuple, tree.mapInArrow(_steps, "s long, n long").groupBy("s").agg(F.sum("n")).collect()), reverse=True)
    for s, n in steps:
        if size + n > most:
            break
        size, floor = size + n, s
    asked = sum(n * 2 ** ((s + 0.5) / 8) for s, n in steps if s < floor)
    top = tree.mapInArrow(_chosen(floor, True), PACKED).toArrow()
    keys, adds, words = (np.frombuffer(b"".join(top.column(c).to_pylist()), t) for c, t in zip("abc", (U8, F8, np.dtype(bool))))
    order = np.argsort(keys)
    turns = (tree.filter(F.pmod("part", F.lit(SHARE)) == t) for t in range(SHARE))
    rests = [_kept(_dealt(x.mapInArrow(_chosen(floor, False), PACKED)).mapInArrow(_merged, PACKED)) for x in turns]
    return (keys[order], words[order], adds[order]), rests, _marks(_union(rests), bits), asked


TEXTS = -2  # sources from here down are texts of a slice, those from 0 up the keys that a slice asks for


def _score(shared, levels: int, bits: int):
    """Of the texts of each slice what the head gives, and the keys to ask the rest for, with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, words, values), rest = shared.value
        index, of_root, of_more = indexed(keys), np.where(words, values, 0.0), np.where(words, 0.0, values)
        for batch, stream, starts, inside in _streams(_symbols(_pieces(batches, PIECE))):
            known, root, more = np.zeros(len(stream), np.int64), np.zeros(len(stream)), np.zeros(len(stream))
            asked: list[tuple[np.ndarray, np.ndarray]] = []  # places and their keys that may be in the rest

            def look(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Place in the head, and whether the key may be in the tree at all."""
                found = find(index, keys)
                other = (found < 0) & has(rest, keys)
                asked.append((at[other], keys[other]))
                return found, other | (found >= 0)

            at = np.nonzero(inside >= 1)[0]  # the start is a context, not a symbol of the text
            found, _ = look(at, stream[at])
            here = found >= 0
            known[at[here]], root[at[here]] = 1, of_root[found[here]]
            context, up = np.full(len(at), ROOT), stream.copy()
            for k in range(1, levels + 1):
                far = inside[at] >= k
                at = at[far]
                context = mix(context[far], stream[at - k])
                found, live = look(at, context)
                here = found >= 0
                more[at[here]] += of_more[found[here]]
                at, context = at[live], context[live]
                up[at] = entry(context, up[at])
                found, _ = look(at, up[at])
                here = found >= 0
                more[at[here]] += of_more[found[here]]
            place, key = (np.concatenate(x) for x in zip(*asked))
            text = np.searchsorted(starts, place, side="right") - 1
            order = np.argsort(key)
            piece = batch.column("row")[0].as_py()  # names the slice
            doc_id, held_out = batch.column("doc_id"), batch.column("held_out").to_numpy(zero_copy_only=False)
            facts = doc_id.is_null().to_numpy(zero_copy_only=False), held_out, np.diff(np.append(starts, len(stream))) - 1, np.add.reduceat(known, starts)
            facts = np.stack([pc.fill_null(doc_id, 0).to_numpy(), *facts]).astype(I8)
            yield _row(piece % (1 << bits), TEXTS - piece, facts, np.stack([np.add.reduceat(root, starts), np.add.reduceat(more, starts)]))
            yield _cut(bits, piece, key[order], key[order], text[order].astype(U2))

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each slice as they are (source 0), and what the keys they asked for add to them (source 1), by slice."""
    sums: dict[int, list[tuple[np.ndarray, ...]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for piece, found in sums.items():
            text, known, root, more = (np.concatenate(x) for x in zip(*found))
            texts, at = np.unique(text, return_inverse=True)
            yield _row(piece, 1, texts.astype(I8), *(np.bincount(at, x, len(texts)) for x in (known, root, more)))

    for _, rows in _parts(batches):
        keys, adds, words = _all(rows, GIVEN, U8, F8, np.dtype(bool))
        for source, columns in rows:
            if source <= TEXTS:
                yield _row(TEXTS - source, 0, *(np.frombuffer(x, U8) for x in columns[:2]))
            elif source >= 0:
                wanted, text = (np.frombuffer(x, t) for x, t in zip(columns, (U8, U2)))
                at, there = _at(keys, wanted)
                at, text = at[there], text[there]
                if len(at):
                    of, add = words[at], adds[at]
                    sums.setdefault(source, []).append((text, of, np.where(of, add, 0.0), np.where(of, 0.0, add)))
                    size += len(at)
        if size > HELD:
            yield from out()
            sums.clear()
            size = 0
    yield from out()


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sum_up(total: int, unknown: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _parts(batches):
            facts, sums = _all(rows, 0, I8, F8)
            doc_id, null, held_out, n, known = facts.reshape(5, -1)
            root, more = sums.reshape(2, -1)
            text, *added = _all(rows, 1, I8, F8, F8, F8)
            on_known, on_root, on_more = (np.bincount(text, x, len(n)) for x in added)
            base = n * unknown + root + on_root
            columns = [
                pa.array(doc_id, mask=null > 0), pa.array(held_out > 0), pa.array(n), pa.array(known + np.rint(on_known).astype(np.int64)),
                pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(base + more + on_more),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])

    return run


def scored(docs: DataFrame, parts: int = HELD_OUT_PARTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row of ``docs``."""
    part = crc_part(F.col("doc_id"), parts)
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (part == 0).alias("held_out"), text)
    symbols = _kept(rows.filter("not held_out").select("text").mapInArrow(_coded, CODES), **{CODEC: "zstd"})
    tables, total, kinds, levels, bits = learned(symbols)
    forget(symbols)
    head, rests, marks, asked = _head(_union(tables), bits)
    forget(*tables)
    shared, rest, sums = docs.sparkSession.sparkContext.broadcast((head, marks)), _union(rests), []
    portions = max(PORTIONS, math.ceil((U8.itemsize + U2.itemsize) * asked / (ROOM * max(1, total))))
    for p in range(portions):
        portion = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(portions)) == p).withColumn("row", F.col("row") * portions + p)
        local = portion.mapInArrow(_score(shared, levels, bits), PACKED)
        sums.append(_kept(_dealt(local.unionByName(rest)).mapInArrow(_answered, PACKED)))
    shared.destroy()
    forget(*rests)
    unknown = math.log10(ADD / (total + ADD * (kinds + 1)))
    return _dealt(_union(sums)).mapInArrow(_sum_up(total, unknown), RESULT)
