"""Document fingerprints from a randomised edit embedding.

A walker reads a text from its beginning. At step t it notes the character it stands on, and a bit drawn from (t, character)
says whether it moves on. The draws are the same for all texts, so two walkers on equal characters move alike; after
an edit they drift until they stand on equal characters again, within some d * d steps for a shift of d. The
notes are the embedding: its Hamming distance follows the edit distance. A text of n characters is walked
for 2 n + 2 sqrt(n) steps; beyond its end, the walker notes an end sign. Texts of more than ``STRETCH`` characters are walked in stretches, all at
the same time, each by the same draws.

The fingerprint has ``BITS`` bits, each a hash bit of the note at one sampled step. Sample b has a priority for every
step, and takes the step of least priority among those of the text. The steps that are a least so far are drawn directly
(after step i the next one lies beyond k with probability i / k), so the sample is consistent for texts of any length:
texts of equal length are compared at the same steps, others at the same steps in proportion to their lengths. The likeness of two
fingerprints is 1 less twice their share of different bits, 0 at least: an estimate of the share of equal notes, with a standard error of at most 1 / 32.

Near documents (``near_duplicates``) are found in bands of sampled bits: distinct fingerprints that agree on all bits of a band
meet in a bucket and are compared bit by bit. Buckets of any size are cut into cells, every pair of cells is a task, tasks return
spanning links, and star contraction joins these.

``edited`` pairs each document with the next by falling doc_id. Documents are dealt by bounds of doc_id into slices; each
slice is read in order as a stream, with the head of the next slice after its last document. So texts move once.

Edge cases: null texts are empty; an empty text has no notes and the fingerprint zero; rows without a doc_id come
last; rows with one doc_id go by falling text, and equal rows are next to each other; a document alone is its own next; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.llm.simhash import _roots, _unite, contract
from foldmark.session import materialize

BITS = 1024
SEED = 11
STRETCH = 8_192  # characters that one walker reads
CELLS = 1 << 23  # notes held at a time, steps by walkers
WIDTH = 4_096  # walkers at a time
SLICE_ROWS = 2_000
SLICES = 65_536  # bounds of slices, at most
BAND_BITS = 32
NEAR = 0.9  # likeness from which documents are near; at it a band agrees with probability 0.19, one of 32 with 0.999
CELL = 4_000  # fingerprints of a bucket that one task compares with as many others
U64 = np.uint64
NEVER = np.int64(2**62)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit digests of numbers."""
    x = x.astype(U64) + U64(0x9E3779B97F4A7C15)
    x = (x ^ x >> U64(30)) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U64(27)) * U64(0x94D049BB133111EB)
    return x ^ x >> U64(31)


def steps_of(n: int) -> int:
    return 2 * n + 2 * math.isqrt(n)


FULL = steps_of(STRETCH)
MOVES = mixed(np.arange(FULL) + (SEED << 32)) | U64(1)
NOTES = mixed(np.arange(BITS) + (SEED << 40)) | U64(1)


def least_steps() -> np.ndarray:
    """Per sample, in rising order, the steps whose priority is below that of all steps before; padded with NEVER."""
    rows = [np.zeros(BITS, np.int64)]
    while rows[-1].min() < NEVER:
        draw = ((mixed(np.arange(BITS) + (SEED << 48) + (len(rows) << 20)) >> U64(11)).astype(np.float64) + 1.0) / 2.0**53
        at = np.floor((rows[-1] + 1.0) / draw)
        rows.append(np.where(at < NEVER, np.minimum(at, 2.0**62), 2.0**62).astype(np.int64))
    return np.array(rows)


LEAST = least_steps()


def sampled(steps: int) -> np.ndarray:
    """The step each sample takes of a text with this many."""
    rows = LEAST[: np.searchsorted(LEAST.min(axis=1), steps)]
    return rows[(rows < steps).sum(axis=0) - 1, np.arange(BITS)]


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of BITS / 8 bytes per text."""
    bits = np.zeros((len(texts), BITS), np.uint8)
    owner, start, size = [], [], []
    for i, text in enumerate(texts):
        for at in range(0, len(text), STRETCH):
            owner.append(i)
            start.append(at)
            size.append(min(STRETCH, len(text) - at))
    order = sorted(range(len(owner)), key=lambda k: -size[k])
    at = 0
    while at < len(order):
        group = order[at : at + max(1, min(WIDTH, CELLS // steps_of(size[order[at]])))]
        _walk(texts, [owner[k] for k in group], [start[k] for k in group], np.array([size[k] for k in group]), bits)
        at += len(group)
    return np.packbits(bits, axis=1)


def _walk(texts: list[str], owner: list[int], start: list[int], size: np.ndarray, bits: np.ndarray) -> None:
    """Walk stretches, the longest first, and set the bits sampled from them."""
    signs = "\0".join([texts[i][a : a + n] for i, a, n in zip(owner, start, size.tolist())]) + "\0"
    keys = mixed(np.frombuffer(signs.encode("utf-32-le"), np.uint32))
    first = np.append(0, np.cumsum(size + 1)[:-1])
    keys[first + size] = 0  # the end sign: never moves
    steps = 2 * size + 2 * np.array([math.isqrt(n) for n in size.tolist()])
    live = np.searchsorted(-steps, -np.arange(steps[0]), side="left").tolist()  # walkers with more steps than t
    notes = np.empty((steps[0], len(size)), np.int32)
    place, seen = first.copy(), np.empty(len(size), U64)
    for t, n in enumerate(live):
        here, key = place[:n], seen[:n]
        notes[t, :n] = here
        np.take(keys, here, out=key)
        np.multiply(key, MOVES[t], out=key)
        np.right_shift(key, 63, out=key)
        np.add(here, key.view(np.int64), out=here)
    for k, (i, a) in enumerate(zip(owner, start)):
        text = len(texts[i])
        step = sampled(text // STRETCH * FULL + steps_of(text % STRETCH)) - a // STRETCH * FULL
        b = np.nonzero((step >= 0) & (step < steps[k]))[0]
        bits[i, b] = keys[notes[step[b], k]] * NOTES[b] >> U64(63)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of fingerprints row by row, 0 to 1."""
    return np.maximum(0.0, 1.0 - 2.0 / BITS * np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64))


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the next row of their slice; the last row of a slice is only the next of the one before."""
    held: tuple | None = None  # slice, doc_id, text, fingerprint of a row whose next is still to come
    for batch in batches:
        ids, slices, texts = (batch.column(c).to_pylist() for c in ("doc_id", "slice", "text"))
        guests = batch.column("guest").to_pylist() + [False]
        marks = fingerprints(texts)
        if held:
            slices, ids, texts, guests = [held[0], *slices], [held[1], *ids], [held[2], *texts], [False, *guests]
            marks = np.vstack((held[3], marks))
        last = len(ids) - 1
        own = [k for k in range(last) if not guests[k]]
        held = None if last < 0 or guests[last] else (slices[last], ids[last], texts[last], marks[last:])
        if not own:
            continue
        changed = [edited_text(texts[k], texts[k + 1]) for k in own]
        new = fingerprints(changed)
        at = np.array(own)
        columns = [
            pa.array([ids[k] for k in own], pa.int64()), pa.array([len(texts[k]) for k in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([m.tobytes().hex() for m in marks[at]]),
            pa.array([m.tobytes().hex() for m in new]), pa.array(likeness(marks[at], new)), pa.array(likeness(marks[at], marks[at + 1])),
        ]
        yield pa.RecordBatch.from_arrays(columns, NAMES)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _sliced(rows: DataFrame) -> DataFrame:
    """Add ``slice``, which never decreases with doc_id and is -1 without one; a function of doc_id alone."""
    slices = min(SLICES, max(1, -(-rows.count() // SLICE_ROWS)))
    at = [i / slices for i in range(1, slices)]
    bounds = rows.agg(F.percentile_approx("doc_id", at, max(10_000, 4 * slices)).alias("b")).first()["b"] if at else None
    splits = [-math.inf, *sorted({float(b) for b in bounds or []}), math.inf]
    if len(splits) == 2:
        number = F.lit(0)
    else:
        rows = Bucketizer(splits=splits, inputCol="_id", outputCol="slice", handleInvalid="keep").transform(rows.withColumn("_id", F.col("doc_id").cast("double")))
        number = F.col("slice")
    return rows.withColumn("slice", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(number).cast("int")).drop("_id")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next per row of ``docs``."""
    rows = _sliced(_plain(docs))
    heads = rows.groupBy("slice").agg(F.max("doc_id").alias("head")).collect()  # a row per slice
    order = sorted(((r["slice"], r["head"]) for r in heads), reverse=True)
    serves = [(here, slice_, head) for (here, _), (slice_, head) in zip(order, order[1:] + order[:1])]
    following = rows.sparkSession.createDataFrame(serves, "serves int, _slice int, _head long")
    same = (F.col("slice") == F.col("_slice")) & F.col("doc_id").eqNullSafe(F.col("_head"))
    guests = rows.join(F.broadcast(following), same).groupBy("serves", "_head").agg(F.max("text").alias("text"))  # a row per slice
    guests = guests.select(F.col("_head").alias("doc_id"), "text", F.col("serves").alias("slice"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition("slice")
    falling = [F.col("slice").desc(), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    return dealt.sortWithinPartitions(*falling).select("doc_id", "text", "slice", "guest").mapInArrow(_pairs, PAIRED)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint, as hex digits, per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = fingerprints(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m.tobytes().hex() for m in marks], pa.string())], ["doc_id", "fingerprint"])

    return _plain(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _bucket_links(most: int):
    """Spanning links of the fingerprints of complete buckets that differ in at most ``most`` bits."""

    def links(ids: np.ndarray, marks: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parent = np.arange(len(ids))
        starts = np.nonzero(np.append(True, group[1:] != group[:-1]))[0]
        for a, z in zip(starts.tolist(), np.append(starts[1:], len(ids)).tolist()):
            for k in range(a, z - 1):
                near = np.nonzero(np.bitwise_count(marks[k + 1 : z] ^ marks[k]).sum(axis=1, dtype=np.int64) <= most)[0] + k + 1
                _unite(parent, np.full(len(near), k), near)
        root = _roots(parent, np.arange(len(ids)))
        linked = root != np.arange(len(ids))
        a, b = ids[root[linked]], ids[linked]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            group = np.array([hash(k) for k in zip(*(table.column(c).to_pylist() for c in ("band", "bits", "cell")))])
            last = group == group[-1]
            cut = len(group) - int(np.argmin(last[::-1])) if not last.all() else 0
            rest = table.slice(cut)
            if cut:
                yield _found(table.slice(0, cut), group[:cut])
        if rest is not None:
            yield _found(rest, np.zeros(rest.num_rows))

    def _found(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        marks = np.frombuffer(bytes.fromhex("".join(table.column("fingerprint").to_pylist())), U64).reshape(-1, BITS // 64)
        a, b = links(table.column("id").to_numpy(), marks, group)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def band_links(marks: DataFrame, near: float = NEAR, cell: int = CELL) -> DataFrame:
    """Links (a, b) over (id, fingerprint), distinct fingerprints, that span all that meet in a band and are near."""
    width = BAND_BITS // 4
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.substring("fingerprint", k * width + 1, width).alias("bits")) for k in range(BITS // BAND_BITS)])
    placed = marks.select("id", F.inline(bands))
    crowd = placed.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    crowd = crowd.select("band", "bits", F.ceil(F.col("members") / cell).cast("int").alias("cells"))
    placed = placed.join(crowd, ["band", "bits"])
    own = F.pmod(F.xxhash64("id"), F.col("cells").cast("long"))
    other = F.sequence(F.lit(0).cast("long"), F.col("cells").cast("long") - 1)
    cells = F.transform(other, lambda j: F.least(own, j) * (1 << 30) + F.greatest(own, j))
    placed = placed.select("band", "bits", "id", F.explode(cells).alias("cell")).join(marks, "id")
    dealt = placed.repartition("band", "bits", "cell").sortWithinPartitions("band", "bits", "cell", "id")
    most = math.floor((1.0 - near) / 2.0 * BITS)
    return dealt.select("band", "bits", "cell", "id", "fingerprint").mapInArrow(_bucket_links(most), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, near: float = NEAR, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint and class_id, the smallest doc_id that links of likeness ``near`` or more reach.

    A class without any doc_id has a null class_id.
    """
    rows = materialize(fingerprinted(docs), "edit-embedding")
    marks = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).withColumn("id", F.monotonically_increasing_id())
    marks = materialize(marks, "edit-embedding")
    stars = contract(band_links(marks.select("id", "fingerprint"), near, cell), "edit-embedding")
    rooted = marks.join(stars, marks["id"] == stars["node"], "left").select(F.col("fingerprint").alias("of"), "first", F.coalesce("root", "id").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    member = materialize(rooted.join(named, "root").select("of", "class_id"), "edit-embedding")
    return rows.join(member, rows["fingerprint"] == member["of"]).select("doc_id", "fingerprint", "class_id")
