"""Edit embedding: the vectorised walk against a plain walker, pairs and classes against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from foldmark.llm import edit_embedding as ee

SHAPE = "doc_id long, text string, slice string, guest int, fingerprint string, n_chars long"


def digest(x):
    mask = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & mask
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
    return x ^ x >> 31


def plain_fingerprint(text):
    """Step by step, with all priorities drawn from the same rule of least steps."""
    notes = []
    for at in range(0, len(text), ee.STRETCH):
        piece = text[at : at + ee.STRETCH]
        place = 0
        for t in range(2 * len(piece) + 2 * math.isqrt(len(piece))):
            key = digest(ord(piece[place])) if place < len(piece) else 0
            notes.append(key)
            move = key * (digest(t + (ee.SEED << 32)) | 1) & ((1 << 64) - 1)
            place += move >> 63
    bits = 0
    for b in range(ee.BITS):
        step = max((s for s in ee.LEAST[:, b].tolist() if s < len(notes)), default=None)
        bit = 0 if step is None else (notes[step] * (digest(b + (ee.SEED << 40)) | 1) & ((1 << 64) - 1)) >> 63
        bits = bits << 1 | bit
    return f"{bits:0{ee.BITS // 4}x}"


def prose(rng, words):
    return " ".join("".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(1, 9))) for _ in range(words))


def test_walk_of_any_length():
    rng = random.Random(1)
    texts = ["", "a", "ab", "\0", "Straße 中文 \U0001f600", prose(rng, 40), prose(rng, 2_500), prose(rng, 5_000), "x" * (2 * ee.STRETCH)]
    got = [m.tobytes().hex() for m in ee.fingerprints(texts)]
    assert got == [plain_fingerprint(t) for t in texts]
    assert [m.tobytes().hex() for m in ee.fingerprints(texts[::-1])] == got[::-1]
    assert ee.fingerprints([]).shape == (0, ee.BITS // 8)


def test_samples_are_even_and_consistent():
    low, high = ee.sampled(1_000), ee.sampled(1_500)
    assert low.max() < 1_000 and abs(low.mean() - 500) < 40 and len(set(low.tolist())) > 550
    assert np.all((high == low) | (high >= 1_000)) and abs((high == low).mean() - 2 / 3) < 0.06


def test_likeness_follows_edits():
    rng = random.Random(2)
    text = prose(rng, 600)
    other = prose(rng, 600)
    few = list(text)
    for _ in range(12):
        at = rng.randrange(len(few))
        few[at : at + 1] = rng.choice(["", "q", few[at] + "z"])
    half = ee.edited_text(text, other)
    marks = ee.fingerprints([text, "".join(few), half, other])
    near = [float(ee.likeness(marks[:1], marks[k : k + 1])[0]) for k in range(4)]
    assert near[0] == 1.0 and near[1] > 0.75 and 0.4 < near[2] < 0.72 and near[3] < 0.25


def brute_pairs(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = (plain_fingerprint(t) for t in (text, changed, following))
        likes = [max(0.0, 1 - 2 / ee.BITS * (int(a, 16) ^ int(x, 16)).bit_count()) for x in (b, c)]
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, *likes))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_rows", [2_000, 3])
def test_pairs_against_brute_force(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(ee, "SLICE_ROWS", slice_rows)
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in rng.sample(range(-50, 1 << 40), 25)]
    rows += [(7, "same"), (7, "same"), (7, "other"), (None, "no id"), (None, None), (8, None), (9, ""), (10, "é" * 9_000)]
    docs = spark.createDataFrame([(i, t, "s", 1, "f", 3) for i, t in rows], SHAPE).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = sorted(map(tuple, ee.edited(docs).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_pairs(rows)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "abcdef", "s", 1, "f", 3)], SHAPE)
    (row,) = ee.edited(docs).collect()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    assert ee.edited(docs.filter("false")).collect() == []
    assert ee.near_duplicates(docs.filter("false")).collect() == []


def test_classes_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for g in range(6):
        base = prose(rng, 300)
        for k in range(8):
            at = rng.randrange(len(base))
            rows.append((len(rows), base if k < 2 else base[:at] + "#" + base[at + 1 :]))
    rows += [(None, rows[0][1]), (100, ""), (101, None), (102, "lonely text"), (None, prose(rng, 50))]
    marks = ee.fingerprints([t or "" for _, t in rows])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    most = math.floor((1 - ee.NEAR) / 2 * ee.BITS)
    for i in range(len(rows)):
        for j in range(i):
            if int(np.bitwise_count(marks[i] ^ marks[j]).sum()) <= most:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    want = sorted(((d, marks[i].tobytes().hex(), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)
    docs = spark.createDataFrame([(i, t, "s", 1, "f", 3) for i, t in rows], SHAPE).repartition(4)
    for cell in (ee.CELL, 2):
        assert sorted(map(tuple, ee.near_duplicates(docs, cell=cell).collect()), key=str) == want
