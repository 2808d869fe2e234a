"""SimHash near-duplicates through a hierarchical index over Gray-ordered fingerprints.

The index has nodes that hold the bits all their members share (mask and pattern). Its first level stands on the
cluster: a fingerprint is cut into six segments, and each choice of two segments is a mask. Four differing bits
touch at most four segments, so any two linked fingerprints agree on at least two of them and meet in at least one
first-level node, whatever the data. Below a node, fingerprints are sorted by Gray rank, cut into leaves, and
masked patterns are factored upwards; two groups are compared only while the differences of their shared bits stay
within the radius.

A node with more members than one task should hold is cut into cells; every pair of cells is a task of its own, so
nothing is lost. Tasks return spanning links, not pairs, and a distributed star contraction joins them up.

Edge cases: null and white-space-only texts have fingerprint zero and link like any other; copies share one
fingerprint and are indexed once; repeated rows each get a row; rows without doc_id never name a component unless
they have nothing else, then it is null; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldmark.session import materialize

SEED = 42
BITS = 64
CELL = 20_000  # members of a first-level node that one task compares with as many others
LEAF = 32
FAN = 8
CHUNK = 65_536  # shingles whose bits are counted at a time


def fingerprint_of(text: str | None, width: int = 4) -> int:
    """SimHash of the word shingles of one text, as a signed 64-bit number."""
    tokens = (text or "").encode().lower().split()  # bytes lower only A-Z and split at ASCII white space
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > width:
        starts, ends = starts[: len(tokens) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashes = (xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist()))
    ones = np.zeros(BITS, np.int64)
    while len(block := np.fromiter(islice(hashes, CHUNK), np.uint64)):
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    high = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(high, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series, width: pd.Series) -> pd.Series:
    n = int(width.iloc[0]) if len(width) else 4
    return pd.Series([fingerprint_of(t, n) for t in texts], dtype="int64")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if np.array_equal(up, at):
            return at
        at = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook the larger root of every link below the smaller one until all links are within one tree."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of the nodes per level, leaves first; mask has the bits that all codes below share."""
    at = np.arange(0, len(codes), LEAF)
    both, any_ = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
    out = [(~(both ^ any_), both)]
    while len(both) > 1:
        at = np.arange(0, len(both), FAN)
        both, any_ = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(any_, at)
        out.append((~(both ^ any_), both))
    return out


def components(codes: np.ndarray, radius: int) -> np.ndarray:
    """For distinct codes in Gray order: position of the smallest member of each code's component."""
    parent = np.arange(len(codes))
    levels = _levels(codes)
    left = right = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        mask, pattern = levels[depth]
        apart = np.bitwise_count((pattern[left] ^ pattern[right]) & mask[left] & mask[right])
        near = apart <= radius  # differences that the shared bits already make certain
        left, right = left[near], right[near]
        if depth:
            below = len(levels[depth - 1][0])
            i = (left[:, None] * FAN + np.repeat(np.arange(FAN), FAN)).ravel()
            j = (right[:, None] * FAN + np.tile(np.arange(FAN), FAN)).ravel()
            real = (i <= j) & (j < below)
            left, right = i[real], j[real]
    order = np.argsort(right - left, kind="stable")  # near leaves first, so that far ones are often united already
    left, right = left[order], right[order]
    whole = np.full(len(levels[0][0]) * LEAF, -1, np.int64)
    within = np.arange(LEAF)
    for start in range(0, len(left), 4096):
        i, j = left[start : start + 4096], right[start : start + 4096]
        whole[: len(codes)] = _roots(parent, np.arange(len(codes)))
        whole[len(codes) :] = whole[len(codes) - 1]
        trees = whole.reshape(-1, LEAF)
        one = (trees == trees[:, :1]).all(axis=1)
        todo = ~(one[i] & one[j] & (trees[i, 0] == trees[j, 0]))
        a = (i[todo, None] * LEAF + within)[:, :, None]
        b = (j[todo, None] * LEAF + within)[:, None, :]
        last = len(codes) - 1
        differ = np.bitwise_count(codes[np.minimum(a, last)] ^ codes[np.minimum(b, last)])
        x, y, z = np.nonzero((differ <= radius) & (a <= last) & (b <= last))
        _unite(parent, a[x, y, 0], b[x, 0, z])
    return _roots(parent, np.arange(len(codes)))


def _small_components(groups: np.ndarray, codes: np.ndarray, radius: int) -> np.ndarray:
    """The same for many groups of at most LEAF codes each, one leaf per group, all at once."""
    parent = np.arange(len(codes))
    for gap in range(1, LEAF):
        a = np.nonzero(groups[gap:] == groups[:-gap])[0]
        if not len(a):
            break
        a = a[np.bitwise_count(codes[a] ^ codes[a + gap]) <= radius]
        _unite(parent, a, a + gap)
    return _roots(parent, np.arange(len(codes)))


def _links(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Spanning links of complete nodes: each code with the first of its component."""
    keys = frame[["node", "cell"]].to_numpy()
    codes = frame["code"].to_numpy().view(np.uint64)
    new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    order = np.lexsort((gray_rank(codes), group))
    codes = codes[order]
    small = size[group] <= LEAF
    first = np.arange(len(codes))
    at = np.nonzero(small)[0]
    first[at] = at[_small_components(group[at], codes[at], radius)] if len(at) else at
    starts = np.nonzero(new)[0]
    for g in np.nonzero(size > LEAF)[0].tolist():
        span = slice(starts[g], starts[g] + size[g])
        first[span] = starts[g] + components(codes[span], radius)
    linked = first != np.arange(len(codes))
    a, b = codes[first[linked]].view(np.int64), codes[linked].view(np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _index(radius: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in filter(len, frames):
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = (frame["node"] == frame["node"].iloc[-1]) & (frame["cell"] == frame["cell"].iloc[-1])
            rest, done = frame[last], frame[~last]
            if len(done):
                yield _links(done, radius)
        if rest is not None and len(rest):
            yield _links(rest, radius)

    return run


def _nodes(codes: DataFrame, radius: int) -> DataFrame:
    """Each code once for every first-level node it lies in: the mask's number and the masked pattern."""
    segments = radius + 2
    cut = [BITS * i // segments for i in range(segments + 1)]

    def segment(i: int) -> Column:
        width = cut[i + 1] - cut[i]
        return F.shiftrightunsigned("code", cut[i]).bitwiseAND(F.lit((1 << width) - 1))

    names = []
    for number, (i, j) in enumerate(combinations(range(segments), 2)):
        pattern = F.shiftleft(segment(i), cut[j + 1] - cut[j]) + segment(j)
        names.append(F.lit(number << 40) + pattern)
    return codes.select("code", F.explode(F.array(*names)).alias("node"))


def links(codes: DataFrame, radius: int = 4, cell: int = CELL) -> DataFrame:
    """Links (a, b) over distinct ``code`` that span every component of codes within ``radius`` bits."""
    nodes = _nodes(codes, radius)
    crowded = (
        nodes.groupBy("node").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > cell)
        .select("node", F.ceil(F.col("members") / cell).cast("int").alias("cells"))
    )
    placed = nodes.join(crowded, "node", "left")
    own = F.pmod(F.xxhash64("code"), F.col("cells").cast("long"))
    other = F.sequence(F.lit(0).cast("long"), F.col("cells").cast("long") - 1)
    pair = F.transform(other, lambda j: F.least(own, j) * (1 << 30) + F.greatest(own, j))
    cells = F.when(F.col("cells").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pair)
    placed = placed.select("node", F.explode(cells).alias("cell"), "code")
    dealt = placed.repartition("node", "cell").sortWithinPartitions("node", "cell")
    return dealt.mapInPandas(_index(radius), "a long, b long").distinct()


def contract(edges: DataFrame, label: str = "simhash") -> DataFrame:
    """Connected components by alternating star contraction: (node, root) for every node that is not its root."""
    now = materialize(edges, label)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        large = materialize(large, label)
        down = large.select(F.col("b").alias("n"), F.col("a").alias("low"))
        least = down.groupBy("n").agg(F.min("low").alias("m"))
        small = down.join(least, "n").select(F.col("m").alias("a"), F.col("low").alias("b")).filter("a < b")
        now = materialize(small.unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct(), label)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = state


def classes(docs: DataFrame, radius: int = 4, width: int = 4, cell: int = CELL) -> DataFrame:
    """(doc_id, code, root, component_id) per row of ``docs``; links are fingerprints within ``radius`` bits."""
    rows = materialize(docs.select("doc_id", fingerprint("text", F.lit(width)).alias("code")), "simhash")
    codes = materialize(rows.groupBy("code").agg(F.min("doc_id").alias("first")), "simhash")
    stars = contract(links(codes.select("code"), radius, cell))
    rooted = codes.join(stars, codes["code"] == stars["node"], "left").select(
        F.col("code").alias("of"), "first", F.coalesce("root", "code").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = materialize(rooted.join(named, "root").select("of", "root", "component_id"), "simhash")
    return rows.join(member, rows["code"] == member["of"]).select("doc_id", "code", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits and component_id, the smallest doc_id of all that links reach."""
    code = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return classes(docs, radius, width).select("doc_id", code.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that with the smallest doc_id.

    Of several rows with that doc_id in the component, and of a component without any doc_id, the least row stays.
    """
    found = materialize(classes(docs, radius, width), "simhash")
    lead = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows"), F.max(lead).alias("_leads"))
    ids = ids.filter("_leads").withColumn("_plain", F.expr("_rows = 1 and _id is not null")).drop("_leads")
    marked = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]))
    plain = marked.filter("_plain").select(*[docs[c] for c in docs.columns])
    if ids.filter("not _plain").isEmpty():
        return plain
    again = marked.filter("not _plain").select(*[docs[c] for c in docs.columns]).withColumn(
        "_code", fingerprint("text", F.lit(width))
    )
    leads = found.filter(lead).select(F.col("doc_id").alias("_id"), F.col("code").alias("_of"), F.col("root").alias("_root"))
    leads = leads.distinct()
    same = again["doc_id"].eqNullSafe(leads["_id"]) & (again["_code"] == leads["_of"])
    least = again.join(leads, same).groupBy("_root").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return plain.unionByName(least.select("_row.*"))
