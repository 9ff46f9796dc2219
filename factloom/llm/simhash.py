"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Fingerprints link at RADIUS or fewer
differing bits. The 64 bits are cut in 4 blocks; two linked fingerprints agree on at least 2 of them, so distinct fingerprints meet
in one of 6 tables under 32 agreeing bits. Buckets over BUCKET are keyed again by the other bits in 3 parts (one of which agrees), and what is still
larger is compared part by part with every part. Rows of a task are sorted by bucket and compared in runs of whole buckets: bit planes of
a run stand vertically, 64 fingerprints to a word, carry-save counters add up 64 distances at once, and blocks in which all distances exceed the radius are left.
A run gives only the links of a spanning forest, so links never grow with the square of a group.

Nulls and edges: a null text is the empty text, whose fingerprint is zero, linked like any other. Each row gives one row; null
doc_ids are members but never a component's id (a component of null ids only has a null id). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column, join_facts, slices, text_or_empty, written
from factloom.llm.components import components

RADIUS = 2
BUCKET = 8192
RUN = 4096
SHIFTS = (0, 16, 32, 48)
#: Shingles counted at once.
PART = 1 << 15


def shingle_hashes(text: bytes, size: int = 3, seed: int = 42) -> np.ndarray:
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.cumsum(lens) - lens
    ends = (starts + lens - 1)[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends)), dtype=np.uint64, count=len(ends))


def fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), PART):
        raw = hashes[at : at + PART].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = column(batch, "text").cast(pa.binary())
            found = np.array([fingerprint(shingle_hashes(t.as_py(), size, seed)) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words; bit j of word w in row i is bit i of fingerprint 64 w + j."""
    padded = np.zeros(-(-len(fps) // 64) * 64, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The places (in left, in right) of all fingerprints that differ in at most `radius` (3 at most) bits."""
    if radius > 3:
        raise ValueError("the counters hold distances up to 3")
    planes = bit_planes(right)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    a, b = [], []
    step = max(1, (1 << 15) // planes.shape[1])
    for at in range(0, len(left), step):
        own = left[at : at + step]
        ones = np.zeros((len(own), planes.shape[1]), dtype=np.uint64)
        twos, over = ones.copy(), ones.copy()
        word = np.broadcast_to(np.arange(planes.shape[1]), ones.shape)
        query = np.broadcast_to(np.arange(len(own))[:, None], ones.shape)
        whole = True
        for i in range(64):
            flip = np.where((own >> np.uint64(i)) & np.uint64(1), full, np.uint64(0))
            differ = planes[i][None, :] ^ flip[:, None] if whole else planes[i][word] ^ flip[query]
            carry = ones & differ
            ones = ones ^ differ
            over = over | (twos & carry)
            twos = twos ^ carry
            if i % 8 == 7:  # leave the words in which all 64 exceed the radius
                beyond = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones if radius == 0 else np.uint64(0))
                live = beyond != full
                word, query, ones, twos, over = word[live], query[live], ones[live], twos[live], over[live]
                whole = False
                if not len(word):
                    break
        if len(word):
            within = ~(over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones if radius == 0 else np.uint64(0)))
            hit = np.unpackbits(within.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(hit)
            place = word[r] * 64 + c
            ok = place < len(right)
            a.append(at + query[r][ok])
            b.append(place[ok])
    if not a:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    return np.concatenate(a), np.concatenate(b)


def within(one: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """Of pairs of fingerprints, one of each array, whether they differ in at most `radius` bits: 64 pairs at a time, with as many carry-save counters as the radius needs."""
    planes = bit_planes(one ^ other)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    live = np.arange(planes.shape[1])
    counters = [np.zeros(len(live), dtype=np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(live), dtype=np.uint64)
    out = np.zeros(planes.shape[1], dtype=np.uint64)

    def beyond() -> np.ndarray:
        """The pairs whose count is over the radius: compared with it from the highest bit on."""
        greater, equal = over, ~over
        for i in reversed(range(len(counters))):
            if radius >> i & 1:
                equal = equal & counters[i]
            else:
                greater, equal = greater | (equal & counters[i]), equal & ~counters[i]
        return greater

    for i in range(64):
        carry = planes[i][live]
        for c in range(len(counters)):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        over = over | carry
        if i % 8 == 7:
            far = beyond()
            stay = far != full
            live, over, far = live[stay], over[stay], far[stay]
            counters = [c[stay] for c in counters]
            if not len(live):
                break
    if len(live):
        out[live] = ~beyond()
    return np.unpackbits(out.astype("<u8").view(np.uint8), bitorder="little")[: len(one)].astype(bool)


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For n nodes the least node that the pairs connect each with."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    return root


def _compare(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links (a, b) within the units named by the keys; part: 0 compares with 0 and 1, 1 only with 0 (null: all with all)."""

    def links(fps: np.ndarray, right: np.ndarray | None = None) -> pa.RecordBatch:
        both = fps if right is None else np.concatenate([fps, right])
        first = 0 if right is None else len(fps)
        root = forest(len(both), ((a, b + first) for a, b in [near(fps, both[first:], radius)]))
        out = np.flatnonzero(root != np.arange(len(both)))
        return pa.RecordBatch.from_arrays([pa.array(both[out].view(np.int64)), pa.array(both[root[out]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; whole units gather until a run is long enough."""
        held: list[np.ndarray] = []
        held_units: list[np.ndarray] = []
        for batch in batches:
            held.append(column(batch, "fp").to_numpy().view(np.uint64))
            held_units.append(column(batch, "unit").to_numpy())
            if sum(map(len, held)) < RUN:
                continue
            fps, units = np.concatenate(held), np.concatenate(held_units)
            cuts = np.concatenate([[0], np.flatnonzero(units[1:] != units[:-1]) + 1])
            done = 0
            for nxt in cuts[1:].tolist():
                if nxt - done >= RUN:
                    yield links(np.unique(fps[done:nxt]))
                    done = nxt
            held, held_units = [fps[done:]], [units[done:]]
        if held and (fps := np.unique(np.concatenate(held))).size:
            yield links(fps)

    sized = rows.select(F.xxhash64(*keys).alias("unit"), "fp")
    return sized.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def _part_pairs(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """The same for units over BUCKET, cut in parts by a hash of the fingerprint: each pair of parts is a unit of its own."""
    cut = rows.withColumn("of", F.ceil(F.col("n") / (BUCKET // 2)).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("of")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
    spread = cut.select("fp", *keys, "own", other.alias("other")).select("fp", *keys, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    return _compare(spread, [*keys, "p", "q"], radius)


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, a long) that connect exactly what `radius` or fewer differing bits connect."""
    block = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF)) for s in SHIFTS]
    if radius > 2:
        raise ValueError("two of four blocks agree only up to radius 2")
    tables = list(combinations(range(4), 2))
    keyed = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), (block[i] * 65536 + block[j]).alias("k")) for t, (i, j) in enumerate(tables)]))
    keyed = fps.select("fp", keyed.alias("x")).select("fp", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    large = written(sizes.where(F.col("n") > BUCKET), "large")
    if large.isEmpty():
        return _compare(keyed, ["t", "k"], radius)
    rest = keyed.join(large, ["t", "k"], "left_anti")
    # the 32 bits that aren't the key, in 3 parts of 11, 11 and 10 bits, one of which agrees
    others = [[x for x in range(4) if x not in pair] for pair in tables]
    low = F.element_at(F.array(*[block[o[0]] * 65536 + block[o[1]] for o in others]), F.col("t") + 1)
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.shiftright("low", b).bitwiseAND(F.lit(m)).alias("v")) for s, (b, m) in enumerate(((0, 2047), (11, 2047), (22, 1023)))]))
    again = keyed.join(large.select("t", "k"), ["t", "k"]).withColumn("low", low).select("fp", "t", "k", parts.alias("y")).select("fp", "t", "k", "y.s", "y.v")
    keys = ["t", "k", "s", "v"]
    larger = again.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > BUCKET)
    found = _compare(rest, ["t", "k"], radius).union(_compare(again.join(larger, keys, "left_anti"), keys, radius))
    return found.union(_part_pairs(again.join(larger, keys), keys, radius))


def near_duplicates(docs: DataFrame, size: int = 3, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fp, component_id): the smallest doc_id that links reach, for every row of documents."""
    own = written(fingerprints(docs, size, seed), "fps")
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    nodes = written(least, "nodes")
    groups = components(near_links(nodes.select("fp"), radius))
    linked = groups.join(nodes, groups["node"] == nodes["fp"])
    smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    ids = groups.join(smallest, "component").select(F.col("node").alias("fp"), "smallest")
    labels = written(nodes.join(ids, "fp", "left").select("fp", "rows", F.coalesce("smallest", "least").alias("component_id")), "labels")
    return join_facts(own, labels, ["fp"], "rows").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
