"""Best-fit packing of token sequences by hierarchical residual packing.

`token_pieces` cuts documents into pieces of at most `capacity` tokens; `pack` places items of any
kind in bins: items are dealt by a hash to partitions of about ITEMS, so that each has all sizes whatever the
order of the input; every partition best-fits its items in decreasing order; bins with at most `tolerance`
tokens free are final, and all others are items of the next round, dealt again to as many partitions as they need. The rounds end with one in
a single partition, or with one that merges less than one in LEAST of its items (sizes that don't fit together, in any number).
Only (item, size) rows move; token ids stay where they were written.

Nulls and edges: a null text is the empty text, which has one piece (the separator alone). Rows are
told apart by their place in the input, so repeated rows and null or repeated doc_ids are packed row by
row. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column, slices, text_or_empty, written
from factloom.llm.tokens import default_path, tokenizer_at

CAPACITY = 2048
SEPARATOR = 0
#: Items of a partition; a round that merges less than one in LEAST of its items is the last.
ITEMS, LEAST = 100_000, 50


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, ids: bool = False) -> DataFrame:
    """Rows (item_id, doc_id, piece, start, length, ids_crc32[, ids]): the pieces of each document's ids and the separator.

    ids: little-endian unsigned 32-bit token ids as binary.
    """
    path = tokenizer or default_path()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    fields = [("item_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if ids:
        fields.append(("ids", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_at(path)
        item = TaskContext.get().partitionId() << 40
        for batch in slices(batches, most=4 << 20):
            flat, counts = tok.encode_many(column(batch, "text"))
            ends = np.cumsum(counts + 1)
            stream = np.full(int(ends[-1]), separator, dtype="<u4")
            keep = np.ones(len(stream), dtype=bool)
            keep[ends - 1] = False
            stream[keep] = flat
            per_doc = -(-(counts + 1) // capacity)
            of = np.repeat(np.arange(len(counts)), per_doc)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            start = piece * capacity
            length = np.minimum(capacity, (counts + 1)[of] - start)
            at = (ends - counts - 1)[of] + start
            raw = memoryview(stream).cast("B")
            cuts = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
            cols = [item + np.arange(len(of)), column(batch, "doc_id").take(pa.array(of)), piece.astype(np.int32), start, length, [zlib.crc32(c) for c in cuts]]
            if ids:
                cols.append([bytes(c) for c in cuts])
            item += len(of)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

    ddl = "item_id long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return source.mapInArrow(run, ddl)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places items, in the order given, in the open bin with the least space that suffices, else in a new one: bins, offsets, fills.

    Open bins are stacked by free space; the bits of one integer tell which stacks hold a bin.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces, fills = 0, []
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for i, size in enumerate(sizes.tolist()):
        if above := open_spaces >> size:
            space = size + (above & -above).bit_length() - 1
            b = stacks[space].pop()
            if not stacks[space]:
                open_spaces &= ~(1 << space)
        else:
            b, space = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := space - size:
            stacks[left].append(b)
            open_spaces |= 1 << left
    return bins, offsets, np.array(fills, dtype=np.int64)


def _level(items: DataFrame, capacity: int, tolerance: int, level: int) -> DataFrame:
    """One round: rows (item_id, bin_id, place, fill, final). fill is null but in the first row of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(column(b, "item_id").to_numpy(zero_copy_only=False), column(b, "size").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if got:
            item, size = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((item, -size))
            bins, place, fills = best_fit(size[order], capacity)
            names = (level << 56) + (TaskContext.get().partitionId() << 32) + bins
            first = place == 0
            yield pa.RecordBatch.from_arrays([pa.array(item[order]), pa.array(names), pa.array(place), pa.array(fills[bins], mask=~first), pa.array((fills >= capacity - tolerance)[bins])], names=["item_id", "bin_id", "place", "fill", "final"])

    return items.select("item_id", F.col("size").cast("long").alias("size")).mapInArrow(run, "item_id long, bin_id long, place long, fill long, final boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, tolerance: int = 16, most: int | None = None) -> DataFrame:
    """Rows (item_id, sequence_id, offset) for rows (item_id, size), item_id unique and 0 < size <= capacity. most: items of a partition."""
    most = most or ITEMS
    levels, n = [], items.count()
    while True:
        parts = max(1, -(-n // most))
        dealt = items.repartition(parts, F.xxhash64("item_id", F.lit(len(levels)))) if parts > 1 else items.coalesce(1)
        done = written(_level(dealt, capacity, tolerance, len(levels)), f"pack{len(levels)}")
        levels.append(done)
        rest = done.where("fill is not null and not final").select(F.col("bin_id").alias("item_id"), F.col("fill").alias("size"))
        left, bins = rest.count(), done.where("fill is not null").count()
        if parts == 1 or not left or (n - bins) * LEAST < n:
            break
        items, n = rest, left
    above = None
    for done in reversed(levels):
        own = done.select("item_id", "bin_id", "place")
        if above is not None:
            up = above.select(F.col("item_id").alias("bin_id"), F.col("sequence_id").alias("up_id"), F.col("offset").alias("up_at"))
            own = own.join(up, "bin_id", "left").select("item_id", F.coalesce("up_id", "bin_id").alias("sequence_id"), (F.col("place") + F.coalesce("up_at", F.lit(0))).alias("offset"))
        else:
            own = own.select("item_id", F.col("bin_id").alias("sequence_id"), F.col("place").alias("offset"))
        above = own
    return above


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, tolerance: int = 16, ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of every document."""
    pieces = written(token_pieces(docs, tokenizer, capacity, separator, ids), "pieces")
    places = pack(pieces.select("item_id", F.col("length").alias("size")), capacity, tolerance)
    return pieces.join(places, "item_id").drop("item_id")
