"""Training-order materialisation of token ids in fixed-stride binary shards.

The ids of all documents, each followed by an end id, are cut in sequences of `length` ids (within an input partition; its last one is filled up
with the end id). Sequence i of n gets the global slot P(i): P is a keyed Feistel permutation of the least even number of bits that holds n,
walked along its cycle until the slot is below n. So a slot needs no sort and no table, any number of machines agree on it, and each key is another order.

Slot s is record s mod `per_shard` of shard s div `per_shard`. Each range of slots is one partition and writes one file, part-NNNNN with NNNNN the shard. A
record is `length` little-endian unsigned 16-bit (32-bit for larger vocabularies) ids and one line feed, so a reader at any slot seeks to record * stride and reads on.

Nulls and edges: a null or empty text is its end id alone. Null and repeated doc_ids are documents of their own. Other columns are ignored.
An empty table writes no records.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import SMALL_BUFFERS, column, scratch_path, slices, text_or_empty, written
from factloom.llm.tokens import default_path, tokenizer_at

LENGTH, PER_SHARD, END, KEY, ROUNDS = 2048, 2048, 49407, 20_240_229, 6
#: Bytes of text that a task encodes, and records that it hands on, at once.
SLICE, STEP = 4 << 20, 256


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(i: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """P(i) for places i below n: a permutation of 0 to n - 1."""
    half = max(1, -(-max(1, int(n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [int(_mix(np.array([key * 64 + r], dtype=np.uint64), 0x9E3779B97F4A7C15)[0]) for r in range(ROUNDS)]
    out = np.asarray(i).astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        out[walk] = (left << np.uint64(half)) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, packed: bool = False) -> DataFrame:
    """Rows (part, i, n_tokens, ids, doc_ids): sequence i of input partition `part`; ids holds all `length` ids (compressed if packed), n_tokens of them real."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_at(path)
        pack = zstandard.ZstdCompressor(level=3).compress if packed else bytes
        part, done = TaskContext.get().partitionId(), 0
        rest = np.zeros(0, dtype=tok.dtype)
        rows: list[int | None] = []  # the documents of the ids not yet cut
        ends = np.zeros(0, dtype=np.int64)  # where each of them ends

        def cut(flat: np.ndarray, real: int) -> pa.RecordBatch:
            nonlocal done
            n = len(flat) // length
            starts = np.arange(n) * length
            left = np.minimum(length, real - starts)
            first, last = np.searchsorted(ends, starts, side="right"), np.searchsorted(ends, starts + left - 1, side="right")
            raw = flat[: n * length].astype(f"<u{flat.dtype.itemsize}").tobytes()
            step = length * flat.dtype.itemsize
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(done + np.arange(n)), pa.array(left.astype(np.int32)), pa.array([pack(raw[step * k : step * (k + 1)]) for k in range(n)], pa.binary()), pa.array([rows[a : b + 1] for a, b in zip(first.tolist(), last.tolist())], pa.list_(pa.int64()))],
                names=["part", "i", "n_tokens", "ids", "doc_ids"],
            )
            done += n
            return out

        for batch in slices(batches, most=SLICE):
            flat, counts = tok.encode_many(column(batch, "text"))
            stops = np.cumsum(counts + 1)
            stream = np.full(int(stops[-1]), end, dtype=tok.dtype)
            keep = np.ones(len(stream), dtype=bool)
            keep[stops - 1] = False
            stream[keep] = flat
            rows += column(batch, "doc_id").to_pylist()
            ends = np.concatenate([ends, len(rest) + stops])
            stream = np.concatenate([rest, stream])
            whole = len(stream) // length * length
            for at in range(0, whole, STEP * length):
                some = min(whole - at, STEP * length)
                yield cut(stream[at : at + some], some)
                ends -= some
                over = int(np.searchsorted(ends, 0, side="right"))
                del rows[:over]
                ends = ends[over:]
            rest = stream[whole:]
            pa.default_memory_pool().release_unused()  # two workers share an executor's memory with the JVM
        if len(rest):
            yield cut(np.concatenate([rest, np.full(length - len(rest), end, dtype=tok.dtype)]), len(rest))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "part int, i long, n_tokens int, ids binary, doc_ids array<long>")


def _slotted(rows: DataFrame, starts: dict[int, int], n: int, key: int, ids: bool) -> DataFrame:
    """Rows (slot, n_tokens, doc_ids), or (slot, ids)."""
    sent = rows.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.array([sent.value[p] for p in column(batch, "part").to_pylist()], dtype=np.int64)
            slot = pa.array(permute(first + column(batch, "i").to_numpy(), n, key))
            if ids:
                yield pa.RecordBatch.from_arrays([slot, column(batch, "ids")], names=["slot", "ids"])
            else:
                yield pa.RecordBatch.from_arrays([slot, column(batch, "n_tokens"), column(batch, "doc_ids")], names=["slot", "n_tokens", "doc_ids"])

    if ids:
        return rows.select("part", "i", "ids").mapInArrow(run, "slot long, ids binary")
    return rows.select("part", "i", "n_tokens", "doc_ids").mapInArrow(run, "slot long, n_tokens int, doc_ids array<long>")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield pa.RecordBatch.from_arrays([pa.array([unpack(x.as_buffer()) for x in column(batch.slice(at, STEP), "ids")], pa.binary())], names=["value"])


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, end: int = END, key: int = KEY) -> DataFrame:
    """Writes path/records/part-NNNNN and path/manifest, and gives rows (slot, shard, record, n_tokens, doc_ids)."""
    spark = docs.sparkSession
    made = written(sequences(docs, tokenizer, length, end, packed=True), "sequences", SMALL_BUFFERS)
    counts = made.groupBy("part").agg(F.count("*").alias("n")).collect()  # a row for each input partition
    starts, n = {}, 0
    for r in sorted(counts):
        starts[r.part] = n
        n += r.n
    shards = -(-n // per_shard)
    width = np.dtype(tokenizer_at(tokenizer or default_path()).dtype).itemsize
    manifest = {"n": n, "length": length, "per_shard": per_shard, "shards": shards, "width": width, "stride": length * width + 1, "end": end, "key": key}
    if n:
        slots = _slotted(made, starts, n, key, True).withColumn("shard", (F.col("slot") / per_shard).cast("int"))
        ordered = slots.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot").select("ids")
        ordered.mapInArrow(_unpacked, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/records")
    spark.range(1).select(F.lit(json.dumps(manifest)).alias("value")).coalesce(1).write.text(f"{path}/manifest")
    index = _slotted(made, starts, n, key, False) if n else made.select(F.lit(0).cast("long").alias("slot"), "n_tokens", "doc_ids")
    return index.select("slot", F.floor(F.col("slot") / per_shard).alias("shard"), (F.col("slot") % per_shard).alias("record"), "n_tokens", "doc_ids")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first().value)


def read_records(spark: SparkSession, path: str, crc: bool = False) -> DataFrame:
    """Rows (slot, ids): every record of the shards, ids as binary; or (slot, ids_crc32), so that no second Python worker has to be fed."""
    m = read_manifest(spark, path)
    kind = "slot long, ids_crc32 long" if crc else "slot long, ids binary"
    if not m["n"]:
        return spark.createDataFrame([], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(column(batch, "shard").to_pylist(), column(batch, "content")):
                raw = memoryview(content.as_buffer())
                if len(raw) % m["stride"] or any(raw[k - 1] != 10 for k in range(m["stride"], len(raw) + 1, m["stride"])):
                    raise ValueError(f"shard {shard} isn't whole records")
                n = len(raw) // m["stride"]
                for at in range(0, n, STEP):
                    part = range(at, min(n, at + STEP))
                    records = [raw[k * m["stride"] : (k + 1) * m["stride"] - 1] for k in part]
                    out = pa.array(map(zlib.crc32, records), pa.int64()) if crc else pa.array(map(bytes, records), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(shard * m["per_shard"] + np.array(part)), out], names=["slot", "ids_crc32" if crc else "ids"])

    files = spark.read.format("binaryFile").load(f"{path}/records")
    return files.where("length > 0").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), "content").mapInArrow(run, kind)


def read_from(folder: str, slot: int, filesystem=None) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in order, one seek and then sequential reads. folder, filesystem: as for pyarrow."""
    from pyarrow import fs

    filesystem = filesystem or fs.LocalFileSystem()
    named = {p.base_name: p.path for p in filesystem.get_file_info(fs.FileSelector(f"{folder}/records"))}
    parts = {int(k[5:10]): p for k, p in named.items() if k.startswith("part-")}
    meta = next(p.path for p in filesystem.get_file_info(fs.FileSelector(f"{folder}/manifest")) if p.base_name.startswith("part-"))
    m = json.loads(filesystem.open_input_stream(meta).read())
    for shard in range(slot // m["per_shard"], m["shards"]):
        with filesystem.open_input_file(parts[shard]) as f:
            f.seek(max(0, slot - shard * m["per_shard"]) * m["stride"])
            while record := f.read(m["stride"]):
                yield np.frombuffer(record[:-1], dtype=f"<u{m['width']}")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the shards, and gives (slot, shard, record, n_tokens, doc_ids, ids_crc32), the CRC-32 worked out from the files as written."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    return write_shards(docs, path).join(read_records(spark, path, crc=True), "slot")
