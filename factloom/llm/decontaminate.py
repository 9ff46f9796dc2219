"""Benchmark decontamination by winnowing.

Words: after lower-casing A-Z, the runs of digits, a-z and characters beyond ASCII. Of each text the hashes of K
consecutive words are winnowed: in every W consecutive hashes the least is kept, the leftmost on a tie. Two texts
that share WINDOW = K + W - 1 consecutive words share the kept hash of that span, so a join on kept hashes misses
no such span. Every hit is extended word by word in both directions; spans of WINDOW words or more count. Items
with fewer words count where they occur whole; they are found by the hash of all their words.

A benchmark of at most `broadcast_bytes` of text (checked) is indexed once and sent to all tasks, which then need no
shuffle. A larger one takes `by_join`: kept hashes of both sides are joined and only the pairs found are compared.

Nulls and edges: a null text has no words; a null benchmark text or item_id is no item; item rows with the
same item_id count as one item. Texts of any length are compared whole; equal least hashes in a window keep the leftmost. Each document row gives one row, repeated ids too. An empty
benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column, slices, text_or_empty, written

K, W = 5, 6
WINDOW = K + W - 1
BROADCAST_BYTES = 32 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)

_word = [c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)]
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else _word[c] for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        out = out * STEP + hashes[j : j + size]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def winnow(grams: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The places of the leftmost least hash of W, for the windows that begin at the places given; each place once."""
    if not len(windows):
        return windows
    least, at = grams[windows], windows.copy()
    for j in range(1, W):
        other = grams[windows + j]
        less = other < least
        least = np.where(less, other, least)
        at[less] = windows[less] + j
    return np.unique(at)


class Index:
    """The winnowed benchmark: items as (id, text) with text as UTF-8 bytes."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.vocab: dict[bytes, int] = {}
        self.names, self.items = [], []
        for name, text in items:
            if words := words_of(text):
                self.names.append(name)
                self.items.append([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words])
        self.hashes = np.array([0, *map(word_hash, self.vocab)], dtype=np.uint64)
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for i, ids in enumerate(self.items):
            if len(ids) < WINDOW:
                self.short.setdefault(len(ids), {}).setdefault(tuple(ids), []).append(i)
                continue
            grams = gram_hashes(self.hashes[ids], K)
            at = winnow(grams, np.arange(len(ids) - WINDOW + 1))
            for p, g in zip(at.tolist(), grams[at].tolist()):
                self.places.setdefault(g, []).append((i, p))
        self.kept = np.array(sorted(self.places), dtype=np.uint64)
        self.short_kept = {n: np.unique(gram_hashes(self.hashes[[w for ids in some for w in ids]], n)[::n]) for n, some in self.short.items()}

    def match(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: the number of its words, the spans of hit words (from, to), the items found, sorted."""
        get, parts, counts = self.vocab.get, [], []
        gap = np.zeros(1, dtype=np.int32)
        for text in texts:
            words = words_of(text)
            parts += [np.fromiter(map(get, words, repeat(0)), dtype=np.int32, count=len(words)), gap]
            counts.append(len(words))
        ids = np.concatenate(parts) if parts else gap[:0]
        begins = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64) + 1)])
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        spans: list[tuple[int, int, int]] = []  # from, to, item

        def whole(n: int) -> np.ndarray:
            return np.flatnonzero(known[n:] - known[:-n] == n) if len(known) > n else np.zeros(0, dtype=np.int64)

        hashes = self.hashes[ids]
        if len(self.kept) and len(windows := whole(WINDOW)):
            grams = gram_hashes(hashes, K)
            at = winnow(grams, windows)
            at = at[np.isin(grams[at], self.kept)]
            until: dict[tuple[int, int], int] = {}  # on each item and diagonal, where the last span ends
            for p, g in zip(at.tolist(), grams[at].tolist()):
                for item, q in self.places[g]:
                    if until.get((item, p - q), -1) > p:
                        continue
                    own = self.items[item]
                    a, b, x, y = p, p, q, q
                    while x and own[x - 1] == ids[a - 1] and a:
                        a, x = a - 1, x - 1
                    while y < len(own) and b < len(ids) and own[y] == ids[b]:
                        b, y = b + 1, y + 1
                    until[item, p - q] = b
                    if b - a >= WINDOW:
                        spans.append((a, b, item))
        for n, some in self.short.items():
            if len(windows := whole(n)):
                grams = gram_hashes(hashes, n)
                for p in windows[np.isin(grams[windows], self.short_kept[n])].tolist():
                    spans += [(p, p + n, item) for item in some.get(tuple(ids[p : p + n].tolist()), ())]
        out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(n, [], []) for n in counts]
        found: dict[int, set[str]] = {}
        for a, b, item in sorted(spans):
            k = int(np.searchsorted(begins, a, side="right")) - 1
            a, b, hits = a - int(begins[k]), b - int(begins[k]), out[k][1]
            if hits and a <= hits[-1][1]:
                hits[-1] = (hits[-1][0], max(b, hits[-1][1]))
            else:
                hits.append((a, b))
            found.setdefault(k, set()).add(self.names[item])
        for k, names in found.items():
            out[k][2].extend(sorted(names))
        return out


SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
RESULT = "doc_id long, n_words long, hits array<struct<from: long, to: long>>, item_ids array<string>"


def _bytes(col: pa.Array) -> list[bytes]:
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")


def by_broadcast(docs: DataFrame, items: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in items.collect()])
    kept: dict[str, Index] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if "index" not in kept:
                kept["index"] = Index(sent.value)
            got = kept["index"].match(_bytes(column(batch, "text")))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([n for n, _, _ in got], pa.int64()), pa.array([[{"from": a, "to": b} for a, b in h] for _, h, _ in got], SPANS), pa.array([i for _, _, i in got], pa.list_(pa.string()))],
                names=["doc_id", "n_words", "hits", "item_ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, RESULT)


def _kept_hashes(rows: DataFrame, key: str, short: list[int]) -> DataFrame:
    """Rows (key, hash, n): the winnowed hashes of each text (n = 0) and the hashes of each run of n words, for the n in `short`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for name, text in zip(column(batch, key).to_pylist(), _bytes(column(batch, "text"))):
                hashes = np.fromiter(map(word_hash, words_of(text)), dtype=np.uint64)
                grams = gram_hashes(hashes, K)
                found = [(0, np.unique(grams[winnow(grams, np.arange(max(0, len(hashes) - WINDOW + 1)))]))]
                found += [(n, np.unique(gram_hashes(hashes, n))) for n in short if len(hashes) == n or key == "row"]
                for n, h in found:
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), column(batch, key).type), pa.array(h.view(np.int64)), pa.array([n] * len(h), pa.int32())], names=[key, "hash", "n"])

    kind = "long" if key == "row" else "string"
    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, hash long, n int")


def _short_lengths(items: DataFrame) -> list[int]:
    """The numbers of words, under WINDOW, that items have: at most WINDOW - 1 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([min(WINDOW, len(words_of(t))) for t in _bytes(column(batch, "text"))], pa.int32())], names=["n"])

    return sorted(r.n for r in items.select("text").mapInArrow(run, "n int").where(F.col("n").between(1, WINDOW - 1)).distinct().collect())


def by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The way for a benchmark too large to send to every task: a document's text meets the items that share a kept hash with it, and is compared with them at once."""
    docs = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), "docs")
    short = _short_lengths(items)
    pairs = _kept_hashes(docs, "row", short).join(_kept_hashes(items, "item_id", short), ["hash", "n"]).select("row", "item_id").distinct()
    asked = pairs.join(items, "item_id").groupBy("row").agg(F.collect_list(F.struct("item_id", F.encode("text", "UTF-8").alias("item"))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row, text, own in zip(column(batch, "row").to_pylist(), _bytes(column(batch, "text")), column(batch, "items").to_pylist()):
                _, hits, names = Index([(x["item_id"], x["item"]) for x in own]).match([text])[0]
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([[{"from": a, "to": b} for a, b in hits]], SPANS), pa.array([names], pa.list_(pa.string()))], names=["row", "hits", "item_ids"])

    found = docs.select("row", "text").join(asked, "row").mapInArrow(run, RESULT.replace("doc_id long, n_words long", "row long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = pa.array([len(words_of(t)) for t in _bytes(column(batch, "text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "doc_id"), n], names=["row", "doc_id", "n_words"])

    counts = docs.mapInArrow(count, "row long, doc_id long, n_words long")
    none = F.expr("cast(array() as array<string>)")
    return counts.join(found, "row", "left").select("doc_id", "n_words", F.coalesce("hits", F.expr("cast(array() as array<struct<from: long, to: long>>)")).alias("hits"), F.coalesce("item_ids", none).alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, hits, item_ids): merged spans of hit words (from, to; words count from 0) and the items found, sorted."""
    items = _items(benchmark)
    size = items.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    return by_broadcast(docs, items) if size <= broadcast_bytes else by_join(docs, items)


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, letters),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, letters WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS gram FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS gram FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(p)),
hit AS (SELECT rid, p, dw.n, item FROM dw JOIN iw ON dw.gram = iw.gram AND dw.n = iw.n),
words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT rid, p, n FROM hit), unnest(range(p, p + n)) AS u(q) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
