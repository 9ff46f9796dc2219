"""Exact substring removal with suffix arrays, over all documents at once.

Two documents that share LENGTH bytes share the anchor of them: the least hash of GRAM consecutive bytes in these LENGTH. So it suffices to compare runs
of neighbouring strings of LENGTH bytes with one anchor:

1. The documents are written once, bucketed by group (GROUP_BYTES of text), so that later steps read them group by group without a shuffle.
2. Each group sends its distinct anchors (32 bits each, packed by hash bucket); buckets answer which several documents have.
3. Each group sends the distinct texts of the runs under these, with the least and greatest id that has each, compressed by bucket of the anchor. Under an anchor that
   over SPLIT groups have, each string of LENGTH bytes goes alone, to the bucket of its own hash, so the many texts around a very common anchor spread over all tasks.
4. In each bucket suffix arrays (two-stage sorting) of whole anchors' texts and adjacent common prefixes of at least LENGTH give, for each place in a text, the
   least document that has the same LENGTH bytes.
5. The answers go back in the order of the texts sent; each group finds its runs again and removes the bytes they cover.

All removals are decided by suffix arrays, those of whole copies too. Nothing but these packed rows moves; texts of documents stay in their groups.

Nulls and edges: a null text is empty. A null doc_id is no smaller than any and none is smaller than it: such rows are kept whole. Rows that
repeat a doc_id don't count against each other. Texts of any length are compared whole. Each row gives one row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import grouped_documents, written
from factloom.llm.suffix_array import repeated

LENGTH, GRAM = 50, 16
#: Strings of one run; bytes of texts in one suffix array; groups that may have an anchor before its strings go alone.
RUN, ARRAY_BYTES, SPLIT = 64, 1 << 20, 4096
#: Text that one bucket of anchors stands for.
BUCKET_BYTES = 8 << 20

BASE = 0x9E3779B97F4A7C15


def gram_hashes(text: np.ndarray, n: int = GRAM) -> np.ndarray:
    """The hash of each run of n bytes, by doubling."""
    mask = (1 << 64) - 1
    cur, size, acc, have = text.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if n & size:
            if acc is None:
                acc = cur
            else:
                m = len(text) - have - size + 1
                acc = acc[:m] * np.uint64(pow(BASE, size, mask + 1)) + cur[have : have + m]
            have += size
        if size * 2 > n:
            break
        cur = cur[:-size] * np.uint64(pow(BASE, size, mask + 1)) + cur[size:]
        size *= 2
    acc = acc ^ (acc >> np.uint64(29))
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    return (acc ^ (acc >> np.uint64(32))) | np.uint64(1)


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _slabs(docs: pa.Table, rows: np.ndarray, most: int = 2 << 20) -> Iterator[np.ndarray]:
    """Runs of rows with about `most` bytes of text."""
    lens = np.array([len(x.as_py()) for x in docs.column("text").take(pa.array(rows))], dtype=np.int64) if len(rows) else rows
    start, size = 0, 0
    for i, n in enumerate(lens.tolist()):
        if size and size + n > most:
            yield rows[start:i]
            start, size = i, 0
        size += n
    if start < len(rows):
        yield rows[start:]


def runs_of(text: np.ndarray, doc: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of `length` bytes inside one document that have the same anchor: place of the first, number, anchor."""
    if len(text) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    least = _sliding(gram_hashes(text, gram), length - gram + 1, np.minimum)
    least[doc[: len(least)] != doc[length - 1 : length - 1 + len(least)]] = 0
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(np.concatenate([start, [len(least)]]))
    start, n = start[least[start] != 0], n[least[start] != 0]
    if len(n) and n.max() > RUN:  # a text that repeats itself
        parts = -(-n // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, n = np.repeat(start, parts) + nth * RUN, np.minimum(RUN, np.repeat(n, parts) - nth * RUN)
    return start, n, least[start]


def _packed(x: np.ndarray | bytes) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else x.tobytes(), 1)


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


class _Group(NamedTuple):
    """The runs of a group: slab, row, place in the row's text, number of strings and anchor of each; slabs as bytes with the place where each row begins."""

    slabs: list[bytes]
    slab: np.ndarray
    row: np.ndarray
    at: np.ndarray
    begin: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    ids: np.ndarray


def _group(docs: pa.Table, length: int) -> _Group:
    ids = docs.column("doc_id").to_pylist()
    rows = np.array([i for i, d in enumerate(ids) if d is not None], dtype=np.int64)
    slabs, columns = [], {c: [np.zeros(0, dtype=np.int64)] for c in ("slab", "row", "at", "begin", "n")}
    anchors = [np.zeros(0, dtype=np.uint64)]
    for slab in _slabs(docs, rows):
        texts = docs.column("text").take(pa.array(slab)).to_pylist()
        lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begin = np.cumsum(lens) - lens
        raw = b"".join(texts)
        doc = np.repeat(np.arange(len(slab)), lens)
        start, n, anchor = runs_of(np.frombuffer(raw, dtype=np.uint8), doc, length)
        own = doc[start]
        for c, x in (("slab", np.full(len(start), len(slabs))), ("row", slab[own]), ("at", start - begin[own]), ("begin", begin[own]), ("n", n)):
            columns[c].append(x)
        anchors.append(anchor)
        slabs.append(raw)
    found = {c: np.concatenate(x) for c, x in columns.items()}
    return _Group(slabs, **found, anchor=np.concatenate(anchors), ids=np.array([-1 if d is None else d for d in ids], dtype=np.int64))


def _cuts(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Where each value begins and ends."""
    if not len(sorted_values):
        return []
    edges = np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]]).tolist()
    return list(zip(edges, edges[1:]))


def _distinct(group: _Group, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct anchors, the bucket of each, their order by bucket, and of each run which it has."""
    anchors, which = np.unique(group.anchor, return_inverse=True)
    bucket = ((anchors >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)  # anchors are odd
    return anchors, bucket, np.argsort(bucket, kind="stable"), which


def _send_anchors(docs: pa.Table, length: int, buckets: int) -> pa.Table:
    """Rows (bucket, g, anchors, several): the high halves of the group's anchors, and whether several ids of the group have each."""
    group = _group(docs, length)
    anchors, bucket, order, which = _distinct(group, buckets)
    ids = group.ids[group.row]
    low, high = np.full(len(anchors), np.iinfo(np.int64).max), np.full(len(anchors), np.iinfo(np.int64).min)
    np.minimum.at(low, which, ids)
    np.maximum.at(high, which, ids)
    several, halves = (low < high)[order], (anchors >> np.uint64(32)).astype("<u4")[order]
    parts = _cuts(bucket[order])
    g = docs.column("g")[0].as_py() if docs.num_rows else None
    return pa.table({"bucket": pa.array([int(bucket[order[a]]) for a, _ in parts], pa.int64()), "g": pa.array([g] * len(parts), pa.int64()), "anchors": pa.array([halves[a:b].tobytes() for a, b in parts], pa.binary()), "several": pa.array([_packed(np.packbits(several[a:b])) for a, b in parts], pa.binary())})


def _answer_anchors(sent: pa.Table, split: int) -> pa.Table:
    """Rows (g, bucket, status): for each anchor of a group in the order sent 0 (one document has it), 1 (several have) or 2 (over `split` groups have)."""
    halves = [np.frombuffer(x, "<u4") for x in sent.column("anchors").to_pylist()]
    several = [np.unpackbits(_unpacked(x, "u1"), count=len(h)) for x, h in zip(sent.column("several").to_pylist(), halves)]
    values, which, n = np.unique(np.concatenate(halves), return_inverse=True, return_counts=True)
    hot = n > 1
    hot[which[np.concatenate(several) > 0]] = True
    status = (hot.astype(np.uint8) + (hot & (n > split)))[which]
    ends = np.cumsum([0, *map(len, halves)]).tolist()
    return pa.table({"g": sent.column("g"), "bucket": sent.column("bucket"), "status": pa.array([_packed(status[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())})


def _texts(docs: pa.Table, side: pa.Table, length: int, buckets: int) -> tuple[_Group, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct texts to compare by bucket and key, with both, and the text, row and place of each occurrence."""
    group = _group(docs, length)
    anchors, bucket, order, which = _distinct(group, buckets)
    status = np.zeros(len(anchors), dtype=np.uint8)
    answers = {b: x for b, x in zip(side.column("bucket").to_pylist(), side.column("status").to_pylist()) if x is not None}
    for a, b in _cuts(bucket[order]):
        status[order[a:b]] = _unpacked(answers[int(bucket[order[a]])], "u1")
    index: dict[bytes, int] = {}
    of, rows, places, hashes = ([np.zeros(0, dtype=np.int64)] for _ in range(4))
    kind, from_slab = status[which], group.begin + group.at
    for k, raw in enumerate(group.slabs):
        own = np.flatnonzero((group.slab == k) & (kind == 1))
        ends = (from_slab[own] + group.n[own] + length - 1).tolist()
        of.append(np.array([index.setdefault(raw[a:b], len(index)) for a, b in zip(from_slab[own].tolist(), ends)], dtype=np.int64))
        hashes.append(group.anchor[own].view(np.int64))
        own_rows, own_places = [group.row[own]], [group.at[own]]
        alone = np.flatnonzero((group.slab == k) & (kind == 2))
        if len(alone):
            n = group.n[alone]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            strings = [raw[a : a + length] for a in (np.repeat(from_slab[alone], n) + nth).tolist()]
            of.append(np.array([index.setdefault(t, len(index)) for t in strings], dtype=np.int64))
            hashes.append(np.array(list(map(xxhash.xxh64_intdigest, strings)), dtype=np.uint64).view(np.int64))
            own_rows.append(np.repeat(group.row[alone], n))
            own_places.append(np.repeat(group.at[alone], n) + nth)
        rows += own_rows
        places += own_places
    of = np.concatenate(of)
    found = np.zeros(len(index), dtype=np.uint64)
    found[of] = np.concatenate(hashes).view(np.uint64)
    bucket, key = ((found >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64), (found >> np.uint64(32)).astype("<u4")
    order = np.lexsort((key, bucket))
    texts = list(index)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return group, [texts[i] for i in order.tolist()], bucket[order], key[order], place[of], np.concatenate(rows), np.concatenate(places)


TEXTS = "bucket long, g long, keys binary, lens binary, texts binary, low binary, more binary"


def _send_texts(docs: pa.Table, side: pa.Table, length: int, buckets: int) -> pa.Table:
    """Rows TEXTS: the distinct texts of the group by bucket, sorted by key, the least id of each and the greatest less that."""
    group, texts, bucket, key, of, rows, _ = _texts(docs, side, length, buckets)
    ids = group.ids[rows]
    low, high = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), np.iinfo(np.int64).min)
    np.minimum.at(low, of, ids)
    np.maximum.at(high, of, ids)
    parts = _cuts(bucket)
    g = docs.column("g")[0].as_py() if docs.num_rows else None
    lens = np.fromiter(map(len, texts), dtype="<u2", count=len(texts))
    packed = {n: pa.array([_packed(x[a:b]) for a, b in parts], pa.binary()) for n, x in (("keys", key), ("lens", lens), ("low", low), ("more", (high - low).astype("<u8")))}
    whole = pa.array([_packed(b"".join(texts[a:b])) for a, b in parts], pa.binary())
    return pa.table({"bucket": pa.array([int(bucket[a]) for a, _ in parts], pa.int64()), "g": pa.array([g] * len(parts), pa.int64()), "keys": packed["keys"], "lens": packed["lens"], "texts": whole, "low": packed["low"], "more": packed["more"]})


def _ranges(which: np.ndarray, offset: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to, least): runs of offsets of a string with the same least id, sorted."""
    order = np.lexsort((offset, which))
    which, offset, least = which[order], offset[order], least[order]
    if not len(which):
        return which, offset, offset, least
    a = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1) | (least[1:] != least[:-1])]))
    b = np.concatenate([a[1:], [len(which)]]) - 1
    return which[a], offset[a], offset[b], least[a]


RANGES = "g long, bucket long, counts binary, `from` binary, `to` binary, least binary"


def _answer_texts(sent: pa.Table, length: int) -> pa.Table:
    """Rows RANGES: for each text in the order sent the number of its ranges of offsets, and these with their least id."""
    index: dict[bytes, int] = {}
    own, keys, lows, mores = [], [], [], []
    for raw, lens, key, low, more in zip(*(sent.column(c).to_pylist() for c in ("texts", "lens", "keys", "low", "more"))):
        whole, ends = zstandard.decompress(raw), np.cumsum(_unpacked(lens, "<u2"), dtype=np.int64).tolist()
        own.append(np.array([index.setdefault(whole[a:b], len(index)) for a, b in zip([0, *ends], ends)], dtype=np.int64))
        keys.append(_unpacked(key, "<u4"))
        lows.append(_unpacked(low, "<i8"))
        mores.append(_unpacked(more, "<u8"))
    every = np.concatenate(own)
    low, high = np.full(len(index), np.iinfo(np.int64).max), np.full(len(index), np.iinfo(np.int64).min)
    np.minimum.at(low, every, np.concatenate(lows))
    np.maximum.at(high, every, np.concatenate(lows) + np.concatenate(mores).astype(np.int64))
    key = np.zeros(len(index), dtype=np.int64)
    key[every] = np.concatenate(keys)
    texts = list(index)
    order = np.argsort(key, kind="stable")
    size = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))[order])
    ends = [b for _, b in _cuts(key[order])]  # whole anchors only
    found, start = [], 0
    for a, b in zip(ends, [*ends[1:], None]):
        if b is None or size[b - 1] - (size[start - 1] if start else 0) > ARRAY_BYTES:
            part = order[start:a]
            which, offset, least, _ = repeated([texts[i] for i in part.tolist()], low[part], high[part], length)
            found.append((part[which], offset, least))
            start = a
    of, first, last, least = _ranges(*(np.concatenate(x) for x in zip(*found)))
    counts = np.bincount(of, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    out: dict[str, list] = {"counts": [], "from": [], "to": [], "least": []}
    for x in own:
        n = counts[x]
        at = np.repeat(begin[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for c, values in (("counts", n.astype("<u2")), ("from", first[at].astype("<u2")), ("to", last[at].astype("<u2")), ("least", least[at].astype("<i8"))):
            out[c].append(_packed(values))
    return pa.table({"g": sent.column("g"), "bucket": sent.column("bucket"), **{c: pa.array(x, pa.binary()) for c, x in out.items()}})


def _removed(docs: pa.Table, side: pa.Table, length: int, buckets: int, keep: bool) -> pa.Table:
    """Rows (doc_id, n_bytes, spans, kept or its SHA-256): what stays of each document."""
    group, texts, bucket, _, of, rows, places = _texts(docs, side, length, buckets)
    answers = {b: x for b, *x in zip(*(side.column(c).to_pylist() for c in ("bucket", "counts", "from", "to", "least"))) if x[0] is not None}
    parts = [[_unpacked(x, k).astype(np.int64) for x, k in zip(answers[int(bucket[a])], ("<u2", "<u2", "<u2", "<i8"))] for a, _ in _cuts(bucket)]
    counts, first, last, least = (np.concatenate([p[i] for p in parts] or [np.zeros(0, dtype=np.int64)]) for i in range(4))
    begin = np.cumsum(counts) - counts
    n = counts[of]
    at = np.repeat(begin[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    row, place = np.repeat(rows, n), np.repeat(places, n)
    goes = least[at] < group.ids[row]
    row, start, end = row[goes], (place + first[at])[goes], (place + last[at])[goes] + length
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    spans: dict[int, list[dict]] = {}
    for a, b in _cuts(row):
        reach = np.maximum.accumulate(end[a:b])
        new = np.flatnonzero(np.concatenate([[True], start[a + 1 : b] > reach[:-1]]))
        spans[int(row[a])] = [{"from": f, "to": t} for f, t in zip(start[a:b][new].tolist(), reach[np.concatenate([new[1:], [b - a]]) - 1].tolist())]
    sizes, removed, kept = [], [], []
    for i, text in enumerate(docs.column("text")):
        raw, own = text.as_py(), spans.get(i, [])
        ends = [0, *(x for r in own for x in (r["from"], r["to"])), len(raw)]
        rest = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
        sizes.append(len(raw))
        removed.append(own)
        kept.append(rest if keep else hashlib.sha256(rest).hexdigest())
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(removed, kind), "kept": pa.array(kept, pa.binary() if keep else pa.string())})


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: bool = True) -> DataFrame:
    """Rows (doc_id, n_bytes, spans, kept): removed runs of bytes (from, to), and the rest as binary (its SHA-256 in hex if not keep)."""
    if not 2 * GRAM <= length < (1 << 16) - RUN:
        raise ValueError(f"length is from {2 * GRAM} to {(1 << 16) - RUN - 1}")
    docs = grouped_documents(docs, "suffix")
    buckets = max(16, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET_BYTES))
    split = SPLIT

    def with_docs(side: DataFrame, f, schema: str) -> DataFrame:
        return docs.groupBy("g").cogroup(side.groupBy("g")).applyInArrow(f, schema)

    sent = docs.groupBy("g").applyInArrow(lambda d: _send_anchors(d, length, buckets), "bucket long, g long, anchors binary, several binary")
    status = written(sent.groupBy("bucket").applyInArrow(lambda s: _answer_anchors(s, split), "g long, bucket long, status binary"), "status")
    texts = with_docs(status, lambda d, s: _send_texts(d, s, length, buckets), TEXTS)
    ranges = written(texts.groupBy("bucket").applyInArrow(lambda s: _answer_texts(s, length), RANGES), "ranges")
    none = [F.lit(None).cast("binary").alias(c) for c in ("counts", "from", "to", "least")]
    side = status.select("g", "bucket", "status", *none).union(ranges.select("g", "bucket", F.lit(None).cast("binary"), "counts", "from", "to", "least"))
    return with_docs(side, lambda d, s: _removed(d, s, length, buckets, keep), f"doc_id long, n_bytes long, spans array<struct<from: long, to: long>>, kept {'binary' if keep else 'string'}")


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, doc_id, p, substring(h, 2 * p + 1, 100) AS s FROM d, unnest(range(0, n - 49)) AS u(p) WHERE n >= 50),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
f AS (SELECT rid, p FROM w JOIN m USING (s) WHERE least < doc_id),
g AS (SELECT rid, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY p) AS k FROM (SELECT *, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM f)),
r AS (SELECT rid, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY rid, k),
c AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS done FROM r),
t AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substring(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS head, max(b) AS last FROM c JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""
