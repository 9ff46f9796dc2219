"""Cross-entropy difference (target against background) by bigram models over one vocabulary.

Words: lower-cased A-Z; runs of digits, a-z and characters beyond ASCII. Both models count words and pairs of words, with a mark before the first and
after the last word of each document: the background over all documents, the target over those of quality 1. They share the vocabulary (all V words seen) and the smoothing:
P(w) = (c(w) + ALPHA) / (N + ALPHA V), P(w | v) = (c(v w) + MU P(w)) / (c(v) + MU). A document's score is its loss per token under the
target model less that under the background model; the lower, the nearer to the target.

Counts are exact and cover everything; nothing is cut to a size. Documents are written once in groups of a few MB. Each group sends the grams it has
with its own counts, packed by hash bucket; buckets add up and answer each group with the counts of its own grams only. So a task holds a group or a
bucket, never the model, and what moves grows with the input. Grams are told apart by 48 bits of a hash within a bucket.

Nulls and edges: a null or empty text is the two marks alone. Null labels and ids are no target; an id labelled twice is a target if any label says so.
Rows that repeat a doc_id count each. Without targets the target model is uniform. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import grouped_documents, written
from factloom.llm.decontaminate import words_of

ALPHA, MU = 0.1, 5.0
#: Text that one bucket stands for.
BUCKET_BYTES = 8 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)
BEGIN, END = np.uint64(1), np.uint64(2)
GRAMS = "bucket long, g long, grams binary, every binary, target binary"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word) | 4
        return out


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def token_hashes(text: bytes) -> np.ndarray:
    """BEGIN, the words, END."""
    words = words_of(text)
    out = np.empty(len(words) + 2, dtype=np.uint64)
    out[0], out[-1] = BEGIN, END
    out[1:-1] = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    return out


def _grams(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and of each pair of neighbours."""
    return _mixed(tokens * STEP), _mixed(_mixed(tokens[:-1] * STEP) * np.uint64(3) + tokens[1:])


def _texts(docs: pa.Table) -> list[bytes]:
    return docs.column("text").to_pylist()


def _keys(grams: np.ndarray, pairs: bool, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (those of pairs come after those of words) and 48 bits of the rest."""
    return (grams % np.uint64(buckets)).astype(np.int64) + buckets * pairs, grams >> np.uint64(16)


def _pack48(x: np.ndarray) -> bytes:
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype("<u2").tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | (np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype("<u4" if x.size == 0 or x.max() < 1 << 32 else "<u8").view(np.uint8).reshape(x.size, -1).T.tobytes(), 1) if x.size else b""


def _unpack(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.int64)
    plain = zstandard.decompress(raw)
    width = len(plain) // n
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def _send(docs: pa.Table, targets: pa.Table, buckets: int) -> pa.Table:
    """The group's distinct grams by bucket, sorted, with their counts in all documents and in target documents."""
    chosen = set(targets.column("uid").to_pylist())
    kinds: tuple[list, list] = ([], [])
    flags: tuple[list, list] = ([], [])
    for uid, text in zip(docs.column("uid").to_pylist(), _texts(docs)):
        for kind, x in enumerate(_grams(token_hashes(text))):
            kinds[kind].append(x)
            flags[kind].append(np.full(len(x), uid in chosen))
    out: dict[str, list] = {"bucket": [], "g": [], "grams": [], "every": [], "target": []}
    g = docs.column("g")[0].as_py() if docs.num_rows else None
    for kind in (0, 1) if docs.num_rows else ():
        grams, inverse = np.unique(np.concatenate(kinds[kind]), return_inverse=True)
        every, target = np.bincount(inverse), np.bincount(inverse, weights=np.concatenate(flags[kind])).astype(np.int64)
        bucket, key = _keys(grams, kind == 1, buckets)
        order = np.lexsort((key, bucket))
        bucket, key, every, target = bucket[order], key[order], every[order], target[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            for name, x in (("bucket", int(bucket[a])), ("g", g), ("grams", _pack48(key[a:b])), ("every", _pack(every[a:b])), ("target", _pack(target[a:b]))):
                out[name].append(x)
    return pa.table({n: pa.array(v, pa.binary() if n in ("grams", "every", "target") else pa.int64()) for n, v in out.items()})


def _answer(sent: pa.Table) -> pa.Table:
    """The same rows with counts over all groups, and how many grams, and what counts, the bucket has (in one row)."""
    grams = [_unpack48(x) for x in sent.column("grams").to_pylist()]
    sums = []
    distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    for name in ("every", "target"):
        sums.append(np.bincount(inverse, weights=np.concatenate([_unpack(x, len(k)) for x, k in zip(sent.column(name).to_pylist(), grams)]), minlength=len(distinct)).astype(np.int64))
    cuts = np.cumsum([0, *map(len, grams)])
    n = sent.num_rows
    one = lambda x: pa.array([int(x), *[0] * (n - 1)], pa.int64())
    packed = [pa.array([_pack(s[inverse[a:b]]) for a, b in zip(cuts, cuts[1:])], pa.binary()) for s in sums]
    return pa.table({"bucket": sent.column("bucket"), "g": sent.column("g"), "grams": sent.column("grams"), "every": packed[0], "target": packed[1], "distinct": one(len(distinct)), "n_every": one(sums[0].sum()), "n_target": one(sums[1].sum())})


def _score(docs: pa.Table, counts: pa.Table, buckets: int, totals: tuple[int, int, int]) -> pa.Table:
    """Rows (doc_id, n_tokens, target_loss, background_loss, score)."""
    vocabulary, *sizes = totals
    known: tuple[list, list] = ([], [])
    for bucket, raw, *packed in zip(*(counts.column(c).to_pylist() for c in ("bucket", "grams", "every", "target"))):
        keys = _unpack48(raw)
        known[bucket >= buckets].append((bucket, keys, *(_unpack(x, len(keys)) for x in packed)))
    tables = []
    for rows in known:  # sorted by bucket and key
        rows.sort(key=lambda r: r[0])
        first = {r[0]: a for r, a in zip(rows, np.cumsum([0, *(len(r[1]) for r in rows)]))}
        tables.append((first, rows, [np.concatenate([r[c] for r in rows]) if rows else np.zeros(0, np.int64) for c in (2, 3)]))

    def look_up(grams: np.ndarray, pairs: bool) -> list[np.ndarray]:
        first, rows, columns = tables[pairs]
        bucket, key = _keys(grams, pairs, buckets)
        place = np.zeros(len(grams), dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], [r[0] for r in rows], side="left").tolist() + [len(order)]
        for r, a, b in zip(rows, cuts, cuts[1:]):
            own = order[a:b]
            place[own] = first[r[0]] + np.searchsorted(r[1], key[own])
        return [c[place] for c in columns]

    tokens = [token_hashes(t) for t in _texts(docs)]
    out: dict[str, list] = {"n_tokens": [], "target_loss": [], "background_loss": []}
    for at in range(0, len(tokens), 512):
        part = tokens[at : at + 512]
        words, pairs = zip(*map(_grams, part))
        lens = [len(p) for p in pairs]
        word, pair = look_up(np.concatenate(words), False), look_up(np.concatenate(pairs), True)
        after = np.ones(sum(lens) + len(part), dtype=bool)  # every token but the first of each text
        after[np.cumsum([0, *(n + 1 for n in lens[:-1])])] = False
        before = np.roll(after, -1)
        losses = []
        for w, p, size in zip(word, pair, sizes):
            unigram = (w[after] + ALPHA) / (size + ALPHA * vocabulary)
            losses.append(-np.log((p + MU * unigram) / (w[before] + MU)))
        starts = np.cumsum([0, *lens[:-1]])
        out["n_tokens"] += lens
        out["background_loss"] += (np.add.reduceat(losses[0], starts) / lens).tolist()
        out["target_loss"] += (np.add.reduceat(losses[1], starts) / lens).tolist()
    target, background = np.array(out["target_loss"], dtype=float), np.array(out["background_loss"], dtype=float)
    return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "target_loss": pa.array(target), "background_loss": pa.array(background), "score": pa.array(target - background)})


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, n_tokens, target_loss, background_loss, score) for every document; target: documents with quality 1 in labels (doc_id, quality)."""
    docs = grouped_documents(docs, "lm")
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    targets = written(docs.select("g", "uid", "doc_id").join(good, "doc_id").select("g", "uid"), "targets")
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, -(-size // BUCKET_BYTES))
    sent = docs.groupBy("g").cogroup(targets.groupBy("g")).applyInArrow(lambda d, t: _send(d, t, buckets), GRAMS)
    answers = sent.groupBy("bucket").applyInArrow(_answer, GRAMS + ", distinct long, n_every long, n_target long")
    answers = written(answers, "counts")
    words = answers.where(F.col("bucket") < buckets).agg(F.sum("distinct"), F.sum("n_every"), F.sum("n_target")).first()
    # BEGIN is never predicted: it is no word of the vocabulary, and its counts are those of END
    pairs = answers.where(F.col("bucket") >= buckets).agg(F.sum("n_every"), F.sum("n_target")).first()
    totals = ((words[0] or 1) - 1, pairs[0] or 0, pairs[1] or 0)
    counts = answers.select("g", "bucket", "grams", "every", "target")
    return docs.groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(lambda d, c: _score(d, c, buckets, totals), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])
