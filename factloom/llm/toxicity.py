"""Toxicity scores by a convolutional text classifier trained in numpy.

A word's embedding is the sum of a hashed embedding of the whole word and one of its first letters, so that unseen forms of a
known stem are placed near it. Filters of widths WIDTHS run over the word sequence; each filter's greatest value in the
text (at least 0) goes to a logistic output. Long texts are pooled part by part, whole, and a border between parts makes no difference.

Training goes over every labelled row, its text whole, whose crc32(doc_id) mod 4 is 0 or 1: up to TRAINERS tasks each go over their rows in an order by
hash, in each of several rounds from the weights that all agreed on, and the weights of a round are the means of the trainers' (of an embedding row: weighted
by how often each trainer moved it). Thresholds are calibrated by language on all labelled rows with remainder 3, counted in LEVELS levels of the score, so
the driver gets no more than that for a language. Remainder 2 is held out. Labels, language, source and doc_id are never inputs of a score; the language only picks the threshold.

Nulls and edges: a null text is empty and gets the score of no evidence. Null labels, ids and languages take no part in training (a null language
has the common threshold). Rows that repeat a doc_id are scored one by one. Texts of any length are scored whole. No usable
labels: ValueError; an empty table, which needs none, gives an empty result.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SMALL_BUFFERS, column, drop_written, slices, text_or_empty, written

HELD_OUT, CALIBRATION = 2, 3
BITS, DIM, WIDTHS, FILTERS, STEM = 16, 8, (1, 2, 3), 8, 4
#: Passes over the rows: EPOCHS, or more until there are STEPS steps or WORK words have been gone over.
EPOCHS, STEPS, WORK, BATCH, RATE = 6, 1000, 200_000_000, 64, 0.015
#: Tasks that train at once, and the words for which there is another one; batches whose rows are mixed; rows of weights averaged together.
TRAINERS, TRAINER_WORDS, MIXED, PIECE = 64, 4_000_000, 32, 4096
#: Levels of the score in which rows are counted for thresholds.
LEVELS = 1 << 16
PAD = max(WIDTHS) - 1
#: Words pooled at once.
PART = 1 << 15

LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Ids(dict):
    """Hash buckets of words, remembered: the word's in the high half, the stem's in the low half."""

    def __missing__(self, word: bytes) -> int:
        mask = (1 << BITS) - 1
        out = ((zlib.crc32(word) & mask) << BITS) | (zlib.crc32(b"^" + word[:STEM]) & mask)
        if len(self) > 1 << 18:
            self.clear()
        self[word] = out
        return out


_ids = _Ids()


def word_ids(text: str) -> np.ndarray:
    words = text.lower().encode("utf-8", "replace").translate(LETTERS).split()
    return np.fromiter(map(_ids.__getitem__, words), dtype=np.int64, count=len(words))


class Classifier:
    """word, stem: embeddings; conv[k]: weights (k, DIM, FILTERS) and biases of width k; out: output weights and bias."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        n = (1 << BITS) + 1  # the last row is padding, always 0
        self.p = {"word": f(n, DIM) * 0.1, "stem": f(n, DIM) * 0.1, "out": f(len(WIDTHS) * FILTERS) * 0.1, "bias": np.full(1, -2, np.float32)}
        self.p["word"][-1] = self.p["stem"][-1] = 0
        for k in WIDTHS:
            self.p[f"w{k}"] = f(k, DIM, FILTERS) / np.float32(np.sqrt(k * DIM))
            self.p[f"b{k}"] = np.zeros(FILTERS, np.float32)

    def _rows(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The embedding rows of all texts, PAD padding rows after each, and where each text begins and ends."""
        pad = np.full(PAD, -1, dtype=np.int64)
        flat = np.concatenate([x.astype(np.int64, copy=False) for i in ids for x in (i, pad)])
        lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        ends = np.cumsum(lens + PAD) - PAD
        none = 1 << BITS
        return np.where(flat < 0, none, flat >> BITS), np.where(flat < 0, none, flat & (none - 1)), ends - lens, ends

    def train(self, rows: Iterator[tuple[np.ndarray, int]], rate: Callable[[int], float], seed: int = 7) -> int:
        """Goes over the rows (ids, label) once, MIXED batches mixed at a time; rate: the learning rate after so many rows. Gives the number of rows."""
        rng = np.random.default_rng(seed)
        if not hasattr(self, "moments"):
            self.moments, self.step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
            self.moved = {k: np.zeros(len(v) if k in ("word", "stem") else 1, np.float32) for k, v in self.p.items()}
        done, some, size = 0, [], 0

        def learn() -> None:
            nonlocal done
            order = rng.permutation(len(some))
            for at in range(0, len(some), BATCH):
                own = [some[i] for i in order[at : at + BATCH]]
                self.step += 1
                self._adam(self._gradients([x for x, _ in own], np.array([y for _, y in own], np.float32)), self.moments, self.step, rate(done))
                done += len(own)

        for ids, toxic in rows:
            some.append((ids, toxic))
            size += len(ids)
            if len(some) >= MIXED * BATCH or size >= MIXED * PART:
                learn()
                some, size = [], 0
        learn()
        return done

    def _parts(self, ids: list[np.ndarray]) -> Iterator[list[tuple[int, np.ndarray, bool]]]:
        """Lists of parts of about PART words together: text, ids, whether the text ends here. Parts of a long text overlap by the widest filter."""
        parts: list[tuple[int, np.ndarray, bool]] = []
        size = 0
        for d, own in enumerate(ids):
            for at in range(0, len(own), PART - PAD):
                last = at + PART >= len(own)
                parts.append((d, own[at : at + PART], last))
                size += len(parts[-1][1]) + PAD
                if size >= PART:
                    yield parts
                    parts, size = [], 0
                if last:
                    break
        if parts:
            yield parts

    def _gradients(self, ids: list[np.ndarray], toxic: np.ndarray) -> dict[str, np.ndarray]:
        p, none = self.p, 1 << BITS
        top = np.full((len(ids), len(WIDTHS), FILTERS), -np.inf, np.float32)
        # the embedding rows of the words under each filter where it is greatest
        at_word, at_stem = (np.full((len(ids), len(WIDTHS), FILTERS, max(WIDTHS)), none, np.int64) for _ in range(2))
        for parts in self._parts(ids):
            word, stem, begin, end = self._rows([x for _, x, _ in parts])
            across = np.ascontiguousarray((p["word"][word] + p["stem"][stem]).T)
            for w, k in enumerate(WIDTHS):
                conv = sum(p[f"w{k}"][j].T @ across[:, j : len(word) - PAD + j] for j in range(k)) + p[f"b{k}"][:, None]
                for (d, _, last), a, b in zip(parts, begin.tolist(), end.tolist()):
                    best = conv[:, a : b if last else b - PAD].argmax(axis=1) + a
                    value = conv[np.arange(FILTERS), best]
                    more = value > top[d, w]
                    top[d, w, more] = value[more]
                    places = best[more][:, None] + np.arange(max(WIDTHS))
                    at_word[d, w, more], at_stem[d, w, more] = word[places], stem[places]
        pooled = np.maximum(0, top)
        flat = pooled.reshape(len(ids), -1)
        error = (1 / (1 + np.exp(-np.clip(flat @ p["out"] + p["bias"][0], -30, 30))) - toxic) / len(ids)
        grads = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "stem")}
        grads["out"], grads["bias"] = flat.T @ error, error.sum(keepdims=True)
        back = (error[:, None] * p["out"]).reshape(pooled.shape) * (pooled > 0)
        touched: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for w, k in enumerate(WIDTHS):
            g = back[:, w].astype(np.float32)
            grads[f"b{k}"] = g.sum(axis=0)
            for j in range(k):
                words, stems = at_word[:, w, :, j], at_stem[:, w, :, j]
                grads[f"w{k}"][j] = np.einsum("bf,bfd->df", g, p["word"][words] + p["stem"][stems])
                touched.append((words.ravel(), stems.ravel(), np.einsum("bf,df->bfd", g, p[f"w{k}"][j]).reshape(-1, DIM)))
        words, stems, to = (np.concatenate(x) for x in zip(*touched))
        for name, own in (("word", words), ("stem", stems)):
            rows, back_to = np.unique(own, return_inverse=True)
            g = np.zeros((len(rows), DIM), np.float32)
            np.add.at(g, back_to, to)
            g[rows == none] = 0
            grads[name] = (rows, g)
        return grads

    def _adam(self, grads: dict, moments: dict, step: int, rate: float) -> None:
        for k, g in grads.items():
            m, v = moments[k]
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.99 * v[rows] + 0.01 * g**2
            self.p[k][rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-7)
            self.moved[k][rows] += 1

    def __getstate__(self) -> dict:
        """Weights only: what `prepare` makes of them is made again where the classifier is sent."""
        return {"p": self.p}

    def prepare(self) -> None:
        """Products of every embedding row with every filter tap, so that scoring only adds rows."""
        taps = np.concatenate([self.p[f"w{k}"][j] for k in WIDTHS for j in range(k)], axis=1)
        self.word_taps, self.stem_taps = self.p["word"] @ taps, self.p["stem"] @ taps

    def forget(self) -> None:
        """Drops what `prepare` made."""
        self.__dict__.pop("word_taps", None)
        self.__dict__.pop("stem_taps", None)

    def score(self, ids: list[np.ndarray]) -> np.ndarray:
        if not ids:
            return np.zeros(0)
        if not hasattr(self, "word_taps"):
            self.prepare()
        pooled = np.zeros((len(ids), len(WIDTHS) * FILTERS), np.float32)
        for parts in self._parts(ids):
            self._pool(parts, pooled)
        z = pooled.astype(np.float64) @ self.p["out"].astype(np.float64) + float(self.p["bias"][0])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def _pool(self, parts: list[tuple[int, np.ndarray, bool]], pooled: np.ndarray) -> None:
        """Only where a text ends may a window reach into the padding."""
        word, stem, begin, end = self._rows([x for _, x, _ in parts])
        end = end - np.array([0 if last else PAD for _, _, last in parts])
        taps = self.word_taps[word] + self.stem_taps[stem]
        bounds = np.stack([begin, end], axis=1).ravel()
        n, tap = len(taps) - PAD, 0
        for w, k in enumerate(WIDTHS):
            conv = sum(taps[j : n + j, (tap + j) * FILTERS : (tap + j + 1) * FILTERS] for j in range(k)) + self.p[f"b{k}"]
            conv = np.concatenate([conv, np.zeros((PAD, FILTERS), np.float32)])
            best = np.maximum.reduceat(conv, bounds, axis=0)[::2]
            np.maximum.at(pooled, (np.array([d for d, _, _ in parts])[:, None], np.arange(w * FILTERS, (w + 1) * FILTERS)), best)
            tap += k


def remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, lang, toxic, n, ids) of all documents with a label that aren't held out, their word ids whole, in an order by hash, in a written table."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [word_ids(t) for t in column(batch, "text").to_pylist()]
            ids = pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("part", "lang", "toxic")] + [pa.array(list(map(len, found)), pa.int64()), ids], names=["part", "lang", "toxic", "n", "ids"])
        _give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"), text_or_empty().alias("text"))
    texts = texts.withColumn("part", remainder()).where(F.col("part") != HELD_OUT)
    # by shuffle whatever the size: the order is by hash, and the disk it takes is in proportion to the input
    rows = texts.join(known.hint("merge"), "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), F.xxhash64("text"))
    return written(rows.select("part", "lang", "text", "toxic").mapInArrow(run, "part long, lang string, toxic int, n long, ids binary"), "labelled", SMALL_BUFFERS)


def _ids_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u4") for x in column(batch, "ids")]


def _learn(rows: DataFrame, n: int, words: int) -> Classifier:
    """The classifier trained on all rows (ids, toxic): n of them, words in all."""
    trainers = max(1, min(TRAINERS, n, -(-words // TRAINER_WORDS)))
    passes = max(EPOCHS, min(-(-STEPS // -(-n // BATCH)), WORK // max(1, words)))
    rounds = 1 if trainers == 1 else EPOCHS
    each = -(-passes // rounds)
    spread = rows.select("ids", "toxic").coalesce(trainers)
    model = Classifier()
    for r in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, r=r) -> Iterator[pa.RecordBatch]:
            own, at = Classifier.__new__(Classifier), TaskContext.get().partitionId()
            own.p = {k: v.copy() for k, v in sent.value.p.items()}
            got = ((ids, y) for b in batches for ids, y in zip(_ids_of(b), column(b, "toxic").to_pylist()))
            kept = list(got) if each > 1 else got  # there is more than one pass only over few words
            mine = len(kept) if each > 1 else n / trainers
            total = 0
            for k in range(each):
                begun = r + k / each
                total += own.train(iter(kept) if each > 1 else kept, lambda done, begun=begun: RATE * max(0.0, 1 - (begun + min(1.0, done / max(1, mine)) / each) / rounds), seed=7 + r * each + k)
            names, pieces, deltas, weights = [], [], [], []
            for k, v in own.p.items():
                change = v - sent.value.p[k]
                moved = own.moved[k] if k in ("word", "stem") else np.full(len(v), total, np.float32)
                for a in range(0, len(v), PIECE):
                    if moved[a : a + PIECE].any():
                        names.append(k)
                        pieces.append(a)
                        deltas.append(change[a : a + PIECE].tobytes())
                        weights.append(moved[a : a + PIECE].tobytes())
            del own, kept, got
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(names)), pa.array(names), pa.array(pieces), pa.array(deltas, pa.binary()), pa.array(weights, pa.binary())], names=["trainer", "name", "piece", "change", "weight"])
            _give_back()

        def mean(made: pa.Table) -> pa.Table:
            made = made.sort_by("trainer")  # sums don't depend on the order in which tasks end
            weight = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in made["weight"]]).astype(np.float64)
            change = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in made["change"]]).reshape(*weight.shape, -1)
            out = (change * weight[:, :, None]).sum(axis=0) / np.maximum(weight.sum(axis=0), 1)[:, None]
            return made.slice(0, 1).select(["name", "piece"]).append_column("change", pa.array([out.astype(np.float32).tobytes()], pa.binary()))

        made = spread.mapInArrow(run, "trainer long, name string, piece long, change binary, weight binary")
        for x in made.groupBy("name", "piece").applyInArrow(mean, "name string, piece long, change binary").collect():
            to = model.p[x.name][x.piece : x.piece + PIECE]
            to += np.frombuffer(x.change, np.float32).reshape(to.shape)
        sent.unpersist()
    return model


def calibrate(scores: np.ndarray, toxic: np.ndarray, rows: np.ndarray | None = None, tops: np.ndarray | None = None) -> float:
    """The threshold with the best F1, in the middle of the gap below it, between 0.05 and 0.95. For levels: their least scores, toxic rows, rows and greatest scores."""
    rows, tops = np.ones(len(scores), np.int64) if rows is None else rows, scores if tops is None else tops
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(toxic[order])
    last = np.concatenate([scores[order][1:] < scores[order][:-1], [True]])
    f1 = np.where(last, 2 * hits / (np.cumsum(rows[order]) + toxic.sum()), -1)
    k = int(f1.argmax())
    below = tops[order][k + 1] if k + 1 < len(order) else 0.0
    return float(np.clip((scores[order][k] + below) / 2, 0.05, 0.95))


def _limits(model: Classifier, held: DataFrame, least_toxic: int) -> dict[str | None, float]:
    sent = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([column(batch, "lang"), column(batch, "toxic"), pa.array(sent.value.score(_ids_of(batch)))], names=["lang", "toxic", "score"])
        sent.value.forget()
        _give_back()

    scored = written(held.select("lang", "toxic", "ids").mapInArrow(run, "lang string, toxic int, score double"), "scored")
    apart = scored.where("lang is not null").groupBy("lang").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).where(f"toxic >= {least_toxic} and toxic < n").collect()
    lang = F.when(F.col("lang").isin([r.lang for r in apart]), F.col("lang")) if apart else F.lit(None).cast("string")
    levels = scored.groupBy(lang.alias("lang"), F.floor(F.col("score") * LEVELS).alias("level")).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.min("score").alias("low"), F.max("score").alias("top")).toPandas()
    every = levels.groupby("level").agg(n=("n", "sum"), toxic=("toxic", "sum"), low=("low", "min"), top=("top", "max"))
    limits: dict[str | None, float] = {}
    for name, own in [(None, every), *((r.lang, levels[levels.lang == r.lang]) for r in sorted(apart))]:
        limits[name] = calibrate(own.low.to_numpy(), own.toxic.to_numpy(), own.n.to_numpy(), own.top.to_numpy())
    drop_written(scored)
    sent.unpersist()
    return limits


def _give_back() -> None:
    """Gives memory back to the system, where the C library can: an idle worker shares an executor's memory with its JVM."""
    _ids.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def fit(docs: DataFrame, labels: DataFrame, least_toxic: int = 10) -> tuple[Classifier, dict[str | None, float]]:
    """The classifier, and thresholds by language (None: all languages together)."""
    rows = _labelled(docs, labels)
    held = F.col("part") == CALIBRATION
    of = {r.held: r for r in rows.groupBy(held.alias("held")).agg(F.count("*").alias("rows"), F.sum("n").alias("words")).collect()}
    if not of:
        drop_written(rows)
        if docs.isEmpty():
            return Classifier(), {None: 0.5}
        raise ValueError("no labelled documents to learn from")
    own = of.get(False, of.get(True))
    model = _learn(rows.where(~held) if False in of else rows, own.rows, own.words)
    limits = _limits(model, rows.where(held) if True in of else rows, least_toxic)
    drop_written(rows)
    return model, limits


def scores(spark, model: Classifier, limits: dict[str | None, float], has_lang: bool = True) -> tuple[Column, Column]:
    """Columns for documents (text[, lang]): the score as double, and whether it reaches the threshold of the row's language."""
    score = _score(spark, model)(text_or_empty())
    limit = F.lit(limits[None])
    for lang, value in limits.items() if has_lang else ():
        if lang is not None:
            limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    return score, score >= limit


def keep_clean(docs: DataFrame, model: Classifier, limits: dict[str | None, float]) -> DataFrame:
    """The documents that aren't rejected, with their columns as they are."""
    return docs.where(~scores(docs.sparkSession, model, limits, "lang" in docs.columns)[1])


def _score(spark, model: Classifier):
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            found = [sent.value.score([word_ids(t) for t in part.slice(at, 256).to_pylist()]) for at in range(0, len(part), 256)]
            yield pa.array(np.concatenate(found) if found else [], pa.float64())
        sent.value.forget()
        _give_back()

    return score


def digest(docs: DataFrame, model: Classifier, limits: dict[str | None, float]) -> DataFrame:
    score, rejected = scores(docs.sparkSession, model, limits, "lang" in docs.columns)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"), rejected.alias("rejected"))
    return scored.select("doc_id", F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "rejected")
