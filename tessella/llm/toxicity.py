"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is itself plus its character n-grams (with edge marks), hashed into a fixed table of vectors; a
window of ``WINDOW`` words is the average of its subwords' vectors under a two-class softmax, and a
text is as toxic as its worst window, so a few words tell in a long text too. Embeddings and softmax
are trained together (Adagrad, on the driver) on windows of a bounded sample of labelled texts:
``TRAIN_TEXTS`` of each class at most, chosen by a hash of the id, and ``TRAIN_BYTES`` of each class; a
text over ``TEXT_BYTES`` trains with its beginning. Subwords that few training texts have learn in
proportion to how many do (``RARE``), for they would mostly be memorised. The first round takes each
window's label from its text; the second takes toxic texts' innocent windows as clean. Unseen
misspellings share the n-gram vectors of the words they distort.

Scoring: the logit is linear in the subwords, so the broadcast model is one number a table entry (a
fixed ``BUCKETS``), and a word's share is computed once a worker and cached. There is no shuffle.

Edge cases: null and empty texts score like a window without subwords (the bias alone); very long
texts are scored whole; repeated rows score alike; without labels of both classes every score is the
share of toxic labels (0 without labels); an empty table gives an empty result; other columns are
ignored; rows without a label never train.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BoundedCache, id_and_text, kept, map_arrow, trim

#: The documented bounds of the training sample, for each class and each text.
TRAIN_TEXTS, TRAIN_BYTES, TEXT_BYTES = 1_500, 16 << 20, 256 << 10
BUCKETS, DIM, WINDOW, GRAMS = 1 << 17, 4, 8, (3, 4, 5)
#: A window with fewer subwords is averaged as if empty ones filled it, so that short ones aren't shrill.
FILL = 64
#: Every so many-th training text only calibrates.
CALIBRATE = 5
#: A subword of n training texts learns at n / (n + RARE) of the rate, from as small a start.
RARE = 2.0
#: First round: what all windows of toxic texts weigh together, as a share of the clean ones' weight.
WEAK = 0.08
ROUNDS, EPOCHS, STEPS, BATCH, RATE, DECAY = 3, 2, 120, (64, 2_048), 0.3, 1e-4
THRESHOLD = 0.3
_TRIM = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}"


def subwords(word: str) -> list[int]:
    """Table entries of a word: itself and its character n-grams."""
    w = "<" + word.lower().strip(_TRIM) + ">"
    if len(w) == 2:
        return []
    size, own, crc = len(w), w.encode(), zlib.crc32
    if len(own) == size:  # characters are bytes
        grams = [own[i : i + n] for n in GRAMS for i in range(size - n + 1)]
    else:
        grams = [w[i : i + n].encode() for n in GRAMS for i in range(size - n + 1)]
    grams.append(b"=" + own)
    return [crc(g) % BUCKETS for g in grams]


@dataclass
class Model:
    """The trained model folded to one logit a table entry, the bias, and the calibration of a text's worst logit."""

    logits: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self._logit = self.logits.tolist().__getitem__  # of a few numbers at a time, a list is faster

    def word(self, word: str) -> complex:
        """Sum of a word's logits and, as the imaginary part, the number of its subwords."""
        own = subwords(word)
        return complex(sum(map(self._logit, own)), len(own))

    def worst(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The largest window logit of each text, from the texts' ``word`` values one after the other."""
        out = np.full(len(sizes), self.bias)
        some = np.flatnonzero(sizes)
        if some.size:
            n = -(-sizes[some] // WINDOW)
            first = np.cumsum(n) - n
            begin = np.cumsum(sizes[some]) - sizes[some]
            at = np.repeat(begin, n) + WINDOW * (np.arange(n.sum()) - np.repeat(first, n))
            sums = np.add.reduceat(words, at)
            out[some] = np.maximum.reduceat(sums.real / np.maximum(sums.imag, FILL) + self.bias, first)
        return out

    def scores(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.worst(words, sizes) + self.shift, -30, 30)))

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """``worst`` of some texts."""
        cache = BoundedCache(self.word)
        words = [t.split() for t in texts]
        return self.worst(np.array([cache[w] for t in words for w in t], np.complex128), np.array([len(t) for t in words], np.int64))


def calibrate(logits: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Scale and shift of a logistic fit, classes weighted to the natural share of toxic texts, pulled to (1, 0)."""
    weight = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum())) * len(labels)
    x = np.stack([np.clip(logits, -30, 30), np.ones(len(logits))], 1)
    beta, prior = np.array([1.0, 0.0]), np.diag([1.0, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + prior @ (beta - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + prior
        beta = beta - np.clip(np.linalg.solve(curve, slope), -1, 1)
    return float(max(beta[0], 0.05)), float(beta[1])


def fit_texts(texts: list[str], labels: list[int], share: float | None = None) -> Model:
    """Train on most texts and calibrate on the rest."""
    held = [i for i in range(len(texts)) if i % CALIBRATE == 0]
    rest = [i for i in range(len(texts)) if i % CALIBRATE]
    model = train([texts[i] for i in rest], [labels[i] for i in rest])
    y = np.array([labels[i] for i in held])
    if 0 < y.sum() < len(y):
        model.scale, model.shift = calibrate(model.of_texts([texts[i] for i in held]), y, share or y.mean())
    return model


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit embeddings and softmax jointly, uncalibrated; see the module."""
    share = sum(labels) / len(labels) if labels else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(BUCKETS), 30.0 if share else -30.0)
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    words, text_of = [], []
    for k, t in enumerate(texts):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in t.split()]
        words.append(np.array(ids, np.int32))
        text_of += [k] * -(-len(ids) // WINDOW)
    flat_grams, sizes = array("i"), array("i")  # compact: a vocabulary has millions of subwords
    for w in vocabulary:
        own = subwords(w)
        flat_grams.extend(own)
        sizes.append(len(own))
    vocabulary.clear()
    gram, gram_n = np.frombuffer(flat_grams, np.int32) if flat_grams else np.empty(0, np.int32), np.array(sizes, np.int64)
    gram_at = np.cumsum(gram_n) - gram_n
    texts_with = np.zeros(BUCKETS, np.int32)
    for ids in words:
        u = np.unique(ids)
        m = gram_n[u]
        texts_with[np.unique(gram[np.repeat(gram_at[u], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)])] += 1
    known = (texts_with / (texts_with + RARE)).astype(np.float32)
    flat = np.concatenate(words)
    begin, count = [], []
    at = 0
    for ids in words:
        starts = np.arange(0, len(ids), WINDOW)
        begin.append(at + starts)
        count.append(np.minimum(WINDOW, len(ids) - starts))
        at += len(ids)
    begin, count, text_of = np.concatenate(begin), np.concatenate(count), np.array(text_of)
    weak = np.array(labels)[text_of]

    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32) * known[:, None]
    soft, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_table, seen_soft, seen_bias = np.full(BUCKETS, 1e-8, np.float32), np.full((DIM, 2), 1e-2, np.float32), np.full(2, 1e-2, np.float32)

    def expand(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = count[rows]
        ids = flat[np.repeat(begin[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        m = gram_n[ids]
        own = gram[np.repeat(gram_at[ids], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        return own, np.bincount(np.repeat(np.arange(len(rows)), n), weights=m, minlength=len(rows)).astype(np.int64)

    def average(own: np.ndarray, size: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(size), DIM), np.float32)
        some = np.flatnonzero(size)
        if some.size:
            sums[some] = np.add.reduceat(table[own], (np.cumsum(size) - size)[some], axis=0)
        return sums / np.maximum(size, FILL)[:, None]

    def logit(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([(average(*expand(rows[i : i + BATCH[1]])) @ (soft[:, 1] - soft[:, 0]) + bias[1] - bias[0]) for i in range(0, len(rows), BATCH[1])])

    every, target = np.arange(len(begin)), weak.copy()
    batch = int(np.clip(len(every) // STEPS, *BATCH))
    light = min(1.0, WEAK * max(1, (weak == 0).sum()) / max(1, (weak == 1).sum()))
    for turn in range(ROUNDS):
        for _ in range(EPOCHS):
            order = rng.permutation(every)
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                own, size = expand(rows)
                mean = average(own, size)
                z = mean @ soft + bias
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(rows)), target[rows]] -= 1
                if not turn:
                    z *= np.where(target[rows] == 1, light, 1.0)[:, None]
                z /= np.sqrt(len(rows))
                back = np.repeat((z @ soft.T) / np.maximum(size, FILL)[:, None], size, axis=0)
                step = np.stack([np.bincount(own, weights=back[:, k], minlength=BUCKETS) for k in range(DIM)], 1).astype(np.float32)
                seen_table += (step**2).sum(1) / DIM
                table -= known[:, None] * (RATE * step / np.sqrt(seen_table)[:, None] + DECAY * table)
                g = mean.T @ z
                seen_soft += g**2
                soft -= RATE * g / np.sqrt(seen_soft)
                g = z.sum(0)
                seen_bias += g**2
                bias -= RATE * g / np.sqrt(seen_bias)
        # toxic texts keep their worst window and all that look toxic; the rest of their windows are clean
        found = logit(every)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, text_of, found)
        target = ((weak == 1) & ((found > 0) | (found >= worst[text_of]))).astype(weak.dtype)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def _fold(id_col: Column, folds: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """Train on at most ``TRAIN_TEXTS`` texts of each class outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (_fold(F.col("doc_id"), folds) != held_out))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen: dict[int, int] = {}
    for kind in (0, 1):
        for r in known.filter(F.col("toxic") == kind).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_TEXTS).collect():
            chosen[r.doc_id] = kind
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    texts = id_and_text(docs).join(F.broadcast(ids), "doc_id", "left_semi")  # ids: 2 * TRAIN_TEXTS at most
    # rows that share an id count once, the one with the smallest digest
    sizes = texts.groupBy("doc_id").agg(F.min(F.struct(F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"), F.octet_length("text").alias("size"))).alias("t")).select("doc_id", "t.*")
    left, parts = [TRAIN_BYTES, TRAIN_BYTES], []
    for r in sorted(sizes.collect(), key=lambda r: (zlib.crc32(r.digest.encode()), r.doc_id)):
        size = min(r.size, TEXT_BYTES, left[chosen[r.doc_id]])
        left[chosen[r.doc_id]] -= size
        if size or not r.size:
            parts.append((r.doc_id, r.digest, r.chars * size // max(1, r.size)))
    wanted = spark.createDataFrame(parts, "doc_id long, digest string, chars int")
    cut = texts.withColumn("digest", F.sha2("text", 256)).join(F.broadcast(wanted), ["doc_id", "digest"]).select("doc_id", F.expr("substring(text, 1, chars)").alias("text"))
    sample = sorted({r.doc_id: r.text for r in cut.toLocalIterator()}.items())
    trim()
    try:
        return fit_texts([t for _, t in sample], [chosen[i] for i, _ in sample], counts.get(1, 0) / max(1, sum(counts.values())))
    finally:
        trim()


def _score(shared, call: str, texts: list[str | None]) -> np.ndarray:
    """Scores of some whole texts in a worker, by the broadcast model and the worker's word cache."""

    def make():
        m = Model(*shared.value)
        return m, BoundedCache(m.word)

    own, cache = kept("toxicity", call, make)
    look, values, sizes, scores = cache.__getitem__, [], [], []
    for i, text in enumerate(texts):
        words = (text or "").split()
        values += map(look, words)
        sizes.append(len(words))
        if len(values) > 500_000 or i + 1 == len(texts):
            scores.append(own.scores(np.array(values, np.complex128), np.array(sizes, np.int64)))
            values, sizes = [], []
    return np.concatenate(scores)


def _share(docs: DataFrame, model: Model):
    values = (model.logits.astype(np.float32), model.bias, model.scale, model.shift)  # BUCKETS numbers, whatever the input
    return docs.sparkSession.sparkContext.broadcast(values), uuid.uuid4().hex


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every whole text."""
    shared, call = _share(docs, fit(docs, labels, folds, held_out))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _score(shared, call, batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = map_arrow(id_and_text(docs), score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(_fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under the threshold; nothing is shuffled."""
    shared, call = _share(docs, fit(docs, labels))
    at = docs.columns.index("text")

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_score(shared, call, batch.column(at).to_pylist()) < threshold))

    return map_arrow(docs, clean, docs.schema)
