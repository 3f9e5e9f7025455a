"""Language identification by prediction by partial matching over bytes, under frozen statistics.

For each language a context tree holds the bytes that followed each context of up to ``ORDER`` bytes.
A byte's probability comes from the longest known context; one that hasn't been seen there escapes
to the next shorter (escape method C: distinct / (total + distinct)) down to the uniform. A text's
score in a language is its exact code length in bits; the shortest code wins, and ``score`` is the
winner's share of 2^-length over all languages.

Training: a bounded sample of each language's texts, chosen by a hash of the id: ``TRAIN_ROWS`` texts or
so and ``TRAIN_BYTES`` a language, ``TOTAL_BYTES`` shared evenly by all of them; a text over what is left
of its language's bound gives its first bytes. Every language of the training rows is learned. The trees
of all languages are folded into one table: state (longest context known to any language) and byte class
to the code lengths. Contexts that no language saw often enough are left to shorter ones: ``LEAST`` times,
or more where the table would pass ``TABLE_BYTES``, so what is broadcast is bounded and checked whatever
the languages are. A state is a function of the last ``ORDER`` bytes, so scoring is two table lookups a
byte for a whole batch of texts at once, without shuffles.

Edge cases: texts that are null or have no letter get ``und`` and score 0; without any training text
every text does; very long texts are coded whole; repeated rows are predicted alike; an empty table
gives an empty result; other columns are ignored, and lang, source and id never enter a prediction.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept, map_arrow, trim

#: The documented bounds of training, and the least number of times a context must occur.
TRAIN_BYTES, TRAIN_ROWS, TOTAL_BYTES, LEAST = 400_000, 400, 32 << 20, 4
#: Bound of the table of code lengths. The index of states has (byte classes) ^ 3 numbers besides, 68 MB at most.
TABLE_BYTES = 48 << 20
ORDER, SLICE = 3, 1 << 20
#: A text is in a language if it takes no more bits a byte than MARGIN times this quantile of the training
#: texts, and SLACK bits for short texts.
QUANTILE, MARGIN, SLACK = 0.99, 1.6, 128
UNKNOWN = "und"


@dataclass
class ContextTrees:
    """Folded trees: byte -> class, last three classes -> state, (state, class) -> bits in each language."""

    languages: list[str]
    classes: np.ndarray
    states: np.ndarray
    bits: np.ndarray
    limits: np.ndarray | None = None  # bits a byte that texts of each language stay under

    def code_lengths(self, bodies: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(bodies), len(self.languages)))
        width = int(self.classes.max()) + 1
        rows: list[int] = []
        size = 0

        def code() -> None:
            if not rows:
                return
            # a byte of the unseen class before each text: contexts never reach into the text before
            joined = b"".join(b"\xff" * ORDER + bodies[i] for i in rows)
            c = self.classes[np.frombuffer(joined, np.uint8)]
            sizes = np.array([len(bodies[i]) + ORDER for i in rows])
            begin = np.cumsum(sizes) - sizes
            inside = np.ones(len(c), bool)
            for k in range(ORDER):
                inside[begin + k] = False
                c[begin + k] = 0
            at = np.flatnonzero(inside)
            context = (c[at - 3] * width + c[at - 2]) * width + c[at - 1]
            bits = self.bits[self.states[context].astype(np.int64) * width + c[at]]
            lengths = sizes - ORDER
            first = np.cumsum(lengths) - lengths
            out[rows] = np.add.reduceat(bits, first, axis=0, dtype=np.float64)

        for i, body in enumerate(bodies):
            if body:
                rows.append(i)
                size += len(body)
            if size >= SLICE:
                code()
                rows, size = [], 0
        code()
        return out

    def predict(self, bodies: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        lengths = self.code_lengths(bodies)
        best = lengths.argmin(1)
        gap = np.minimum(lengths - lengths.min(1, keepdims=True), 1000)
        return [self.languages[k] for k in best], 1 / np.exp2(-gap).sum(1), lengths.min(1)

    def fits(self, bodies: list[bytes]) -> np.ndarray:
        """Whether each text, as it is or in lower case, codes as short as texts of a language do."""

        def short(some: list[bytes]) -> np.ndarray:
            sizes = np.array([len(b) for b in some], np.float64)
            return (self.code_lengths(some) <= sizes[:, None] * self.limits + SLACK).any(1)

        ok = short(bodies)
        again = np.flatnonzero(~ok)
        if again.size:
            ok[again] = short([bodies[i].decode(errors="ignore").lower().encode() for i in again])
        return ok


def _followers(data: np.ndarray, order: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(context * width + next) codes of all strings of order + 1 classes, and their counts."""
    code = np.zeros(len(data) - order, np.int64) if len(data) > order else np.empty(0, np.int64)
    for k in range(order + 1):
        code = code * width + data[k : k + len(code)]
    return np.unique(code, return_counts=True)


def fit_trees(texts: dict[str, list[bytes]]) -> ContextTrees:
    """Context trees of each language, folded; see the module. Class 0 is for bytes never seen."""
    names = sorted(texts)
    if not names:
        return ContextTrees([], np.zeros(256, np.int64), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    joined = {n: np.frombuffer(b"\xff".join(texts[n]), np.uint8) for n in names}
    seen = np.unique(np.concatenate([j for j in joined.values()] or [np.empty(0, np.uint8)]))
    seen = seen[seen != 255]
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    counts = {(n, k): _followers(classes[joined[n]], k, width) for n in names for k in range(ORDER + 1)}
    # contexts of each order, by code; those with an unseen class stand for a text's start only
    contexts, most = [np.zeros(1, np.int64)], [np.full(1, np.iinfo(np.int64).max)]
    for k in range(1, ORDER + 1):
        found, often = [], []
        for n in names:
            code, times = counts[n, k]
            owner, at = np.unique(code // width, return_index=True)
            found.append(owner)
            often.append(np.add.reduceat(times, at) if len(at) else times)
        codes, of = np.unique(np.concatenate(found), return_inverse=True)
        most.append(np.zeros(len(codes), np.int64))
        np.maximum.at(most[k], of, np.concatenate(often))
        has_zero = np.zeros(len(codes), bool)
        for d in range(k):
            has_zero |= codes // width**d % width == 0
        contexts.append(codes[~has_zero])
        most[k] = most[k][~has_zero]
    # a context's ending is as frequent as the context at least: what one threshold leaves is closed
    room = max(1, TABLE_BYTES // (4 * width * len(names)))
    ranked = np.sort(np.concatenate(most))[::-1]
    least = max(LEAST, int(ranked[room]) + 1 if len(ranked) > room else 0)
    contexts = [c[m >= least] for c, m in zip(contexts, most)]
    first = np.cumsum([0, *(len(c) for c in contexts)])
    probability = np.full((first[-1], width, len(names)), 1 / 256)
    for k, codes in enumerate(contexts):
        rows = slice(first[k], first[k + 1])
        for j, n in enumerate(names):
            if k:
                up = np.searchsorted(contexts[k - 1], codes % width ** (k - 1))
                up = np.minimum(up, max(0, len(contexts[k - 1]) - 1))
                shorter = probability[first[k - 1] + up, :, j]
            else:
                shorter = np.full((1, width), 1 / 256)
            table = np.zeros((len(codes), width))
            code, times = counts[n, k]
            at = np.searchsorted(codes, code // width)
            ok = at < len(codes)
            ok[ok] = codes[at[ok]] == code[ok] // width
            table[at[ok], code[ok] % width] = times[ok]
            table[:, 0] = 0
            total, distinct = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
            escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
            probability[rows, :, j] = np.where(table > 0, table / np.maximum(total + distinct, 1), escape * shorter)
    states = np.zeros(width**ORDER, np.uint16 if first[-1] < 1 << 16 else np.int32)
    every = np.arange(width**ORDER)
    for k in range(1, ORDER + 1):
        code = every % width**k
        at = np.minimum(np.searchsorted(contexts[k], code), max(0, len(contexts[k]) - 1))
        hit = contexts[k][at] == code if len(contexts[k]) else np.zeros(len(code), bool)
        states[hit] = first[k] + at[hit]
    bits = -np.log2(probability).reshape(-1, len(names)).astype(np.float32)
    return ContextTrees(names, classes, states, bits)


def with_limits(trees: ContextTrees, texts: dict[str, list[bytes]]) -> ContextTrees:
    """``trees`` with each language's limit: the ``QUANTILE`` of what half of its texts cost under the other half."""
    trees.limits = np.full(len(trees.languages), np.inf)
    halves = [{n: [b for b in t if b][k::2] for n, t in texts.items()} for k in range(2)]
    models = [fit_trees({n: t for n, t in h.items() if t}) for h in halves]
    for j, n in enumerate(trees.languages):
        cost = [m.code_lengths(h[n])[:, m.languages.index(n)] / [len(b) for b in h[n]] for m, h in zip(models, halves[::-1]) if n in m.languages and h[n]]
        if len(cost) == 2:  # one text alone says nothing about others
            trees.limits[j] = MARGIN * np.quantile(np.concatenate(cost), QUANTILE)
    return trees


def fit(docs: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees:
    """Train on a bounded sample outside the held-out fold."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (fold != held_out))
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary").alias("body"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    if not counts:
        return fit_trees({})
    budget = max(1, min(TRAIN_BYTES, TOTAL_BYTES // len(counts)))
    # about TRAIN_ROWS ids of each language, by hash
    rates = spark.createDataFrame([(r.lang, min(1.0, TRAIN_ROWS / r.n)) for r in counts], "lang string, rate double")
    hashed = known.select("id", "lang", F.octet_length("body").alias("size"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000).alias("place"))
    chosen = hashed.join(F.broadcast(rates), "lang").filter("place < rate and size > 0").orderBy("place", "id", "size").limit(2 * TRAIN_ROWS * len(counts)).select("id", "lang", "size").collect()
    missed = [r.lang for r in counts if r.lang not in {c.lang for c in chosen}]  # the hash took none of a rare language's
    if missed:
        first = hashed.filter(F.col("lang").isin(missed) & (F.col("size") > 0)).groupBy("lang").agg(F.min(F.struct("place", "id", "size")).alias("f"))
        chosen += first.select("f.id", "lang", "f.size").collect()
    used = dict.fromkeys((r.lang for r in counts), 0)
    parts: list[tuple[int, str, int]] = []
    for r in chosen:
        take = min(r.size, budget - used[r.lang])
        if take > 0:
            used[r.lang] += take
            parts.append((r.id, r.lang, take))
    wanted = spark.createDataFrame(parts, "id long, lang string, take int").groupBy("id", "lang").agg(F.max("take").alias("take"))
    sample = known.join(F.broadcast(wanted), ["id", "lang"]).select("id", "lang", F.expr("substring(body, 1, take)").alias("body"))
    texts: dict[str, list[bytes]] = {r.lang: [] for r in counts}
    used = dict.fromkeys(texts, 0)
    for r in sorted(sample.toLocalIterator(), key=lambda r: (r.id, bytes(r.body))):
        if used[r.lang] < budget:  # rows may share an id
            texts[r.lang].append(bytes(r.body)[: budget - used[r.lang]])
            used[r.lang] += len(texts[r.lang][-1])
    texts = {n: t for n, t in texts.items() if t}
    try:
        return with_limits(fit_trees(texts), texts)
    finally:
        trim()


def identify_language(docs: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trees: ContextTrees | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every whole text."""
    shared, call = _share(docs, trees or fit(docs, folds, held_out, id_col, text_col, lang_col))
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("text")).select("doc_id", F.col("text").cast("binary").alias("body"), F.col("text").rlike(r"\p{L}").alias("letters"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, per_byte = _predict(shared, call, batch.column(1).to_pylist(), batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(per_byte)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    found = map_arrow(rows, run, "doc_id long, lang_pred string, score double, bits_per_byte double")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return found.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def _share(docs: DataFrame, trees: ContextTrees):
    """The folded trees for the workers, of bounded size whatever the input."""
    if trees.bits.nbytes > max(TABLE_BYTES, 4 * trees.bits.shape[1] * 257):
        raise ValueError("the table of code lengths is larger than its bound")
    values = (trees.languages, trees.classes.astype(np.int32), trees.states, trees.bits, trees.limits)
    return docs.sparkSession.sparkContext.broadcast(values), uuid.uuid4().hex


def _predict(shared, call: str, bodies: list[bytes], letters: list[bool]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a byte of some whole texts, in a worker."""
    own = kept("language", call, lambda: ContextTrees(*shared.value))
    if not own.languages:
        return [UNKNOWN] * len(bodies), np.zeros(len(bodies)), np.zeros(len(bodies))
    names, score, bits = own.predict(bodies)
    known = np.array(letters, bool)
    return [n if ok else UNKNOWN for n, ok in zip(names, letters)], np.where(known, score, 0.0), bits / np.maximum([len(b) for b in bodies], 1)


def with_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, in a learned language with at least this score; no shuffle.

    The score only compares the learned languages, so a text must also code as short as theirs do.
    """
    shared, call = _share(docs, fit(docs))
    at = docs.columns.index("text")

    def known(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        bodies = [t.encode() for t in texts]
        names, score, _ = _predict(shared, call, bodies, [any(c.isalpha() for c in t) for t in texts])
        good = np.array([n != UNKNOWN and s >= least for n, s in zip(names, score)], bool)
        some = np.flatnonzero(good)
        if some.size:
            good[some] = kept("language", call, lambda: ContextTrees(*shared.value)).fits([bodies[i] for i in some])
        return batch.filter(pa.array(good))

    return map_arrow(docs, known, docs.schema)
