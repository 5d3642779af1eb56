"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples (positives) and unlabelled text train a linear classifier on hashed text features with numpy. The
risk is the class-prior-corrected one: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss. Where a
batch's corrected negative part falls below zero, the step goes against its gradient instead, so that the classifier can't
push the estimate below what is possible. Several classifiers start from different orders of the sample, and their
margins are averaged. The bias of the average is the cut of least risk by the same estimator, with errors counted instead
of the logistic loss; of cuts of equal risk, the one in the widest gap between margins.

Features are a text's distinct words (ASCII letters in lower case) and their prefixes of 4 and 5 bytes, hashed to 2**18
weights. Features of a text count once, however long it is, and a weight is shrunk towards zero, so what carries no sign
of either class adds nothing.

Training takes a bounded sample of rows: ``POSITIVES`` toxic ones and ``UNLABELLED`` of any kind, those with the lowest
hash of their id. The class prior is counted over all labelled rows that may be used. Only the sample's hashed features
reach the driver. Scores are computed for all rows, over whole texts.

Defined cases: null counts as empty; wordless texts are scored by the bias alone; repeated rows get the same score; rows
with a null id or label are no examples, and a null id isn't held out; a document with several labels is toxic if one says
so; where no feature tells the classes apart, every score is the prior, at most just under one half, so that nothing counts
as toxic; without positives or without unlabelled text, every score is 0; an empty table gives an empty one; texts of any length
are read whole; columns of the input other than id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import row_slices, text_buffer

BITS = 18
PREFIXES = (4, 5)
POSITIVES, UNLABELLED = 3000, 9000
EPOCHS, BATCH, MODELS, RATE, SHRINK = 12, 128, 3, 0.02, 2e-4
#: Used where the labels hold no negative rows to count a prior from.
PRIOR = 0.1
#: Features that tell the classes apart by less than this many standard errors on the sample stay out.
LEAST_Z = 4.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LETTER = np.random.default_rng(5).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def features(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs in order."""
    word = _WORD[buffer]
    edge = np.zeros(len(buffer) + 1, bool)
    edge[offsets] = True
    begins = word & (np.append(True, ~word[:-1]) | edge[:-1]) if len(buffer) else word
    ends = word & (np.append(~word[1:], True) | edge[1:]) if len(buffer) else word
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, a, side="right") - 1
    low = _LETTER[_LOWER[buffer]]
    found = []
    for size in (*PREFIXES, None):
        # Horner's rule over the words' first bytes; whole words go on as long as any has bytes left
        pick = np.arange(len(a)) if size is None else np.flatnonzero(b - a >= size)
        at, stop, h = a[pick], b[pick] if size is None else a[pick] + size, np.full(len(pick), size or 0, np.uint64)
        live = np.arange(len(pick))
        while len(live):
            h[live] = h[live] * _BASE + low[at[live]]
            at[live] += 1
            live = live[at[live] < stop[live]]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        found.append((row[pick].astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def margins(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    parts = []
    for low, high in row_slices(column):
        row, feature = features(*text_buffer(column.slice(low, high - low)))
        parts.append(np.bincount(row, weights[feature], high - low) + bias)
    return np.concatenate(parts) if parts else np.zeros(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Whether each feature's share of positives differs from that of unlabelled text by ``LEAST_Z`` standard errors."""
    size = 1 << BITS
    p, u = (np.bincount(np.concatenate(x), minlength=size) for x in (positive, unlabelled))
    n, k = len(positive), len(unlabelled)
    share = (p + u + 1) / (n + k + 2)
    return np.abs(p / n - u / k) >= LEAST_Z * np.sqrt(share * (1 - share) * (1 / n + 1 / k))


def fitted(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier, by Adam on the non-negative risk. Examples: arrays of distinct features."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    steps = max(1, -(-len(unlabelled) // BATCH))
    share = max(16, BATCH // 2)
    t = 0

    def batch(rows: list[np.ndarray], pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = [rows[i] for i in pick]
        flat = np.concatenate(some) if some else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(some)), [len(x) for x in some])
        return flat, row, np.bincount(row, w[flat], len(some)) + w[-1]

    def gradient(flat: np.ndarray, row: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(flat, slope[row], size + 1)
        g[-1] = slope.sum()
        return g

    for _ in range(EPOCHS):
        order = rng.permutation(len(unlabelled))
        for k in range(steps):
            u_flat, u_row, u_at = batch(unlabelled, order[k * BATCH : (k + 1) * BATCH])
            p_flat, p_row, p_at = batch(positive, rng.integers(0, len(positive), share))
            nu, np_ = len(u_at), len(p_at)
            negative = np.logaddexp(0, u_at).mean() - prior * np.logaddexp(0, p_at).mean()
            # slopes of the logistic loss: -(1 - s) for a positive, s for a negative
            part = gradient(u_flat, u_row, sigmoid(u_at) / nu) - gradient(p_flat, p_row, prior * sigmoid(p_at) / np_)
            up = gradient(p_flat, p_row, -prior * (1 - sigmoid(p_at)) / np_)
            g = up + part if negative >= 0 else -part
            t += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - SHRINK, 0)
    return w[:-1], float(w[-1])


class Model:
    """Weights and bias of a linear classifier."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def trained(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model | None:
    """The averaged classifier, or None without examples of both kinds."""
    if not positive or len(unlabelled) < 2 or not 0 < prior < 1:
        return None
    use = telling(positive, unlabelled)
    positive, unlabelled = ([x[use[x]] for x in rows] for rows in (positive, unlabelled))
    models = [fitted(positive, unlabelled, prior, seed) for seed in range(MODELS)]
    weights = np.mean([w for w, _ in models], axis=0)
    p, u = (np.array([weights[x].sum() for x in rows]) for rows in (positive, unlabelled))
    cut = least_risk(p, u, prior)
    if cut is None:
        return Model(np.zeros_like(weights), float(np.log(min(prior, 0.499) / (1 - min(prior, 0.499)))))
    return Model(weights, -cut)


def least_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float | None:
    """The margin from which on text counts as toxic at the least non-negative risk; None if all margins are equal."""
    levels = np.unique(np.concatenate([positive, unlabelled]))
    if len(levels) < 2:
        return None
    cuts = (levels[1:] + levels[:-1]) / 2
    caught = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    marked = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    risk = prior * (1 - caught) + np.maximum(0, marked - prior * caught)
    best = np.flatnonzero(risk <= risk.min() + 1e-9)
    return float(cuts[best[np.argmax(np.diff(levels)[best])]])


def held_out(key: Column) -> Column:
    """The fifth of the ids that nothing is learnt from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(5)) == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Fits the classifier on a bounded sample of the rows whose id is ``usable`` (all if not given)."""
    usable = F.lit(True) if usable is None else usable
    texts = documents.where(F.col(key).isNotNull()).where(usable).select(F.col(key), F.col(text))
    marked = labels.select(F.col(key), F.col(label).alias("mark")).dropna().where(usable).groupBy(key).agg(F.max("mark").alias("mark"))
    n, toxic = marked.agg(F.count("*"), F.count_if(F.col("mark") == 1)).first()
    prior = PRIOR if n == toxic else toxic / n
    order = [F.xxhash64(key), F.col(key)]
    chosen = marked.where("mark = 1").join(texts.select(key).distinct(), key, "left_semi").select(key).orderBy(*order).limit(positives)
    others = texts.select(key).distinct().orderBy(*order).limit(unlabelled)
    ids = chosen.withColumn("kind", F.lit(1)).unionByName(others.withColumn("kind", F.lit(0)))
    ids = ids.groupBy(key).agg((F.max("kind") == 1).alias("p"), (F.min("kind") == 0).alias("u"))
    sample = texts.join(F.broadcast(ids), key).select("p", "u", F.col(text).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in row_slices(batch.column(2)):
                part = batch.slice(low, high - low)
                row, feature = features(*text_buffer(part.column(2)))
                edges = np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["p", "u", "features"])

    found = sample.mapInArrow(extract, "p boolean, u boolean, features array<int>").toArrow()
    rows = [x.values.to_numpy().astype(np.int64) for x in found["features"]]
    p, u = found["p"].to_pylist(), found["u"].to_pylist()
    order = sorted(range(len(rows)), key=lambda i: rows[i].tobytes())  # whatever order the rows came in
    return trained([rows[i] for i in order if p[i]], [rows[i] for i in order if u[i]], prior)


def toxicity(text: Column, model: Model | None, session) -> Column:
    """Column of scores of whole texts: 0 to 1, higher the likelier toxic."""
    if model is None:
        return F.lit(0.0)
    shared = session.sparkContext.broadcast((model.weights, model.bias))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = shared.value
        for column in batches:
            yield pa.array(sigmoid(margins(column, weights, bias)))

    return score(text)


def toxicity_digest(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: whether its label was held out, score, and prediction."""
    model = train(documents, labels, key, text, usable=~held_out(F.col(key)))
    score = toxicity(F.col(text), model, documents.sparkSession)
    rows = documents.select(F.col(key), held_out(F.col(key)).alias("held_out"), score.alias("score"))
    return rows.select(key, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
