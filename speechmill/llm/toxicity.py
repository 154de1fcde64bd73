"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy over hashed character runs of words (4 and 5 characters, ends of words marked, so words of two
and three letters are whole) learns from confirmed toxic texts (positives) and unlabelled texts. Runs let inflected and compound
forms share a weight.
Its loss is the class-prior-corrected risk
    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])
with the logistic loss; when the second term goes below zero, the step climbs it back, as the published non-negative
estimator does. The prior is the positives' share among the labelled rows that may be learnt from.

Learning reads a bounded sample: at most MAX_POSITIVE and MAX_UNLABELLED texts, those with the smallest hash of
their id. Spark counts in how many texts of either kind each feature occurs; the MAX_FEATURES whose shares differ most for
their spread enter the fit. Scoring covers every whole text. Features are presences, so the weight of one toxic word doesn't
shrink with the length of the text.

Defined results: null text is empty; an empty text has the score of the bias alone; without positives, or with nothing unlabelled beside them, each
score is that of a bias of -60 (under 1e-26); repeated rows are
scored one by one; null labels are unlabelled; null doc_id counts as the empty string in the fold; other columns are not read; an
empty table gives an empty table. reject() goes row by row: null and empty texts and repeats are rows like others, and all columns stay.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, map_batches, pieces_of, stored, texts

DIMS = 1 << 20
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4_000, 12_000, 4_096
LEAST_Z, LEAST_TEXTS = 4.0, 3
STEPS, RATE = 300, 0.05
FOLDS = 5


@functools.lru_cache
def _letters() -> np.ndarray:
    """Of each code point whether it is a letter."""
    return np.array([chr(k).isalpha() for k in range(0x110000)])


def runs_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hashed run of each place of the texts where a run stands; repeats included."""
    joined = "".join(f" {x.lower()} " for x in batch)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(batch)), [len(x.lower()) + 2 for x in batch])
    letter = _letters()[chars]
    keep = letter | np.r_[True, letter[:-1]]  # one blank after each word
    chars, letter, owner = np.where(letter, chars, 0)[keep].astype(np.uint64), letter[keep], owner[keep]
    owners, slots = [], []
    for n in (4, 5):
        size = len(chars) - n + 1
        if size <= 0:
            continue
        inside = letter[1 : 1 + size].copy()
        for k in range(2, n - 1):
            inside &= letter[k : k + size]
        at = np.flatnonzero(inside)
        total = np.full(len(at), n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                total = (total + chars[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(29)
        owners.append(owner[at + 1])
        slots.append((total & np.uint64(DIMS - 1)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(slots)


def slots_of(batch: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of text number and wanted slot, by text. wanted: a flag for each slot."""
    owner, slot = runs_of(batch)
    use = wanted[slot]
    pairs = np.unique(owner[use] * DIMS + slot[use])
    return pairs // DIMS, pairs % DIMS


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, batch: list[str]) -> np.ndarray:
        owner, slot = slots_of(batch, self.weights != 0)
        sums = np.bincount(owner, weights=self.weights[slot], minlength=len(batch)) + self.bias
        return 1 / (1 + np.exp(-np.clip(sums, -60, 60)))


def _sums(weights: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=weights[flat], minlength=n)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS, rate: float = RATE, decay: float | None = None, dims: int = DIMS) -> Model:
    """Minimise the non-negative risk by Adam over the whole sample at each step; fewer positives, more decay of the weights."""
    if not positive:
        return Model(np.zeros(dims, np.float32), -60.0)
    prior = min(max(prior, 1e-4), 0.9)
    n_p, n_u = len(positive), max(1, len(unlabelled))
    decay = min(1e-2, 0.1 / n_p**0.5) if decay is None else decay
    rows = [*positive, *unlabelled]
    used, flat = np.unique(np.concatenate(rows).astype(np.int64), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    w, b = np.zeros(len(used)), np.log(prior / (1 - prior))
    is_p = np.arange(len(rows)) < n_p
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    softplus = lambda x: np.logaddexp(0, x)
    for t in range(1, steps + 1):
        z = _sums(w, flat, owner, len(rows)) + b
        p = sigmoid(z)
        negative = softplus(z[~is_p]).sum() / n_u - prior * softplus(z[is_p]).mean()
        g = np.empty(len(rows))
        if negative >= 0:
            g[is_p] = prior * (p[is_p] - 1) / n_p - prior * p[is_p] / n_p
            g[~is_p] = p[~is_p] / n_u
        else:  # climb back: only the negative part, upwards
            g[is_p] = prior * p[is_p] / n_p
            g[~is_p] = -p[~is_p] / n_u
        grad = np.append(np.bincount(flat, weights=g[owner], minlength=len(used)) + decay * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    weights = np.zeros(dims, np.float32)
    weights[used] = w
    return Model(weights, float(b))


def fold(doc_id="doc_id"):
    """crc32 of the id as text, modulo FOLDS; rows with 0 are held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learn from the rows that aren't held out. docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.where(F.col("toxic").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    if not total.n or not total.k:
        return fit([], [], 0.5)
    order = F.xxhash64("doc_id")
    wanted = known.where("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(max_positive)
    own = docs.select("doc_id", "text").where(fold() != 0)
    found = own.join(F.broadcast(wanted), "doc_id").withColumn("toxic", F.lit(1))  # at most max_positive rows of 8 bytes
    rest = own.join(F.broadcast(wanted), "doc_id", "left_anti").select("doc_id").orderBy(order, "doc_id").limit(max_unlabelled)
    rest = own.join(F.broadcast(rest), "doc_id").withColumn("toxic", F.lit(0))
    sample = stored(found.unionByName(rest).select("text", "toxic"), "toxicity-sample", compression="zstd")
    n_p = sample.where("toxic = 1").count()
    n_u = sample.where("toxic = 0").count()
    if not n_p or not n_u:
        return fit([], [], 0.5)

    def count(batches):
        every = alone(lambda: np.ones(DIMS, bool))
        totals = np.zeros((2, DIMS), np.int64)
        for b in batches:
            for part in pieces_of(b):
                owner, slot = slots_of(texts(part), every)
                y = np.array(part.column(1).to_pylist())[owner]
                for k in (0, 1):
                    totals[1 - k] += np.bincount(slot[y == k], minlength=DIMS)
        at = np.flatnonzero(totals.sum(0))
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(totals[0, part]), pa.array(totals[1, part])], ["slot", "p", "u"])

    counts = sample.mapInArrow(count, "slot long, p long, u long").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    p, u = F.col("p").cast("double"), F.col("u").cast("double")
    share = (p + u) / float(n_p + n_u)
    z = (p / n_p - u / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    best = counts.where(p + u >= LEAST_TEXTS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "slot").limit(MAX_FEATURES).select("slot").collect()
    chosen = np.sort(np.array([r.slot for r in best], np.int64))

    def make():
        wanted = np.zeros(DIMS, bool)
        wanted[chosen] = True

        def step(b):
            owner, slot = slots_of(texts(b), wanted)
            ends = np.cumsum(np.bincount(owner, minlength=b.num_rows))
            return {"toxic": b.column(1), "slots": np.split(slot, ends[:-1])}

        return step

    got = map_batches(sample, make, "toxic int, slots array<int>").toArrow()
    slots, toxic = [np.asarray(x.values, np.int64) for x in got["slots"]], got["toxic"].to_pylist()
    return fit([x for x, y in zip(slots, toxic, strict=True) if y], [x for x, y in zip(slots, toxic, strict=True) if not y], total.k / total.n)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row. The model sent to the tasks has a fixed size (DIMS floats)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def make():
        own = Model(*sent.value)

        def step(b):
            s = own.scores(texts(b))
            return {"doc_id": b.column(0), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return step

    scored = map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), make, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under the threshold, with their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index("text")

    def run(batches):
        own = alone(lambda: Model(*sent.value))
        for batch in batches:
            for b in pieces_of(batch):
                yield b.filter(pa.array(own.scores([x or "" for x in b.column(at).to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)
