"""Toxicity scores from subword bags: character n-gram embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams, its ends marked, so a misspelling shares most vectors with
the word it hides. A passage is the mean of its words; the softmax scores passages, and a document has the score of its
worst passage, so a few words count as much in a long text as in a short one. Training follows this: each step takes the
worst passage of each document under the present model and moves softmax and embeddings together.

The fit sees a bounded sample of labelled rows (``Sample``) in one task. The layer after the average being linear, the
model that tasks get is one number per n-gram bucket, of fixed size. Scoring is inside the row, over the whole text.

Defined results: null, empty and letter-free texts have the score of an empty passage; ids repeated in the labels count as
toxic if any is; a fit without both labels gives every document the share of toxic labels (0 without any); an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.batches import keep_rows, over_rows
from marginalia.llm.letters import codes, gram_buckets


class Sample(NamedTuple):
    """Bounds of the fit: documents of each label and characters of each document."""
    toxic: int = 1500
    clean: int = 3000
    longest: int = 20_000


GRAMS, BITS, WIDTH, PASSAGE = (3, 4, 5), 17, 8, 4
FOLDS, HELD_OUT = 5, 0
EPOCHS, BATCH, RATE, SEED = 30, 256, 0.5, 7


class Model(NamedTuple):
    """Score of a passage's n-gram buckets before the bias, and the bias; without both labels only a prior."""
    scores: np.ndarray | None
    bias: float
    prior: float


def _grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word of every n-gram inside the words of a code array; a word's ends count as characters."""
    letter = points != 0
    word = np.cumsum(~letter) - 1  # the word that holds a letter
    buckets, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in GRAMS:
        count = len(points) - n + 1
        if count <= 0:
            continue
        inner = letter[1:1 + count].copy()
        for j in range(2, n - 1):
            inner &= letter[j:j + count]
        at = np.flatnonzero(inner)
        buckets.append(gram_buckets(points, n, BITS)[at])
        owners.append(word[at + 1])
    return np.concatenate(buckets), np.concatenate(owners)


def _word_means(points: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Mean of ``values`` over the n-grams of each word of a code array."""
    buckets, owners = _grams(points)
    words = np.count_nonzero(points == 0) - 1
    return np.bincount(owners, values[buckets], words) / np.maximum(np.bincount(owners, minlength=words), 1)


def worst_passage(word_scores: np.ndarray) -> tuple[float, int]:
    """The highest mean over ``PASSAGE`` words in a row (all words, if fewer) and where it starts."""
    if not len(word_scores):
        return 0.0, 0
    width = min(PASSAGE, len(word_scores))
    sums = np.concatenate(([0.0], np.cumsum(word_scores)))
    means = (sums[width:] - sums[:-width]) / width
    at = int(np.argmax(means))
    return float(means[at]), at


def score(model: Model, text: str | None) -> float:
    if model.scores is None:
        return model.prior
    logit, _ = worst_passage(_word_means(codes(text), model.scores))
    return float(1 / (1 + np.exp(-np.clip(logit + model.bias, -30, 30))))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Trains embeddings and softmax together on whole texts."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(None, 0.0, float(y.mean()) if len(y) else 0.0)
    ids: dict[bytes, int] = {}
    docs = []
    for text in texts:
        points = codes(text)
        gaps = np.flatnonzero(points == 0)
        docs.append(np.array([ids.setdefault(points[a + 1:b].tobytes(), len(ids)) for a, b in zip(gaps, gaps[1:])], np.int64))
    if not ids:
        return Model(None, 0.0, float(y.mean()))
    end = np.zeros(1, np.uint32).tobytes()
    flat, owners = _grams(np.frombuffer(end + end.join(ids) + end, np.uint32))
    flat = flat[np.argsort(owners, kind="stable")]
    lengths = np.bincount(owners, minlength=len(ids))  # every word has the n-gram of its first letter
    starts = np.concatenate(([0], np.cumsum(lengths)))
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 1 / WIDTH, (1 << BITS, WIDTH))
    out, bias = rng.normal(0, 0.3, WIDTH), 0.0  # difference of the two softmax rows
    table_sq, out_sq, bias_sq = np.full(1 << BITS, 1e-4), np.full(WIDTH, 1e-4), 1e-4
    rows = np.flatnonzero([len(d) > 0 for d in docs])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(EPOCHS):
        per_word = np.add.reduceat((table @ out)[flat], starts[:-1]) / lengths
        passages = {}
        for i in rows:
            _, at = worst_passage(per_word[docs[i]])
            passages[i] = docs[i][at:at + PASSAGE]
        rng.shuffle(rows)
        for batch in np.array_split(rows, max(1, len(rows) // BATCH)):
            # gradient of the logistic loss of those passages, one update of all touched rows
            grams = [np.concatenate([flat[starts[w]:starts[w + 1]] for w in passages[i]]) for i in batch]
            share = [np.concatenate([np.full(lengths[w], 1 / (lengths[w] * len(passages[i]))) for w in passages[i]]) for i in batch]
            owner = np.repeat(np.arange(len(batch)), list(map(len, grams)))
            grams, share = np.concatenate(grams), np.concatenate(share)
            mean = np.zeros((len(batch), WIDTH))
            np.add.at(mean, owner, table[grams] * share[:, None])
            error = (1 / (1 + np.exp(-np.clip(mean @ out + bias, -30, 30))) - y[batch]) * weight[batch]
            touched, place = np.unique(grams, return_inverse=True)
            push = np.bincount(place, error[owner] * share)
            grad_out, grad_bias = mean.T @ error / len(batch), error.mean()
            grad = push[:, None] * out[None, :]
            table_sq[touched] += (grad ** 2).mean(1)
            table[touched] -= RATE * grad / np.sqrt(table_sq[touched])[:, None]
            out_sq += grad_out ** 2
            out -= 0.1 * RATE * grad_out / np.sqrt(out_sq)
            bias_sq += grad_bias ** 2
            bias -= 0.1 * RATE * grad_bias / np.sqrt(bias_sq)
    return Model(table @ out, float(bias), float(y.mean()))


def held_out(doc_id) -> F.Column:
    """Whether the label of a row is kept from the fit."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    """Fits on a bounded sample, chosen by a hash of the id, of the labelled rows that are not held out."""
    named = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id") \
        .agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    spot = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = None
    for value, most in ((1, sample.toxic), (0, sample.clean)):
        part = named.where(F.col("toxic") == value).orderBy(spot, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    known = docs.select("doc_id", "text").where(F.length("text") <= sample.longest).join(F.broadcast(chosen), "doc_id")
    rows = known.orderBy(spot, "doc_id", "text").limit(2 * (sample.toxic + sample.clean)).select("text", "toxic")
    told = rows.coalesce(1).mapInArrow(_fit_batches, "scores binary, bias double, prior double").first()
    if told is None:  # no task at all, as no label is there
        return fit([], [])
    return Model(None if told["scores"] is None else np.frombuffer(told["scores"]), told["bias"], told["prior"])


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fits on all batches of the one task that holds the sample."""
    texts: list[str] = []
    labels: list[int] = []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("toxic").to_pylist()
    model = fit(texts, labels)
    yield pa.RecordBatch.from_arrays(
        [pa.array([None if model.scores is None else model.scores.tobytes()], pa.binary()), pa.array([model.bias]),
         pa.array([model.prior])], names=["scores", "bias", "prior"])


def toxicity(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def work():
        known = model.value

        def told(text: str | None) -> tuple[float, int]:
            value = score(known, text)
            return value, int(value >= 0.5)
        return told

    scored = over_rows(docs, ["doc_id"], ["text"], "score double, predicted int", work)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def work():
        known = model.value
        return lambda text: (score(known, text) < 0.5,)

    return keep_rows(docs, ["text"], work)
