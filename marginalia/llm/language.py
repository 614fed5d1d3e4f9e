"""Language of texts that may mix several: expectation-maximisation over n-gram likelihoods, sets by penalised likelihood.

Each language is a smoothed distribution over hashed character n-grams, learned from a bounded sample of labelled texts. A
document is a mixture: every n-gram comes from one of its languages, in unknown proportions. Expectation-maximisation
estimates the proportions for all languages; then languages are struck off, least share first, as long as the likelihood
lost is below the penalty of a free proportion. The proportions of the set that stays are the document's.

The model is a fixed number of buckets for each language; documents are read whole, inside the row, without a shuffle.

Defined results: null and letter-free texts are ``und`` with score 0 and no languages; so is every text when nothing was
learned; ties go to the first language by name; an empty table gives no rows; repeated rows repeat their result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.batches import keep_rows, over_rows
from marginalia.llm.letters import codes, gram_buckets


class Sample(NamedTuple):
    """Bounds of the fit: about so many documents of each language, of so many characters at most."""
    documents: int = 300
    longest: int = 20_000


GRAMS, BITS, SMOOTH, SEED = (1, 2, 3), 15, 0.5, 11
FOLDS, HELD_OUT = 4, 2
ROUNDS, CLOSE, UNKNOWN = 30, 1e-3, "und"


class Model(NamedTuple):
    languages: tuple[str, ...]
    likelihood: np.ndarray | None  # [bucket, language]


def profile(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of a text; empty without letters. N-grams of a gap alone don't count."""
    points = codes(text)
    if len(points) < 2:
        return np.zeros(0, np.int64)
    found = []
    for n in GRAMS:
        if len(points) >= n:
            buckets = gram_buckets(points, n, BITS)
            found.append(buckets[points[:len(buckets)] != 0] if n == 1 else buckets)
    return np.concatenate(found)


def learn(texts: list[str], langs: list[str]) -> Model:
    """Smoothed n-gram distributions of each language."""
    languages = tuple(sorted(set(langs)))
    if not languages:
        return Model((), None)
    counts = np.full((1 << BITS, len(languages)), SMOOTH)
    place = {lang: i for i, lang in enumerate(languages)}
    for text, lang in zip(texts, langs):
        counts[:, place[lang]] += np.bincount(profile(text), minlength=1 << BITS)
    return Model(languages, counts / counts.sum(0))


def _proportions(like: np.ndarray, weight: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the languages (columns of ``like``) and the log-likelihood, by expectation-maximisation."""
    share = start
    total = weight.sum()
    for _ in range(ROUNDS):
        mixed = like @ share
        following = share * (like.T @ (weight / mixed)) / total
        moved = np.abs(following - share).max()
        share = following
        if moved < CLOSE:
            break
    return share, float(weight @ np.log(like @ share))


def infer(model: Model, text: str | None) -> tuple[str, float, list[str], list[float]]:
    """Main language, its share, and the language set with its shares, largest first."""
    grams = profile(text) if model.languages else np.zeros(0, np.int64)
    if not len(grams):
        return UNKNOWN, 0.0, [], []
    weight = np.bincount(grams, minlength=1 << BITS)
    buckets = np.flatnonzero(weight)
    weight = weight[buckets] / len(GRAMS)  # the n-grams of one place are one observation
    like = model.likelihood[buckets]
    like = like / like.max(1, keepdims=True)
    chosen = np.arange(len(model.languages))
    share, fit = _proportions(like, weight, np.full(len(chosen), 1 / len(chosen)))
    penalty = 0.5 * np.log(max(weight.sum(), 2.0)) + 2.0
    while len(chosen) > 1:
        least = int(np.argmin(share))
        rest = np.delete(np.arange(len(chosen)), least)
        start = share[rest] + 1e-9
        fewer, fit_fewer = _proportions(like[:, chosen[rest]], weight, start / start.sum())
        if fit - fit_fewer > penalty:
            break
        chosen, share, fit = chosen[rest], fewer, fit_fewer
    order = np.lexsort((chosen, -share))
    names = [model.languages[chosen[i]] for i in order]
    return names[0], float(min(1.0, share[order[0]])), names, [float(share[i]) for i in order]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from the fit."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, sample: Sample = Sample()) -> Model:
    """Learns from a bounded sample, chosen by a hash of the id, of rows with a language that are not held out."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id")) & F.length("text").between(1, sample.longest))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return learn([], [])
    # a share of each language that gives half as many again as wanted, so the numbering sees few rows
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for lang, n in counts.items()
                                                   for v in (lang, min(1.0, 1.5 * sample.documents / n + 20 / n))]),
                                    F.col("lang")), F.lit(0.0))
    spot = F.xxhash64(F.lit(SEED), "doc_id")
    near = known.withColumn("spot", spot).where(F.pmod("spot", F.lit(1 << 20)) < share * (1 << 20))
    near = near.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("spot", "doc_id", "text")))
    rows = near.where(F.col("i") <= sample.documents).select("text", "lang").collect()
    return learn([r["text"] for r in rows], [r["lang"] for r in rows])


def reliable(lang: str, share: float, least: float = 0.45) -> bool:
    """Whether a text has a known language that makes up enough of it."""
    return lang != UNKNOWN and share >= least


def keep_reliable(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known and prevails in them."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def work():
        known = model.value
        return lambda text: (reliable(*infer(known, text)[:2]),)

    return keep_rows(docs, ["text"], work)


def identify(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, langs, shares) for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def work():
        known = model.value
        return lambda text: infer(known, text)

    told = over_rows(docs, ["doc_id"], ["text"], "lang_pred string, score double, langs array<string>, shares array<double>", work)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs", "shares")
