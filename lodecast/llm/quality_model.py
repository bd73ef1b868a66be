"""Quality classifier: positive-unlabelled learning with a non-negative risk.

Trusted positives are a bounded sample of the documents labelled good; unlabelled
ones are all documents outside the held-out fold, whatever they are. The share of
good documents among the unlabelled (the class prior) is estimated from the top of
a first classifier's scores, where hardly a bad document lies; then a linear model
over expanded text rates minimises

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])

with the logistic loss. Where the second part goes below zero, its gradient is
followed upwards, as it then only fits the sample. Labels of bad documents are
never learnt from.

The rates of all documents are written once. A sample of unlabelled ones gives a
starting point; the prior and the risk itself are then taken over all of them, by
aggregates of one number for each coefficient, in a few Newton steps. For a
linear model and the logistic loss the risk is convex as long as its second part
is not negative, so the steps lead to its only minimum, or stop where that part
would become negative.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecast.llm.files import written

#: Labelled good rows to learn from at most, about; also the unlabelled rows of the starting point.
SAMPLE_ROWS = 20_000
#: Passes over all unlabelled rows at most, and the fall of the risk that ends them.
PASSES, ENOUGH = 12, 1e-9
#: Steps and step size of the optimiser, and its penalty on squared weights: a fixed part, and one over the number of positives.
STEPS, RATE, PENALTY, PRIOR_WEIGHT = 800, 0.05, 1e-4, 1.0
#: A score of this or more predicts a good document.
CUTOFF = 0.7
#: A filter keeps scores of this or more: it drops what is likelier bad than good. By cross-validation on the three folds that
#: are learnt from (train without one fold's labels, count on it), good documents lost and bad ones kept: with 399 labels
#: 1 and 3 at 0.4, 2 and 3 at 0.5, 3 and 1 at 0.6, 11 and 0 at 0.7 (of 266 and 39); with 3980 labels 0 and 9, 3 and 4, 4 and 4,
#: 6 and 2 (of 2555 and 435). 0.5 and 0.6 have the fewest errors together; the lower one keeps more good documents.
KEPT_FROM = 0.5

RATES = ("symbols", "pipes", "capitals", "marks", "digits", "stops", "repeats", "dup_lines", "word_length", "size")


def _held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def rates(frame: DataFrame, text: str = "_text", out: str = "_x") -> DataFrame:
    """``frame`` with the rates of its column ``text``, each from 0 to 1, as the array column ``out``."""
    split = frame.select(
        "*",
        F.expr(rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w != '')").alias("_words"),
        F.expr(rf"filter(split({text}, '\n'), l -> l != '')").alias("_lines"),
    )
    chars = F.greatest(F.char_length(text), F.lit(1))
    words = F.greatest(F.size("_words"), F.lit(1))

    def share(pattern: str) -> Column:
        return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))) / chars

    values = {
        "symbols": share(r"[#*$%&<>^~_=\\]+"),
        "pipes": share(r"[|]+"),
        "capitals": share(r"\p{Lu}+"),
        "marks": share(r"[!?]+"),
        "digits": share(r"[0-9]+"),
        "stops": share(r"[.,;:]+"),
        "repeats": 1 - F.size(F.array_distinct("_words")) / words,
        "dup_lines": 1 - F.greatest(F.size(F.array_distinct("_lines")), F.lit(1)) / F.greatest(F.size("_lines"), F.lit(1)),
        "word_length": F.least(F.char_length(F.array_join("_words", "")) / words / 20, F.lit(1.0)),
        "size": F.least(F.log10(words.cast("double")) / 6, F.lit(1.0)),
    }
    return split.withColumn(out, F.array(*(values[r].cast("double") for r in RATES))).drop("_words", "_lines")


#: Upper ends of ramps that each rate is expanded into.
RAMPS = (0.01, 0.03, 0.1, 0.3, 1.0)


def _expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.minimum(x, r) / r for r in RAMPS], axis=1)


@dataclass
class PuModel:
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return _expand(x) @ self.weights + self.bias

    def score(self, column: Column) -> Column:
        """The probability of being good, as a DataFrame expression over the rates."""
        total = F.lit(float(self.bias))
        n = len(RATES)
        for r, ramp in enumerate(RAMPS):
            for i in range(n):
                total = total + F.least(column[i], F.lit(ramp)) * F.lit(float(self.weights[r * n + i] / ramp))
        return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(500.0)), F.lit(-500.0))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _descend(gradient, size: int) -> np.ndarray:
    """Adam on a full-batch gradient, from zero."""
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([_expand(x), np.ones((len(x), 1))], axis=1)


def _penalty(positive: np.ndarray) -> float:
    return PENALTY + PRIOR_WEIGHT / len(positive)


def contrast(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Coefficients, the bias last, of a classifier that tells positives from unlabelled rows."""
    a, b = _with_one(positive), _with_one(unlabelled)

    def gradient(t: np.ndarray) -> np.ndarray:
        return -(a * _sigmoid(-(a @ t))[:, None]).mean(0) + (b * _sigmoid(b @ t)[:, None]).mean(0) + _penalty(a) * t

    return _descend(gradient, a.shape[1])


def prior_from_tails(own: np.ndarray, above: Callable[[np.ndarray], np.ndarray], n: int) -> float:
    """The share of positives among ``n`` unlabelled rows: the least ratio of upper tails, each with its sampling error.

    ``own`` are the positives' margins; ``above`` gives the number of unlabelled rows at each cut or beyond.
    """
    own = np.sort(own)
    cuts = np.quantile(own, np.linspace(0, 0.9, 91))
    p = 1 - np.searchsorted(own, cuts) / len(own)
    q = above(cuts) / n
    error = np.sqrt(1 / len(own)) + np.sqrt(1 / n)
    best = int(np.argmin((q + error) / p))
    return float(np.clip(q[best] / p[best], 0.05, 0.98))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior of rows in memory."""
    t = contrast(positive, unlabelled)
    other = np.sort(_with_one(unlabelled) @ t)
    return prior_from_tails(_with_one(positive) @ t, lambda cuts: len(other) - np.searchsorted(other, cuts), len(other))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> PuModel:
    """The model for samples of rates; without positives or unlabelled rows, one that scores all alike."""
    size = len(RATES) * len(RAMPS)
    if len(positive) == 0 or len(unlabelled) == 0:
        return PuModel(np.zeros(size), 0.0, 0.5)
    prior = estimate_prior(positive, unlabelled) if prior is None else prior
    a, b = _with_one(positive), _with_one(unlabelled)

    def gradient(t: np.ndarray) -> np.ndarray:
        za, zb = a @ t, b @ t
        gain = -prior * (a * _sigmoid(-za)[:, None]).mean(0)
        rest = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
        slope = (b * _sigmoid(zb)[:, None]).mean(0) - prior * (a * _sigmoid(za)[:, None]).mean(0)
        return (gain + slope if rest >= 0 else -slope) + _penalty(a) * t

    t = _descend(gradient, size + 1)
    return PuModel(t[:-1], float(t[-1]), prior)


def _totals(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part``, a vector of ``size`` numbers for an array of rates, over all rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(np.asarray(batch.column("_x").flatten()).reshape(-1, len(RATES)))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["at", "value"])

    found = np.zeros(size)
    # `size` rows, whatever the input.
    for at, value in rows.select("_x").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value")).collect():
        found[at] = value
    return found


def minimise_over_all(model: PuModel, positive: np.ndarray, unlabelled: DataFrame, n: int) -> PuModel:
    """``model`` moved to the least risk over all ``n`` unlabelled rows, by Newton steps that are halved where the risk does not fall.

    Steps stop where the part of the risk that must not be negative would be.
    """
    a = _with_one(positive)
    size, penalty, prior = a.shape[1], _penalty(a), model.prior

    def sums(theta: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            b = _with_one(x)
            z = b @ theta
            s = _sigmoid(z)
            return np.concatenate([[np.logaddexp(0, z).sum()], b.T @ s, (b.T @ (b * (s * (1 - s))[:, None])).ravel()])

        return _totals(unlabelled, part, 1 + size + size * size) / n

    theta = np.append(model.weights, model.bias)
    kept, least = theta, np.inf
    for _ in range(PASSES):
        found = sums(theta)
        z = a @ theta
        rest = found[0] - prior * np.logaddexp(0, z).mean()
        risk = prior * np.logaddexp(0, -z).mean() + max(0.0, rest) + penalty / 2 * theta @ theta
        if least < np.inf and (rest < 0 or risk > least):
            theta = (theta + kept) / 2
            continue
        fall, kept, least = least - risk, theta, risk
        if rest < 0 or fall < ENOUGH:
            break
        gradient = found[1 : 1 + size] - prior * a.mean(0) + penalty * theta
        theta = theta - np.linalg.solve(found[1 + size :].reshape(size, size) + penalty * np.eye(size), gradient)
    return PuModel(kept[:-1], float(kept[-1]), prior)


def _picked(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """Rates of about ``most`` of ``n`` rows, never more than twice as many, chosen by a hash of the id; all if there are no more."""
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return np.array([r["_x"] for r in rows.select("_x").limit(2 * most).collect()], float).reshape(-1, len(RATES))


def rated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _x`` of all rows, written once: what training and scoring read instead of the texts."""
    return written(rates(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))).select("_id", "_x"), "text-rates")


def train(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> PuModel:
    """Fits on rows of ``rated`` outside the held-out fold: about ``sample_rows`` trusted ones and all as unlabelled.

    Null labels and ids are left out; a document with several labels counts as
    good only if all are 1.
    """
    own = found.where(F.col("_id").isNotNull() & ~_held_out(F.col("_id")))
    good = labels.groupBy(F.col(id_col).alias("_key")).agg(F.min(label_col).alias("_label")).where("_label = 1")
    trusted = own.join(good, F.col("_id") == F.col("_key"), "left_semi")
    n = own.count()
    positive = _picked(trusted, trusted.count(), sample_rows)
    if len(positive) == 0:
        return fit(positive, positive)
    start = _picked(own, n, sample_rows)
    t = contrast(positive, start)

    def above(cuts: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            margins = np.sort(_with_one(x) @ t)
            return (len(margins) - np.searchsorted(margins, cuts)).astype(float)

        return _totals(own, part, len(cuts))

    prior = prior_from_tails(_with_one(positive) @ t, above, n)
    return minimise_over_all(fit(positive, start, prior), positive, own, n)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` for every row of ``docs``.

    Null texts count as empty and get a score; rows with a null id are scored
    but not learnt from; repeated rows are kept as they come; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    found = rated(docs, id_col, text_col)
    model = train(found, labels, id_col, "quality", sample_rows)
    scored = found.select(F.col("_id").alias(id_col), _held_out(F.col("_id")).alias("held_out"), model.score(F.col("_x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = KEPT_FROM, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that score ``cutoff`` or more, all columns as they are, whatever their names.

    Rows are judged where they lie, so ids may be null or repeated.
    """
    model = train(rated(docs, id_col, text_col), labels, id_col, "quality", sample_rows)
    found = rates(docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")))
    return found.where(model.score(F.col("_x")) >= cutoff).select("_row.*")
