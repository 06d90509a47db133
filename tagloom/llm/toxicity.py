"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades 0 to K - 1 share one weight vector; each step between grades has a threshold of its own, in order:
``P(grade > k) = sigmoid(weights . features - threshold_k)``.  The score is the expected severity, the sum of these.
Features are words and their stems, worth the log ratio of their smoothed shares in toxic and harmless examples.  The fit minimises the regularised likelihood by L-BFGS; each step is one distributed pass over the sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .features import DIM, class_counts, examples, feature_sums, kept, labelled_sample, scored, shared, words_and_stems

#: Labelled documents the fit may use, steps at most, and the weight penalty.
SAMPLE, STEPS, PENALTY = 20_000, 30, 1.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def severity_of(sample: DataFrame, total: np.ndarray, kinds: list[int], grades: int) -> dict:
    """Grade of every toxic example: how many of the features that mark toxic texts it holds, cut at quantiles.

    Labels say only whether a text is toxic; its severity is how many distinct marking features it has.  A feature marks
    toxic texts if its smoothed share there is ten times that elsewhere.
    """
    marking = (total[1] + 1) / (kinds[1] + 2) >= 10 * (total[0] + 1) / (kinds[0] + 2)
    marking &= total[1] >= max(3, 0.005 * kinds[1])

    def run(batches):
        for batch in batches:
            hits = [int(marking[x].sum()) for x in examples(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hits, pa.int64())], names=["doc_id", "hits"])

    id_type = sample.schema["doc_id"].dataType.simpleString()
    found = sample.filter("label > 0").mapInArrow(run, f"doc_id {id_type}, hits long").toPandas()
    cuts = np.quantile(found["hits"], np.arange(1, grades - 1) / (grades - 1)) if len(found) and grades > 2 else np.zeros(0)
    return dict(zip(found["doc_id"], (1 + np.searchsorted(cuts, found["hits"], side="left")).tolist(), strict=True))


def fit(sample: DataFrame, grade_of: dict, grades: int, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) for features worth ``scale``.  Without examples the weights are 0."""
    steps = grades - 1

    def thresholds(free: np.ndarray) -> np.ndarray:
        """First threshold and positive gaps: always in order."""
        return np.cumsum(np.concatenate([free[:1], np.exp(np.clip(free[1:], -30, 30))]))

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        weights, cut = at[:DIM], thresholds(at[DIM:])

        def add(out, batches):
            weights = sent.value
            slope, dcut, total = out[:DIM], out[DIM : DIM + steps], out[DIM + steps :]
            for batch in batches:
                rows = zip(examples(batch), batch.column("label").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)
                for x, y, i in rows:
                    grade = grade_of.get(i, 1) if y > 0 else 0
                    above = _sigmoid(float(weights[x].sum()) - cut)
                    upper = above[grade - 1] if grade else 1.0
                    lower = above[grade] if grade < steps else 0.0
                    p = max(upper - lower, 1e-12)
                    du, dl = (upper * (1 - upper) if grade else 0.0), (lower * (1 - lower) if grade < steps else 0.0)
                    total -= np.log(p)
                    slope[x] -= (du - dl) / p
                    if grade:
                        dcut[grade - 1] += du / p
                    if grade < steps:
                        dcut[grade] -= dl / p

        with shared(sample, (weights * scale).astype(np.float32)) as sent:
            found = feature_sums(sample, add, DIM, steps + 1)
        total = float(found[-1]) + PENALTY / 2 * float(weights @ weights)
        slope, dcut = found[:DIM] * scale + PENALTY * weights, found[DIM:-1]
        dfree = np.cumsum(dcut[::-1])[::-1].copy()
        dfree[1:] *= np.exp(np.clip(at[DIM + 1 :], -30, 30))
        return total, np.concatenate([slope, dfree])

    at = np.zeros(DIM + steps)
    value, slope = loss(at)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    first = 1 / max(1.0, float(np.linalg.norm(slope)))
    for _ in range(STEPS):
        move, coefficients = slope.copy(), []
        for s, y in reversed(history):
            a = (s @ move) / (s @ y)
            coefficients.append(a)
            move -= a * y
        move *= (history[-1][0] @ history[-1][1]) / (history[-1][1] @ history[-1][1]) if history else first
        for (s, y), a in zip(history, reversed(coefficients), strict=True):
            move += (a - (y @ move) / (s @ y)) * s
        rate, gain = 1.0, float(slope @ move)
        while True:
            new = at - rate * move
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * rate * gain or rate < 1e-4:
                break
            rate /= 4
        s, y = new - at, new_slope - slope
        if s @ y > 1e-10:
            history = [*history[-7:], (s, y)]
        done = value - new_value <= 1e-3 * abs(value)
        at, value, slope = new, new_value, new_slope
        if done:
            break
    return at[:DIM] * scale, thresholds(at[DIM:])


def model(docs: DataFrame, labels: DataFrame, grades: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the features, thresholds)."""
    sample = labelled_sample(docs, labels, "toxic", F.lit(True), most, words_and_stems)
    total, kinds = class_counts(sample)
    scale = np.abs(np.log((total[1] + 0.5) / (kinds[1] + 1)) - np.log((total[0] + 0.5) / (kinds[0] + 1)))
    weights, cut = fit(sample, severity_of(sample, total, kinds, grades), grades, scale)
    return weights.astype(np.float32), cut


def toxicity(docs: DataFrame, labels: DataFrame, grades: int = 3, reject: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """``(doc_id, severity, p_toxic, grade, predicted)`` of every row of ``docs(doc_id, text)``.

    ``labels(doc_id, toxic)`` are learnt from at most ``most`` documents.  ``severity`` is the expected grade, 0 to
    ``grades - 1``; ``predicted`` is 1 if the text is toxic at all with probability ``reject`` or more.  Null and empty
    texts have no features and score what the thresholds alone say.  Repeated rows score alike; rows without id are
    scored.  Without labels every text gets the same score.  Other columns are ignored.
    """
    weights, cut = model(docs, labels, grades, most)

    def score(sums: np.ndarray) -> dict[str, np.ndarray]:
        above = _sigmoid(sums[:, None] - cut[None, :])
        return {"severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": (above >= 0.5).sum(axis=1).astype(np.int32), "predicted": (above[:, 0] >= reject).astype(np.int32)}

    return scored(docs, words_and_stems, score, weights, "severity double, p_toxic double, grade int, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, grades: int = 3, reject: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that ``toxicity`` predicts as toxic; all columns stay."""
    weights, cut = model(docs, labels, grades, most)
    return kept(docs, words_and_stems, lambda sums: _sigmoid(sums - cut[0]) < reject, weights)
