"""Quality classifier: naive Bayes support vectors.

n-gram indicators are scaled by the log ratio of their smoothed class counts; a linear hinge-loss model is fitted to
them by dual coordinate descent.  Each task runs the descent on the dual variables of its examples against the common
weights, and the tasks' changes are averaged before the next round, so none has to see another's examples.  A
logistic curve fitted to margins of examples that the weights have not seen turns margins into probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .features import DIM, class_counts, examples, labelled_sample, scored, shared, styled_ngrams

#: Labelled documents the fit may use, rounds, and the price of a hinge loss.
SAMPLE, ROUNDS, PRICE = 12_000, 12, 0.1
#: One example in so many is kept for the logistic curve.
CURVE = 5


def log_count_ratio(held: np.ndarray) -> np.ndarray:
    held = held + 1.0
    return np.log(held[1] / held[1].sum()) - np.log(held[0] / held[0].sum())


def descend(sample: DataFrame, ratio: np.ndarray, kinds: list[int], rounds: int = ROUNDS, price: float = PRICE) -> tuple[np.ndarray, float]:
    """(weights on indicators, bias) of the hinge-loss model; classes weigh alike, however many examples they have.

    The driver keeps one dual variable for each example of the bounded sample, and the weights.
    """
    if not all(kinds):
        return np.zeros(DIM), 1.0 if kinds[1] else -1.0
    limit = [price * sum(kinds) / (2 * n) for n in kinds]
    weights, bias, dual = np.zeros(DIM), 0.0, {}

    def run(batches):
        first, ratio, dual, b = sent.value
        w, begin, bias = first.astype(float), True, b
        for batch in batches:
            xs, keys = examples(batch), batch.column("doc_id").to_pylist()
            ys = [int(y > 0) for y in batch.column("label").to_pylist()]
            alpha = [dual.get(i, 0.0) for i in keys]
            for i in np.random.default_rng(len(dual) + len(xs)).permutation(len(xs)).tolist():
                x, y = xs[i], 2.0 * ys[i] - 1
                own = ratio[x]
                slope = y * (float(w[x] @ own) + b) - 1
                new = min(max(alpha[i] - slope / (float(own @ own) + 1.0), 0.0), limit[ys[i]])
                if new != alpha[i]:
                    w[x] += (new - alpha[i]) * y * own
                    b += (new - alpha[i]) * y
                    alpha[i] = new
            begin = begin and not keys
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column("doc_id").type), pa.array(alpha, pa.float64()), pa.nulls(len(keys), pa.binary()), pa.nulls(len(keys), pa.float64())], names=names)
        if not begin:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_arrow), pa.nulls(1, pa.float64()), pa.array([(w - first).astype(np.float32).tobytes()], pa.binary()), pa.array([b - bias])], names=names)

    names = ["doc_id", "alpha", "change", "bias"]
    id_type = sample.schema["doc_id"].dataType.simpleString()
    id_arrow = to_arrow_type(sample.schema["doc_id"].dataType)
    for _ in range(rounds):
        with shared(sample, (weights.astype(np.float32), ratio.astype(np.float32), dual, bias)) as sent:
            rows = sample.mapInArrow(run, f"doc_id {id_type}, alpha double, change binary, bias double").collect()
        parts = sum(r["change"] is not None for r in rows)
        for r in rows:
            if r["change"] is not None:
                weights = weights + np.frombuffer(r["change"], np.float32) / parts
                bias += r["bias"] / parts
            else:
                dual[r["doc_id"]] = dual.get(r["doc_id"], 0.0) + (r["alpha"] - dual.get(r["doc_id"], 0.0)) / parts
    return weights * ratio, bias


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve, by Newton steps, with smoothed targets; both classes weigh alike."""
    pos, neg = int((labels > 0).sum()), int((labels <= 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(labels > 0, 0.5 / pos, 0.5 / neg) * len(labels)
    scale = float(np.std(margins)) or 1.0
    x, at = np.stack([margins / scale, np.ones(len(margins))], axis=1), np.array([1.0, 0.0])

    def value(a: np.ndarray) -> float:
        z = x @ a
        return float(weight @ (np.logaddexp(0, z) - target * z))

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (weight * (p - target)))
        rate = 1.0
        while value(at - rate * step) > value(at) and rate > 1e-6:
            rate /= 2
        at = at - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return float(max(at[0], 1e-6) / scale), float(at[1])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = SAMPLE, folds: int = 5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text)``.

    Learns ``labels(doc_id, quality)`` from at most ``most`` documents outside fold 0 of ``crc32(doc_id) mod folds``; that
    fold is ``held_out``.  ``score`` is the probability of label 1; scores see nothing but the text.  Null and empty
    texts score as a text without n-grams does.  Repeated rows score alike; a row without id is scored and not held out.
    Without labels of both kinds all texts score alike.  Other columns are ignored.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    sample = labelled_sample(docs, labels, "quality", fold != 0, most, styled_ngrams)
    aside = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CURVE)) == 0
    fitted, kept = sample.filter(~aside), sample.filter(aside)
    held, kinds = class_counts(fitted)
    ratio = log_count_ratio(held)
    weights, bias = descend(fitted, ratio, kinds)

    weights = weights.astype(np.float32)

    def margins(batches):
        for batch in batches:
            found = [float(weights[x].sum()) + bias for x in examples(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("label")], names=["margin", "label"])

    seen = kept.mapInArrow(margins, "margin double, label int").toPandas()  # a fifth of the sample
    slope, shift = curve(seen["margin"].to_numpy(), seen["label"].to_numpy())

    def score(sums: np.ndarray) -> dict[str, np.ndarray]:
        return {"score": 1 / (1 + np.exp(-np.clip(slope * (sums + bias) + shift, -500, 500)))}

    found = scored(docs, styled_ngrams, score, weights, "score double")
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
