"""Quality scores: logistic regression over hashed word n-grams, trained by FTRL-proximal updates.

A text's features are its words and word pairs, lower-cased, and the shapes of both (upper
case A, lower case a, digits 0, runs collapsed, other bytes as they are), hashed to one
space. A score is the sparse dot product of counts and weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import col, in_arrow
from .textkit import U64, flat, lower_ascii, mix, slices, span_hashes, words

#: Size of the hashed feature space; the model is at most so many weights.
SPACE = 1 << 18
#: About so many labelled rows, drawn by a hash of the id, fit the model, whatever the size of the table.
SAMPLE_ROWS = 12_000
#: The sample is fitted in so many shards, whose weights are averaged.
SHARDS = 4
#: FTRL-proximal: step size, its offset, and the L1 and L2 penalties; passes over a shard.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.02, 1e-4, 2
#: Fixed map of bytes to shapes.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 97


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts in a row, and the count of each text."""
    data, offsets = flat(texts)
    starts, ends, owner = words(data, offsets)
    n = len(offsets) - 1
    raw = span_hashes(lower_ascii(data), starts, ends)
    shapes = SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shapes[1:] != shapes[:-1]
    keep[starts] = True
    place = np.r_[0, np.cumsum(keep)]
    shaped = span_hashes(shapes[keep], place[starts], place[ends])
    pair = owner[1:] == owner[:-1]
    kinds = []
    with np.errstate(over="ignore"):
        for kind, h in enumerate((raw, shaped)):
            kinds.append((owner, mix(h + U64(2 * kind + 1))))
            kinds.append((owner[1:][pair], mix(h[:-1][pair] * U64(31) + h[1:][pair] + U64(2 * kind + 2))))
    keys = np.concatenate([k for k, _ in kinds]) if len(owner) else np.zeros(0, np.int64)
    values = (np.concatenate([v for _, v in kinds]) & U64(SPACE - 1)).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    return values[order], np.bincount(keys, minlength=n)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights after follow-the-regularised-leader updates, one row at a time; the last weight is the bias."""
    z, n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)
    sparse = [np.unique(np.append(r, SPACE), return_counts=True) for r in rows]
    sparse = [(i, np.where(i == SPACE, 1.0, c / np.sqrt(max(1, len(r))))) for (i, c), r in zip(sparse, rows, strict=True)]
    for _ in range(PASSES):
        for (i, x), y in zip(sparse, labels, strict=True):
            w = leader(z[i], n[i])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    return leader(z, n)


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """The averaged weights of the shards' models over labelled rows for which `usable` (over doc_id) holds; zeros without any.

    Labels other than 0 and 1, null labels and null ids do not count; of several labels of
    an id the largest does.
    """
    marked = labels.select(col(id_col).cast("long").alias("doc_id"), col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(usable)
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    part = min(1.0, SAMPLE_ROWS / max(1, marked.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 20))
    marked = marked.where(draw < int(part * (1 << 20))).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS)))
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        rows = rows.iloc[np.random.RandomState(7).permutation(len(rows))]
        found = []
        for _, texts in slices(pa.array(rows.doc_id), pa.array(rows.text, pa.string())):
            values, counts = features(texts)
            found += np.split(values, np.cumsum(counts)[:-1])
        w = fit(found, rows.label.to_numpy(float))
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": at, "weight": w[at], "of": len(rows)})

    sample = texts.join(F.broadcast(marked), "doc_id")  # at most about SAMPLE_ROWS rows of three numbers
    models = sample.groupBy("shard").applyInPandas(run, "feature bigint, weight double, of bigint")
    got = models.groupBy("feature").agg(F.sum(F.col("weight") / SHARDS).alias("weight")).toPandas()
    weights = np.zeros(SPACE + 1)
    weights[got.feature.to_numpy(np.int64)] = got.weight
    return weights


def scored(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted. Null and empty texts score by the bias alone; extra columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # SPACE + 1 numbers, 2 MB

    def run(batches):
        w = model.value
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                values, counts = features(texts)
                sums = np.r_[0.0, np.cumsum(w[values])]
                ends = np.cumsum(counts)
                score = 1 / (1 + np.exp(-np.clip((sums[ends] - sums[ends - counts]) / np.sqrt(np.maximum(counts, 1)) + w[SPACE], -35, 35)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id bigint, score double, predicted int")
