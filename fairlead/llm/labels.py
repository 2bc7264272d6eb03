"""Bounded labelled samples for the classifiers, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of text that a classifier's sample holds at most.
SAMPLE_BYTES = 64 << 20


def held_out(fold: int, of: int, doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo `of`, equals `fold`; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, most: dict[int, int], doc_id: str = "doc_id", text: str = "text", most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most most[label] documents a label, chosen by a hash of doc_id among rows where `learn` holds.

    Documents labelled both ways are left out. The sample is bounded by `most`, so the join that fetches its texts may
    broadcast it. Of its texts, in the order of that hash, those are taken whose running total is at most `most_bytes`.
    Sorted, so that reruns agree.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).filter(learn)
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", "y")
    chosen = None
    for y, n in most.items():
        part = rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    held = texts.join(F.broadcast(chosen), "doc_id").withColumn("nth", F.row_number().over(order)).withColumn("held", F.sum(F.octet_length("text")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = held.filter((F.col("nth") <= sum(most.values())) & (F.col("held") <= most_bytes)).orderBy("nth").select("text", "y").toArrow()
    return found.column("text").to_pylist(), found.column("y").to_numpy().astype(np.float64)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method; x is scaled by the caller."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])
