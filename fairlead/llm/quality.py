"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over overlapping chunks of eight bytes, four apart, that cover the whole document. A chunk's
inputs are its bytes and whether the same eight bytes stand up to 32 bytes before it. Filter outputs are max-pooled over
segments of 32 chunks; the maximum and the mean of the segments make one probability. It is fitted on a bounded sample
(SAMPLE per label) and scores every whole text. Null and empty texts are one empty chunk. Without labels of both kinds
every score is 0.5. Repeated rows score alike; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import slices
from fairlead.llm.labels import fit_logistic, held_out, labelled_sample

#: Documents of each label that the network is fitted on, at most.
SAMPLE = 700
TAPS, STRIDE, SEGMENT, LAGS, FILTERS = 8, 4, 32, 32, 12
_EDGE = LAGS + TAPS


def _lay_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded bytes, chunk starts in it, first chunk of each segment, first segment of each document)."""
    n = np.diff(offsets)
    chunks = np.maximum(1, -(-n // STRIDE))
    segments = -(-chunks // SEGMENT)
    out = np.zeros(int(n.sum()) + _EDGE * (len(n) + 1), np.uint8)
    starts = offsets[:-1] + _EDGE * (np.arange(len(n)) + 1)
    where = np.arange(len(data)) + np.repeat(starts - offsets[:-1], n)
    out[where] = data
    first_chunk = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    first_segment = np.concatenate([[0], np.cumsum(segments)[:-1]])
    nth = np.arange(int(chunks.sum())) - np.repeat(first_chunk, chunks)
    seg = np.arange(int(segments.sum())) - np.repeat(first_segment, segments)
    return out, np.repeat(starts, chunks) + STRIDE * nth, np.repeat(first_chunk, segments) + SEGMENT * seg, first_segment


def _repeats(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a chunk's eight bytes also stand 2 to LAGS bytes before it."""
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    own = eight[at]
    hit = np.zeros(len(at), bool)
    for lag in range(2, LAGS + 1):
        hit |= eight[at - lag] == own
    return hit & (padded[at + TAPS - 1] != 0)


class ByteNetwork:
    """Filters as one table of outputs a tap and byte, so a chunk's output is a sum of TAPS rows."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.taps = (r.normal(size=(TAPS, 256, FILTERS)) * 0.15).astype(np.float32)
        self.repeat = (r.normal(size=FILTERS) * 0.5).astype(np.float32)
        self.bias = np.full(FILTERS, 0.1, np.float32)
        self.out = (r.normal(size=2 * FILTERS) * 0.3).astype(np.float32)
        self.out_bias = np.float32(0)

    def chunks(self, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        again = _repeats(padded, at).astype(np.float32)
        z = again[:, None] * self.repeat + self.bias
        for k in range(TAPS):
            z += self.taps[k][padded[at + k]]
        return z, again

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        padded, at, seg, doc = _lay_out(data, offsets)
        z, _ = self.chunks(padded, at)
        top = np.maximum(np.maximum.reduceat(z, seg, axis=0), 0)
        n = np.diff(np.append(doc, len(seg)))[:, None]
        return np.concatenate([np.maximum.reduceat(top, doc, axis=0), np.add.reduceat(top, doc, axis=0) / n], axis=1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(data, offsets).astype(np.float64) @ self.out + self.out_bias, -30, 30)))

    def gradients(self, raw: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray], float]:
        """(mean weighted log loss, its gradients for taps, repeat, bias and out, and for the last bias) of some documents.

        Each maximum passes its gradient to the one chunk or segment that it came from, the last of equal ones.
        """
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        padded, at, seg, doc = _lay_out(np.concatenate(raw), offsets)
        z, again = self.chunks(padded, at)
        top = np.maximum.reduceat(z, seg, axis=0)
        sizes = np.diff(np.append(seg, len(at)))
        won = np.maximum.reduceat(np.arange(len(at))[:, None] * (z == np.repeat(top, sizes, axis=0)), seg, axis=0)
        act = np.maximum(top, 0)
        per_doc = np.diff(np.append(doc, len(seg)))
        best = np.maximum.reduceat(act, doc, axis=0)
        x = np.concatenate([best, np.add.reduceat(act, doc, axis=0) / per_doc[:, None]], axis=1)
        score = np.clip(x @ self.out + self.out_bias, -30, 30)
        p = 1 / (1 + np.exp(-score))
        loss = float((weight * (np.logaddexp(0, score) - y * score)).mean())
        d = ((p - y) * weight / len(raw)).astype(np.float32)
        back = d[:, None] * self.out
        g_top = np.repeat(back[:, FILTERS:] / per_doc[:, None], per_doc, axis=0)
        g_top[np.maximum.reduceat(np.arange(len(seg))[:, None] * (act == np.repeat(best, per_doc, axis=0)), doc, axis=0), np.arange(FILTERS)] += back[:, :FILTERS]
        g_top *= top > 0
        g_taps = np.zeros_like(self.taps)
        for k in range(TAPS):
            g_taps[k] = np.bincount((padded[at[won] + k].astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), g_top.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return loss, [g_taps, (g_top * again[won]).sum(0), g_top.sum(0), x.T @ d], float(d.sum())

    def fit(self, texts: list[str], y: np.ndarray, rounds: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 11) -> ByteNetwork:
        """Adam on the log loss with a small ridge on the last layer, which is then fitted exactly."""
        raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
        r = np.random.default_rng(seed)
        params = [self.taps, self.repeat, self.bias, self.out]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        step = 0
        for _ in range(rounds):
            order = r.permutation(len(raw))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                _, grads, g_bias = self.gradients([raw[i] for i in pick], y[pick], weight[pick])
                grads[3] = grads[3] + 1e-4 * self.out
                step += 1
                for q, g, (m, v) in zip(params, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
                self.out_bias -= np.float32(rate * g_bias)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        x = np.concatenate([self.pooled(np.concatenate(raw[lo : lo + 64]), offsets[lo : lo + 65] - offsets[lo]) for lo in range(0, len(raw), 64)])
        scale = x.std(0) + 1e-3
        w, b = fit_logistic(x / scale, y, ridge=1e-2)
        self.out, self.out_bias = (w / scale).astype(np.float32), np.float32(b)
        return self


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ByteNetwork | None:
    """Fitted on rows whose crc32(doc_id) mod 3 is not 1; None where a label is missing.

    The sample holds as many documents of each label; the last bias is then set to the labels' shares in all those rows.
    """
    texts, y = labelled_sample(docs, labels, "quality", ~held_out(1, 3), {0: sample, 1: sample})
    if not len(y) or y.min() == y.max():
        return None
    network = ByteNetwork().fit(texts, y)
    share = labels.filter(~held_out(1, 3)).agg(F.avg(F.when(F.col("quality").isin(0, 1), F.col("quality")))).first()[0]
    network.out_bias += np.float32(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return network


def score_quality(docs: DataFrame, network: ByteNetwork | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: one row per input row."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                s = network.score(data, offsets) if network else np.full(rows.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s)], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows that score 0.5 or more, with all their columns and nothing else."""
    network = train_quality(docs, labels)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, names[at]):
                s = network.score(data, offsets) if network else np.full(rows.num_rows, 0.5)
                yield rows.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)
