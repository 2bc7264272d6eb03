"""Toxicity: a linear-chain conditional random field over words tags toxic spans; its marginals make document scores.

Token labels come from labelled documents: a word of a toxic document is toxic if it or its beginning is found in toxic
documents far more often than chance allows. Two such rules are tried, and the one whose field tells the spare learning
documents better is kept; held-out rows have no part in it. The field's features are hashed words, beginnings and endings; two tags
and their transitions are fitted by forward-backward on a bounded sample (SAMPLE per label). Every whole text is tagged;
a document's score comes from its highest marginal and their sum. Null and empty texts have no words and score low;
without labels of both kinds every score is 0.5. Repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import SpanHasher, slices, spans
from fairlead.llm.labels import fit_logistic, held_out, labelled_sample

#: Documents of each label that the field is fitted on, at most.
SAMPLE = {1: 1200, 0: 3600}
#: Features are hashed to this many weights.
BUCKETS = 1 << 18
BLOCK = 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, feature buckets) of each word: itself, its first 3, 4 and 5 bytes and its last 3."""
    start, end, doc = spans(_WORD[data], offsets)
    h = SpanHasher(_LOWER[data])
    kinds = [(start, end), *((start, np.minimum(start + k, end)) for k in (3, 4, 5)), (np.maximum(end - 3, start), end)]
    f = np.stack([((h(a, b) + np.uint64(k * 0x9E3779B9)) >> np.uint64(46)).astype(np.int32) for k, (a, b) in enumerate(kinds)], axis=1)
    return start, end, doc, f


class ToxicField:
    """Tag 1 is toxic. `weight` scores tag 1 against tag 0 a feature; `trans` a step from tag to tag; `begin` a first tag."""

    def __init__(self):
        self.weight = np.zeros(BUCKETS, np.float32)
        self.trans = np.zeros((2, 2))
        self.begin = np.zeros(2)
        self.top = (np.ones(2), 0.0)

    def marginals(self, emit: np.ndarray, doc: np.ndarray, n_docs: int, pairs: bool = False):
        """P(toxic) of each word, by forward-backward over all documents at once.

        Words lie in blocks of BLOCK, padded at a document's end by steps that change nothing. Each block's product of
        step matrices is made for all blocks at once; messages then pass from block to block within documents, and
        through all blocks at once. Work is in proportion to the words, whatever the lengths.
        """
        n = np.bincount(doc, minlength=n_docs)
        blocks = -(-n // BLOCK)
        first_word, first_block = np.concatenate([[0], np.cumsum(n)[:-1]]), np.concatenate([[0], np.cumsum(blocks)[:-1]])
        total = int(blocks.sum())
        if not total:
            return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
        nth = np.arange(len(doc)) - first_word[doc]
        slot = (first_block[doc] + nth // BLOCK) * BLOCK + nth % BLOCK
        odds = np.ones(total * BLOCK)
        odds[slot] = np.exp(np.clip(emit, -25, 25))
        real = np.zeros(total * BLOCK, bool)
        real[slot] = True
        odds, real = odds.reshape(total, BLOCK), real.reshape(total, BLOCK)
        t = np.exp(self.trans)
        b = np.exp(self.begin)
        head = np.zeros(total, bool)
        head[first_block[n > 0]] = True

        def step(k: int) -> tuple:
            """Entries of step matrices k of all blocks: from 0 to 0, 0 to 1, 1 to 0, 1 to 1."""
            o, r = odds[:, k], real[:, k]
            m = [np.where(r, t[0, 0], 1.0), np.where(r, t[0, 1] * o, 0.0), np.where(r, t[1, 0], 0.0), np.where(r, t[1, 1] * o, 1.0)]
            if k == 0:  # a document's first step takes `begin` whatever it comes from
                m = [np.where(head, b[0], m[0]), np.where(head, b[1] * o, m[1]), np.where(head, b[0], m[2]), np.where(head, b[1] * o, m[3])]
            return m

        p = None
        for k in range(BLOCK):
            a = step(k)
            p = a if p is None else [p[0] * a[0] + p[1] * a[2], p[0] * a[1] + p[1] * a[3], p[2] * a[0] + p[3] * a[2], p[2] * a[1] + p[3] * a[3]]
            s = 1 / np.maximum(np.maximum(p[0], p[1]), np.maximum(p[2], p[3]))
            p = [x * s for x in p]
        into, back = np.full((total, 2), 0.5), np.full((total, 2), 0.5)
        most = int(blocks.max())
        by_length = np.argsort(-blocks, kind="stable")
        longer = np.searchsorted(-blocks[by_length], -np.arange(most), "left")
        for j in range(1, most):
            i = first_block[by_length[: longer[j]]] + j
            q = i - 1
            v = np.stack([into[q, 0] * p[0][q] + into[q, 1] * p[2][q], into[q, 0] * p[1][q] + into[q, 1] * p[3][q]], axis=1)
            into[i] = v / v.sum(1, keepdims=True)
        for j in range(most - 1, 0, -1):
            i = first_block[by_length[: longer[j]]] + j
            v = np.stack([p[0][i] * back[i, 0] + p[1][i] * back[i, 1], p[2][i] * back[i, 0] + p[3][i] * back[i, 1]], axis=1)
            back[i - 1] = v / v.sum(1, keepdims=True)
        ahead = np.empty((BLOCK, total, 2))
        x, y = into[:, 0], into[:, 1]
        for k in range(BLOCK):
            a = step(k)
            x, y = x * a[0] + y * a[2], x * a[1] + y * a[3]
            s = 1 / (x + y)
            x, y = x * s, y * s
            ahead[k, :, 0], ahead[k, :, 1] = x, y
        out = np.empty((BLOCK, total))
        joint, first = np.zeros((2, 2)), np.zeros(2)
        u, v = back[:, 0], back[:, 1]
        for k in range(BLOCK - 1, -1, -1):
            c, d = ahead[k, :, 0] * u, ahead[k, :, 1] * v
            out[k] = d / (c + d)
            a = step(k)
            if pairs:
                was = ahead[k - 1] if k else into
                z = [was[:, 0] * a[0] * u, was[:, 0] * a[1] * v, was[:, 1] * a[2] * u, was[:, 1] * a[3] * v]
                s = sum(z)
                inner = real[:, k] & ~head if k == 0 else real[:, k]
                joint += np.array([[(z[0] / s)[inner].sum(), (z[1] / s)[inner].sum()], [(z[2] / s)[inner].sum(), (z[3] / s)[inner].sum()]])
                if k == 0:
                    first = np.array([(1 - out[0])[head].sum(), out[0][head].sum()])
            u, v = a[0] * u + a[1] * v, a[2] * u + a[3] * v
            s = 1 / (u + v)
            u, v = u * s, v * s
        m = out.T.reshape(-1)[slot]
        return (m, joint, first) if pairs else m

    def emissions(self, f: np.ndarray) -> np.ndarray:
        out = self.weight[f[:, 0]].astype(np.float64)
        for k in range(1, f.shape[1]):
            out += self.weight[f[:, k]]
        return out

    @staticmethod
    def summary(m: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Two figures a document: log odds of the highest marginal, and log of the marginals' sum."""
        top = np.zeros(n_docs)
        np.maximum.at(top, doc, m)
        top = np.clip(top, 1e-4, 1 - 1e-4)
        return np.stack([np.log(top / (1 - top)), np.log1p(np.bincount(doc, m, n_docs))], axis=1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        _, _, doc, f = features(data, offsets)
        n = len(offsets) - 1
        x = self.summary(self.marginals(self.emissions(f), doc, n), doc, n)
        return 1 / (1 + np.exp(-np.clip(x @ self.top[0] + self.top[1], -30, 30)))

    def fit(self, texts: list[str], y: np.ndarray, rounds: int = 5) -> ToxicField:
        raw = [t.encode("utf-8", "replace") for t in texts]
        n_docs = len(raw)
        parts = []
        #: Every third document only calibrates the score, so that words the weights have learned by heart don't.
        spare = np.arange(n_docs) % 3 == 2
        if min(y[spare].sum(), (1 - y[spare]).sum()) < 5:
            spare[:] = False
        order = np.argsort(spare, kind="stable")
        learn = int((~spare).sum())
        raw, y = [raw[i] for i in order], y[order]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        cuts = [*range(0, learn, 400), *range(learn, n_docs, 400), n_docs]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            _, _, doc, f = features(np.frombuffer(b"".join(raw[lo:hi]), np.uint8), offsets[lo : hi + 1] - offsets[lo])
            parts.append((lo, hi, doc, f))
        checks = [p for p in parts if p[0] >= learn] or parts
        parts = [p for p in parts if p[0] < learn]
        own = y[checks[0][0] : checks[-1][1]]
        found = []
        for repeated in (False, True):
            self._fit_field(parts, self._token_labels(parts, y, repeated), rounds)
            x = np.concatenate([self.summary(self.marginals(self.emissions(f), doc, hi - lo), doc, hi - lo) for lo, hi, doc, f in checks])
            top = fit_logistic(x, own, ridge=1e-3)
            z = np.clip(x @ top[0] + top[1], -30, 30)
            found.append((float(np.mean(np.logaddexp(0, z) - own * z)), repeated, self.weight, self.trans, self.begin, top))
        _, self.repeated, self.weight, self.trans, self.begin, self.top = min(found, key=lambda r: r[:2])
        return self

    def _fit_field(self, parts: list, tags: list[np.ndarray], rounds: int) -> None:
        self.weight = np.zeros(BUCKETS, np.float32)
        seen = np.full(BUCKETS, 1e-6, np.float32)
        self.trans = np.array([[0.0, -4.0], [0.0, -2.0]])
        self.begin = np.array([0.0, -4.0])
        for _ in range(rounds):
            for (lo, hi, doc, f), tag in zip(parts, tags, strict=True):
                if not len(doc):
                    continue
                m, joint, first = self.marginals(self.emissions(f), doc, hi - lo, pairs=True)
                d = (tag - m).astype(np.float32)
                some = np.abs(d) > 1e-4
                idx, val = f[some].ravel(), np.repeat(d[some], f.shape[1])
                g = np.bincount(idx, val, BUCKETS).astype(np.float32) - 0.002 * self.weight
                seen += g * g
                self.weight += 0.7 * g / np.sqrt(seen)
                same = doc[1:] == doc[:-1]
                real = np.zeros((2, 2))
                np.add.at(real, (tag[:-1][same].astype(int), tag[1:][same].astype(int)), 1)
                self.trans += 0.5 * (real - joint) / max(joint.sum(), 1)
                heads = np.flatnonzero(np.concatenate([[True], ~same]))
                self.begin += 0.5 * (np.bincount(tag[heads].astype(int), minlength=2) - first) / max(first.sum(), 1)

    @staticmethod
    def _token_labels(parts: list, y: np.ndarray, repeated: bool = True) -> list[np.ndarray]:
        """1 for words of toxic documents whose word, or beginning of 4 or 5 bytes, toxic documents hold beyond chance.

        The test is made for what a document holds at all and, if `repeated`, again for what it holds twice or more, which
        finds beginnings that clean documents have now and then too; the latter are labelled where they stand twice or more.
        """
        toxic, clean = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
        twice = []
        for lo, _, doc, f in parts:
            of_part = np.zeros((len(doc), 3), bool)
            for i, k in enumerate((0, 2, 3)):
                pair, back, n = np.unique(doc.astype(np.int64) * BUCKETS + f[:, k], return_inverse=True, return_counts=True)
                of_part[:, i] = n[back] > 1
                for least in (0, 1):
                    at, of = pair[n > least] % BUCKETS, y[lo + pair[n > least] // BUCKETS] > 0
                    toxic[least] += np.bincount(at[of], minlength=BUCKETS)
                    clean[least] += np.bincount(at[~of], minlength=BUCKETS)
            twice.append(of_part)
        share = np.concatenate([y[lo:hi] for lo, hi, _, _ in parts]).mean()
        n = np.maximum(toxic + clean, 1)
        gain = toxic * np.log(np.maximum(toxic, 1e-9) / (n * share)) + clean * np.log(np.maximum(clean, 1e-9) / (n * (1 - share)))
        sure = (toxic / n > share + 0.6 * (1 - share)) & (gain > np.log(np.count_nonzero(toxic, axis=1, keepdims=True) + 2.0) + 1)
        own = lambda f, t: (sure[0][f[:, (0, 2, 3)]] | sure[1][f[:, (0, 2, 3)]] & t & repeated).any(axis=1)
        return [(y[lo + doc] > 0) * own(f, t).astype(np.float64) for (lo, _, doc, f), t in zip(parts, twice, strict=True)]


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> ToxicField | None:
    """Fitted on rows whose crc32(doc_id) mod 5 is not 0; None where a label is missing."""
    texts, y = labelled_sample(docs, labels, "toxic", ~held_out(0, 5), sample or SAMPLE)
    if not len(y) or y.min() == y.max():
        return None
    return ToxicField().fit(texts, y)


def score_toxicity(docs: DataFrame, field: ToxicField | None, doc_id: str = "doc_id", text: str = "text", with_spans: bool = False) -> DataFrame:
    """doc_id, score and, if asked for, spans: byte offsets (start, end) of words with a marginal of 0.5 or more."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                n = rows.num_rows
                if field is None:
                    score, where = np.full(n, 0.5), [[] for _ in range(n)]
                else:
                    start, end, doc, f = features(data, offsets)
                    m = field.marginals(field.emissions(f), doc, n)
                    x = field.summary(m, doc, n)
                    score, where = 1 / (1 + np.exp(-np.clip(x @ field.top[0] + field.top[1], -30, 30))), [[] for _ in range(n)]
                    for i in np.flatnonzero(m >= 0.5) if with_spans else ():
                        where[doc[i]].append({"start": int(start[i] - offsets[doc[i]]), "end": int(end[i] - offsets[doc[i]])})
                cols, names = [rows.column(0), pa.array(score)], ["doc_id", "score"]
                if with_spans:
                    cols, names = [*cols, pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [*names, "spans"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, score double" + (", spans array<struct<start:bigint,end:bigint>>" if with_spans else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
