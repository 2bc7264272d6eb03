"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, phrases into longer phrases, and so on to one name for the whole. At each level
runs of one symbol become one symbol; deterministic coin tossing (the lowest bit in which a symbol differs from the one
before it, with that bit) shortens the symbols to labels below 8 in three rounds; a phrase starts at each local maximum
of the labels. A phrase's name is a hash of its symbols. Where phrases start depends on a few neighbours only, so equal
substrings share their inner names at whatever offset they stand. The fingerprint is the name of the whole text and the
SKETCH least names of its phrases of level LEVEL, of about 30 bytes each; a text with fewer than FEW of them also gives
the SKETCH least names of level FINE, of about 3 bytes each. Likeness is the share of phrases in common (twice the
common ones over both), estimated from the least names of the coarse level, or of the fine one where both texts give it;
1 for equal texts. With up to SKETCH phrases in both texts together it is exact, above that its standard error is at most
0.5 / sqrt(SKETCH) of the Jaccard share.

Null text counts as empty; empty texts are alike to each other (1) and to nothing else (0). Rows stand in descending
doc_id, null last, equal doc_ids by text; the row after the last is the first. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import BYTE_VALUES, mix64, shuffle_partitions

LEVEL, FINE, SKETCH, FEW = 3, 1, 64, 16
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _toss_table(symbols: int) -> np.ndarray:
    """Label of each (symbol before, symbol): twice the lowest bit in which they differ, plus that bit of the symbol."""
    before, own = np.divmod(np.arange(symbols * symbols), symbols)
    differ = before ^ own
    low = np.where(differ > 0, np.log2(np.maximum(differ & -differ, 1)).astype(np.int64), 0)
    return (2 * low + ((own >> low) & 1)).astype(np.uint8)


_TOSS_BYTES, _TOSS = _toss_table(256), _toss_table(128)
_WEIGHTS = np.multiply.accumulate(np.full(4096, _STEP | np.uint64(1), np.uint64))


def _toss(labels: np.ndarray, heads: np.ndarray, table: np.ndarray, symbols: int) -> np.ndarray:
    pair = labels.astype(np.int32)
    pair[1:] += labels[:-1].astype(np.int32) * symbols
    pair[heads] = labels[heads] + (labels[heads] ^ 1).astype(np.int32) * symbols
    return table[pair]


def _toss_names(names: np.ndarray, heads: np.ndarray) -> np.ndarray:
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[heads] = names[heads] ^ np.uint64(1)
    differ = names ^ before
    low = np.frexp((differ & (~differ + np.uint64(1))).astype(np.float64))[1].astype(np.uint64) - np.uint64(1)
    return (np.uint64(2) * low + ((names >> low) & np.uint64(1))).astype(np.uint8)


def _level(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level up, and where each document's begin. symbols: bytes or names."""
    n = len(symbols)
    heads = np.unique(at[:-1][np.diff(at) > 0])
    first = np.ones(n, bool)
    first[1:] = symbols[1:] != symbols[:-1]
    first[heads] = True
    idx = np.flatnonzero(first)
    size = np.diff(np.append(idx, n))
    own = symbols[idx]
    names = BYTE_VALUES[own] if own.dtype == np.uint8 else own
    long = size > 1
    if long.any():
        names = names.copy() if names is own else names
        names[long] = mix64(names[long] + size[long].astype(np.uint64) * _SALT)
    heads_in = np.searchsorted(idx, heads)
    labels = _toss(own, heads_in, _TOSS_BYTES, 256) if own.dtype == np.uint8 else _toss_names(own, heads_in)
    labels = _toss(_toss(labels, heads_in, _TOSS, 128), heads_in, _TOSS, 128)
    peak = np.ones(len(labels), bool)
    peak[1:] = labels[1:] > labels[:-1]
    falls = np.ones(len(labels), bool)
    falls[:-1] = labels[:-1] > labels[1:]
    falls[heads_in[1:] - 1] = True  # a document's last symbol has none after it
    peak &= falls
    peak[heads_in] = True
    start = np.flatnonzero(peak)
    length = np.diff(np.append(start, len(names)))
    nth = np.arange(len(names)) - np.repeat(start, length)
    up = mix64(np.add.reduceat(names * _WEIGHTS[nth % len(_WEIGHTS)], start) + length.astype(np.uint64) * _SALT)
    counts = np.bincount(np.searchsorted(at, idx[start], "right") - 1, minlength=len(at) - 1)
    return up, np.concatenate([[0], np.cumsum(counts)])


Names = tuple[np.ndarray, np.ndarray | None]


def _least(symbols: np.ndarray, at: np.ndarray, sketch: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(the least distinct names of each text as ascending 32-bit integers, how many it has)."""
    low = (symbols >> np.uint64(32)).astype(np.uint32)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | low)
    cut = np.searchsorted(key, np.arange(len(at), dtype=np.uint64) << np.uint64(32))
    low = key.astype(np.uint32)
    return [low[a : min(b, a + sketch)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], np.diff(cut)


def fingerprints(texts: list[bytes], level: int = LEVEL, sketch: int = SKETCH) -> tuple[np.ndarray, list[Names]]:
    """(name of each whole text, its least names of the coarse level and, for a text of few phrases, of the fine one)."""
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    root, known, depth = np.zeros(len(texts), np.uint64), np.diff(at) == 0, 0
    none = np.zeros(0, np.uint32)
    coarse, fine, n = [none] * len(texts), [none] * len(texts), np.zeros(len(texts), np.int64)
    while len(symbols) and (depth < level or not known.all()):
        symbols, at = _level(symbols, at)
        depth += 1
        if depth == FINE:
            fine, _ = _least(symbols, at, sketch)
        if depth == level:
            coarse, n = _least(symbols, at, sketch)
        one = ~known & (np.diff(at) == 1)
        root[one] = mix64(symbols[at[:-1][one]] + np.uint64(depth))
        known |= one
    return root, [(c, f if m < FEW else None) for c, f, m in zip(coarse, fine, n.tolist(), strict=True)]


def likeness(a: Names, b: Names, same: bool, sketch: int = SKETCH) -> float:
    if same:
        return 1.0
    x, y = (a[0], b[0]) if a[1] is None or b[1] is None else (a[1], b[1])
    left, right = set(x.tolist()), set(y.tolist())
    both = sorted(left | right)[:sketch]
    if not both:
        return 0.0
    j = sum(z in left and z in right for z in both) / len(both)
    return 2 * j / (1 + j)


def _written(root: int, least: Names) -> str:
    return ":".join([f"{root:016x}", *("" if x is None else x.astype(">u4").tobytes().hex() for x in least)])


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most `parts` doc_ids that cut the table into runs of about equal rows; the last is the largest. Bounded by `parts`."""
    steps = [(i + 1) / parts for i in range(parts)]
    row = docs.agg(F.percentile_approx("doc_id", steps, 20 * parts).alias("b"), F.max("doc_id").alias("m")).first()
    return sorted({*(row.b or []), *([] if row.m is None else [row.m])})


def _part(bounds: list[int]):
    """Index of the first bound that is not below doc_id, by whole groups of bounds and then inside one; nulls: 0."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.lit([g[-1] for g in groups])
    g = F.size(F.filter(tops, lambda b: b < F.col("doc_id")))
    inside = F.element_at(F.array(*[F.lit(x) for x in groups]), (g + 1).cast("int"))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(g * step + F.size(F.filter(inside, lambda b: b < F.col("doc_id")))).cast("int")


_OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _edited(text: str, following: str) -> str:
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def _finish(rows: list[tuple[int | None, str]], following: tuple[int | None, str]) -> pa.RecordBatch:
    """Results of consecutive rows; `following` stands after the last."""
    texts = [t for _, t in rows]
    after = [*texts[1:], following[1]]
    edited = [_edited(a, b) for a, b in zip(texts, after, strict=True)]
    raw = [t.encode() for t in (*texts, following[1], *edited)]
    root, least = fingerprints(raw)
    n = len(rows)
    out = []
    for i, (doc_id, text) in enumerate(rows):
        e = n + 1 + i
        out.append((doc_id, len(text), hashlib.sha256(raw[e]).hexdigest(), _written(int(root[i]), least[i]), _written(int(root[e]), least[e]), likeness(least[i], least[e], raw[i] == raw[e]), likeness(least[i], least[i + 1], raw[i] == raw[i + 1])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _OUT, strict=True)], names=[f for f, _ in _OUT])


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slice_chars: int = 1 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The table is dealt into ranges of doc_id, each sorted, so the next document is the next row. The first document of
    each range goes along to the range before it as well, to stand after that range's last. Each text is moved once.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = 2 * shuffle_partitions(docs.sparkSession)
    bounds = _bounds(rows.select("doc_id"), parts)
    if not bounds:
        bounds = [0]
    last = len(bounds) - 1
    part = _part(bounds)
    lead = F.col("doc_id").isin(bounds) if len(bounds) < 100 else F.array_contains(F.lit(bounds), F.col("doc_id"))
    guest = F.when(F.col("doc_id") == bounds[-1], F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct(F.lit(0).alias("part"), F.lit(1).alias("guest"))))
    guest = guest.when(lead, F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct((F.col("part") + 1).alias("part"), F.lit(1).alias("guest"))))
    guest = guest.otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))))
    if rows.filter("doc_id is not null").limit(1).count() == 0:
        guest = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("guest")), F.struct(F.lit(0).alias("part"), F.lit(1).alias("guest")))
    dealt = rows.withColumn("part", F.least(part, F.lit(last))).withColumn("g", F.explode(guest)).select(F.col("g.part").alias("part"), F.col("g.guest").alias("guest"), "doc_id", "text")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        held: list[tuple[int | None, str]] = []
        chars, now = 0, None
        for batch in batches:
            for p, g, i, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if p != now:
                    held, chars, now = [], 0, p
                if g:
                    if held:
                        yield _finish(held, (i, t))
                        held, chars = [], 0
                    continue
                if chars > slice_chars:
                    yield _finish(held, (i, t))
                    held, chars = [], 0
                held.append((i, t))
                chars += len(t)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
