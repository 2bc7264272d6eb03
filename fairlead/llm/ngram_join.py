"""Exact Jaccard self-join on word shingles as a blocked sparse product of documents by n-grams.

A document's set holds its distinct five-word shingles after lower-casing A-Z; with fewer words the whole sequence is
its one element; without words it is empty and linked with nothing. Two documents link when their similarity is 0.75 or
more. Documents with the same set form one class, which takes part once. Null text counts as empty, repeated rows are
rows of their own, an empty table gives an empty result. Sets go by 64-bit names that a second 64-bit hash checks:
names that two sets share are found, and all sets of that name go by the second hash instead. An n-gram stands for
itself by its block and 48 bits of its hash: of the two million n-grams of a block two share theirs once in 140 blocks,
and a link could only be wrong where two such texts also lie within one n-gram of the bound.

1. The incidence matrix is dealt into blocks of columns (n-grams). A block drops n-grams of a single class; a class
   whose other n-grams make up less than 0.75 of its set has no partner (size bound) and goes. An n-gram that is very
   frequent in what one task holds is known to be shared there and needs no block, so no block gets its whole column.
2. What is left is counted anew, and each class keeps its rarest n-grams, as many as no partner can avoid
   (prefix bound). Classes that share one of these form clusters.
3. In each cluster rows are multiplied with the columns of rows not yet reached, and overlaps below the bound that
   both sizes set are discarded. Rows already linked to each other are not compared again, so groups of near copies cost
   about their size, and no pair of different texts is left out.
4. A cluster over TILE postings is dealt into tiles. Each links its own rows; the heads that tiles leave are dealt and
   linked again. Rows that are then in different components meet in pairs of tiles of PAIR_TILE postings; those of the
   largest one do not meet each other again, so a large group of near copies costs about its size here too.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import SpanHasher, materialize, mix64, slices, spans
from fairlead.llm.components import least_labels

WORDS = 5
#: 100 * overlap >= 75 * union, as overlap and sizes: 7 * overlap >= 3 * (size + size).
PER_OVERLAP, PER_SIZE = 7, 3
#: Postings that a task gathers before it sends them on, and how often one n-gram must be among them to count as frequent.
GATHERED, FREQUENT = 1_200_000, 48
#: Postings of a block of columns, and keys of a part of the classes that are left; both bound what one task holds.
BLOCK, PART = 2_000_000, 1_000_000
#: Postings that gather in a bucket of classes; buckets follow the corpus, as blocks and parts do.
BUCKET = 500_000
#: Postings of a cluster that one task links at once, and of tiles of rows in different components that meet in pairs.
TILE, PAIR_TILE = 64_000, 500_000
_KEY_BITS = 48
_KEY_MASK = np.uint64((1 << _KEY_BITS) - 1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of each document, one after another."""
    n_docs = len(offsets) - 1
    start, end, doc = spans(~_BLANK[data], offsets)
    w = SpanHasher(_LOWER[data])(start, end)
    n = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(n)])
    factor = mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    whole = np.flatnonzero(np.arange(len(w)) + words <= first[doc + 1])
    h = np.zeros(len(whole), np.uint64)
    for k in range(words):
        h += w[whole + k] * factor[k]
    owner = doc[whole]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = n[short] > k
            own[has] += w[first[short[has]] + k] * factor[k]
        own += n[short].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        h, owner = np.concatenate([h, own]), np.concatenate([owner, short])
    h = mix64(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[keep], owner[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_docs))]).astype(np.int64)


def _set_names(h: np.ndarray, at: np.ndarray, shared: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit name of each set, a second one); empty sets are named 0. A first name in `shared` gives way to the second."""
    raw, ends = h.tobytes(), (at * 8).tolist()
    digest = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() if b > a else bytes(16) for a, b in zip(ends[:-1], ends[1:], strict=True))
    names = np.frombuffer(digest, np.int64).reshape(-1, 2)
    own, check = names[:, 0].copy(), names[:, 1]
    if shared:
        again = np.isin(own, np.fromiter(shared, np.int64, len(shared)))
        own[again] = check[again]
    return own, check


def _pack(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + size), one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    some = sizes > 0
    starts, sizes = starts[some], sizes[some]
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out[heads] = starts
    out[heads[1:]] -= starts[:-1] + sizes[:-1] - 1
    return np.cumsum(out)


def _split_rows(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, counts) of the runs of a sorted row index; runs over 65535 are cut, so that a count takes two bytes."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    n = np.diff(np.append(start, len(row)))
    pieces = -(-n // 65535)
    heads = np.repeat(start, pieces) + 65535 * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return heads, np.diff(np.append(heads, len(row))).astype(np.uint16)


#: Packed postings: of each owner in turn its name, the size of its set (0: told elsewhere), how many keys, and the keys.
_PACKED = pa.schema([("to", pa.int32()), ("owners", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("often", pa.binary())])
_PACKED_SQL = "to int, owners binary, sizes binary, counts binary, keys binary, often binary"


def _packed_row(to: int, owner: np.ndarray, size: np.ndarray | None, row: np.ndarray, keys: bytes, often: bytes = b"") -> tuple:
    heads, counts = _split_rows(row)
    r = row[heads]
    return to, owner[r].tobytes(), b"" if size is None else size[r].astype(np.int32).tobytes(), counts.tobytes(), keys, often


def _batch(rows: list[tuple]) -> pa.Table:
    if not rows:
        return _PACKED.empty_table()
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _pack_by(to: np.ndarray, owner: np.ndarray, size: np.ndarray | None, row: np.ndarray, h: np.ndarray, often: np.ndarray | None = None) -> list[tuple]:
    """One packed row for each value of `to`, which has an entry a posting; postings come sorted by row."""
    order = np.argsort(to, kind="stable")
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
        out.append(_packed_row(int(to[part[0]]), owner, size, row[part], h[part].tobytes(), b"" if often is None else often[part].tobytes()))
    return out


def _opened(table: pa.Table, short: bool = False) -> tuple[np.ndarray, ...]:
    """(owner, size, count, packed row) of each entry, and all keys and their `often`, from packed rows."""
    col = lambda c: table.column(c).to_pylist()
    owners = [np.frombuffer(x, np.int64) for x in col("owners")]
    sizes = [np.frombuffer(x, np.int32) if x else np.zeros(len(o), np.int32) for x, o in zip(col("sizes"), owners, strict=True)]
    counts = np.concatenate([np.frombuffer(x, np.uint16) for x in col("counts")]).astype(np.int64)
    keys = np.concatenate([_unpack(x) if short else np.frombuffer(x, np.uint64) for x in col("keys")])
    often = np.concatenate([np.frombuffer(x, np.int32) for x in col("often")])
    return np.concatenate(owners), np.concatenate(sizes), counts, np.repeat(np.arange(len(owners)), [len(o) for o in owners]), keys, often


def _block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)


def _deal(owner: np.ndarray, size: np.ndarray, row: np.ndarray, h: np.ndarray, blocks: int, buckets: int) -> pa.Table:
    """Postings (row of owner, hash), packed by block with 48-bit keys.

    Set sizes go by `to` = -1 - bucket straight to where a class's postings meet again, and so do the postings of n-grams
    that are frequent here; their blocks only learn, from an owner named 0, that they are shared.
    """
    values, counts = np.unique(h, return_counts=True)
    hot = values[counts >= FREQUENT]
    block = _block_of(h, blocks)
    frequent = np.isin(h, hot) if len(hot) else np.zeros(len(h), bool)
    out = []
    some = np.flatnonzero(~frequent)
    order = some[np.argsort(block[some], kind="stable")]
    for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
        out.append(_packed_row(int(block[part[0]]), owner, None, row[part], _pack(h[part] & _KEY_MASK)))
    own = _block_of(hot, blocks)
    for b in np.unique(own).tolist():
        keys = hot[own == b] & _KEY_MASK
        out.append(_packed_row(b, np.zeros(1, np.int64), None, np.zeros(len(keys), np.int64), _pack(keys)))
    bucket = (owner % buckets).astype(np.int32)
    row, h = row[frequent], _whole_key(h[frequent], blocks)
    n = np.bincount(row, minlength=len(owner))
    at = np.concatenate([[0], np.cumsum(n)])
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if n[part].max() > 65535:  # a very long text: its frequent n-grams in pieces
            for i in part:
                for lo in range(0, max(1, int(n[i])), 65535):
                    piece = h[at[i] + lo : min(at[i] + lo + 65535, at[i + 1])]
                    out.append((-1 - int(bucket[i]), owner[[i]].tobytes(), size[[i]].astype(np.int32).tobytes(), np.array([len(piece)], np.uint16).tobytes(), piece.tobytes(), b""))
            continue
        out.append((-1 - int(bucket[part[0]]), owner[part].tobytes(), size[part].astype(np.int32).tobytes(), n[part].astype(np.uint16).tobytes(), h[_ranges(at[part], n[part])].tobytes(), b""))
    return _batch(out)


def _whole_key(h: np.ndarray, blocks: int) -> np.ndarray:
    """The key of a hash across blocks: its 48 low bits under its block's number."""
    return (h & _KEY_MASK) | (_block_of(h, blocks).astype(np.uint64) % np.uint64(1 << 16) << np.uint64(_KEY_BITS))


def _postings(docs: DataFrame, blocks: int, buckets: int, shared: frozenset[int]) -> DataFrame:
    def run(batches):
        seen: set[int] = set()
        held: list[tuple] = []
        total = 0

        def flush():
            owner, n, h = (np.concatenate(c) for c in zip(*held, strict=True))
            return _deal(owner, n, np.repeat(np.arange(len(n)), n), h, blocks, buckets).to_batches()

        for batch in batches:
            for _, data, offsets in slices(batch):
                h, at = shingle_sets(data, offsets)
                names, n = _set_names(h, at, shared)[0], np.diff(at)
                if len(seen) > 500_000:
                    seen.clear()
                new = [i for i, x in enumerate(names.tolist()) if x and not (x in seen or seen.add(x))]
                if not new:
                    continue
                new = np.array(new)
                held.append((names[new], n[new], h[_ranges(at[new], n[new])]))
                total += len(held[-1][2])
                if total >= GATHERED:
                    yield from flush()
                    held, total = [], 0
        if held:
            yield from flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, _PACKED_SQL)


def _screen_block(table: pa.Table, buckets: int) -> pa.Table:
    """The postings of a block whose n-gram more than one class has, packed by where their class meets again."""
    block = table.column("to")[0].as_py()
    if block < 0:
        return table
    owner, _, n, packed, h, _ = _opened(table, short=True)
    at = np.concatenate([[0], np.cumsum(n)])
    _, first, back = np.unique(owner, return_index=True, return_inverse=True)  # a class that several tasks sent counts once
    keep = np.flatnonzero((packed == packed[first[back]]) | (owner == 0))
    row = np.repeat(keep, n[keep])
    h = h[_ranges(at[keep], n[keep])]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    shared = np.zeros(len(h), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    shared &= owner[row] != 0
    row, h = row[shared], h[shared] | (np.uint64(block % (1 << 16)) << np.uint64(_KEY_BITS))
    return _batch([(-1 - t[0], *t[1:]) for t in _pack_by((owner[row] % buckets).astype(np.int32), owner, None, row, h)])


def _regrouped(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(owner, size, offsets, keys, often) with the entries of each owner together and its keys once, ascending."""
    owner, size, n, _, keys, often = _opened(table)
    names, back = np.unique(owner, return_inverse=True)
    whole = np.zeros(len(names), np.int32)
    np.maximum.at(whole, back, size)
    row = np.repeat(back, n)
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    one = np.ones(len(keys), bool)
    one[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    often = often[order][one] if len(often) else None
    return names, whole, np.searchsorted(row[one], np.arange(len(names) + 1)), keys[one], often


_CLASS = pa.schema([("owner", pa.int64()), ("size", pa.int32()), ("keys", pa.binary()), ("rare", pa.binary())])
_CLASS_SQL = "owner long, size int, keys binary, rare binary"


def _gather(table: pa.Table) -> pa.Table:
    """Classes whose shared n-grams make up 0.75 of their set or more."""
    owner, size, at, keys, _ = _regrouped(table)
    some = np.flatnonzero(4 * np.diff(at) >= 3 * size.astype(np.int64))
    rows = [keys[at[i] : at[i + 1]].tobytes() for i in some]
    return pa.Table.from_arrays([pa.array(owner[some]), pa.array(size[some]), pa.array(rows, pa.binary()), pa.array([b""] * len(rows), pa.binary())], schema=_CLASS)


def _spread(classes: DataFrame, column: str, parts: int) -> DataFrame:
    """Keys of classes, packed by part, so that all postings of a key meet in one."""

    def run(batches):
        for batch in batches:
            lists = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            if not lists:
                continue
            k = np.concatenate(lists)
            row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            to = (mix64(k.copy()) % np.uint64(parts)).astype(np.int32)
            yield from _batch(_pack_by(to, batch.column(0).to_numpy(), batch.column(1).to_numpy(), row, k)).to_batches()

    return classes.select("owner", "size", column).mapInArrow(run, _PACKED_SQL)


def _count_part(table: pa.Table, buckets: int) -> pa.Table:
    """How many classes have each key, packed by where their class meets again; keys of a single class go."""
    owner, size, n, _, k, _ = _opened(table)
    row = np.repeat(np.arange(len(n)), n)
    _, back, often = np.unique(k, return_inverse=True, return_counts=True)
    often = often[back].astype(np.int32)
    keep = often > 1
    row, k, often = row[keep], k[keep], often[keep]
    return _batch(_pack_by((owner[row] % buckets).astype(np.int32), owner, size, row, k, often))


def _prefix(table: pa.Table) -> pa.Table:
    """Classes still with enough shared keys; rare: their rarest keys, as many as a partner cannot avoid all."""
    owner, size, at, keys, often = _regrouped(table)
    out = []
    for i in np.flatnonzero(4 * np.diff(at) >= 3 * size.astype(np.int64)).tolist():
        k, o, whole = keys[at[i] : at[i + 1]], often[at[i] : at[i + 1]], int(size[i])
        most = whole - -(-3 * whole // 4) + 1 - (whole - len(k))
        out.append((int(owner[i]), whole, k.tobytes(), k[np.lexsort((k, o))[:most]].tobytes()))
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _CLASS, strict=True)], schema=_CLASS) if out else _CLASS.empty_table()


def _keys_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over nodes 0..max: the least node of each node's component."""
    parent = list(range(int(max(a.max(initial=-1), b.max(initial=-1))) + 1))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for x in range(len(parent)):
        parent[x] = parent[parent[x]]
    return np.array(parent, np.int64)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _part_edges(table: pa.Table) -> pa.Table:
    """Stars of the classes that the keys of a part join."""
    names, _, n, _, k, _ = _opened(table)
    owner, back = np.unique(names, return_inverse=True)
    row = np.repeat(back, n)
    order = np.lexsort((row, k))
    k, row = k[order], row[order]
    same = np.flatnonzero(k[1:] == k[:-1])
    if not len(same):
        return _EDGES.empty_table()
    root = _forest(row[same], row[same + 1])
    node = np.flatnonzero(root != np.arange(len(root)))
    return pa.Table.from_arrays([pa.array(owner[root[node]]), pa.array(owner[node])], schema=_EDGES)


def link_rows(size: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """The least row linked, at any number of steps, to each row of a cluster: a sparse product, row by row.

    A row is multiplied with the columns of the rows not yet reached; those whose overlap meets the bound of both sizes
    join its component. The columns are cut down whenever half of their rows have been reached.
    """
    m = len(keys)
    n = np.array([len(k) for k in keys])
    at = np.concatenate([[0], np.cumsum(n)])
    _, column = np.unique(np.concatenate(keys), return_inverse=True)
    row_of = np.repeat(np.arange(m), n)
    root = np.full(m, -1, np.int64)
    open_rows, cols = np.ones(m, bool), None
    left = m

    def cut():
        keep = np.flatnonzero(open_rows[row_of])
        order = keep[np.argsort(column[keep], kind="stable")]
        return row_of[order], np.searchsorted(column[order], np.arange(int(column.max(initial=-1)) + 2))

    built = 0
    for seed in range(m):
        if root[seed] >= 0:
            continue
        root[seed], open_rows[seed] = seed, False
        left -= 1
        queue = [seed]
        while queue and left:
            if cols is None or 2 * left < built:
                cols, built = cut(), left
            x = queue.pop()
            mine = column[at[x] : at[x + 1]]
            first, last = cols[1][mine], cols[1][mine + 1]
            hits = cols[0][_ranges(first, last - first)]
            if not len(hits):
                continue
            overlap = np.bincount(hits, minlength=m)
            near = np.flatnonzero(open_rows & (overlap > 0))
            near = near[PER_OVERLAP * overlap[near] >= PER_SIZE * (size[near] + size[x])]
            root[near], open_rows[near] = seed, False
            left -= len(near)
            queue += near.tolist()
    return root


_LINKED = pa.schema([*_EDGES, ("cluster", pa.int64()), ("owner", pa.int64()), ("size", pa.int32()), ("keys", pa.binary())])
_LINKED_SQL = "a long, b long, cluster long, owner long, size int, keys binary"


def _cluster_edges(table: pa.Table) -> pa.Table:
    """Stars (a: head, b: row) of the rows that link; of a tile among several also its heads, as rows."""
    order = np.argsort(table.column("owner").to_numpy())
    table = table.take(pa.array(order))
    owner, keys = table.column("owner").to_numpy(), _keys_of(table.column("keys"))
    root = link_rows(table.column("size").to_numpy().astype(np.int64), keys)
    node = np.flatnonzero(root != np.arange(len(root)))
    edges = pa.Table.from_arrays([pa.array(owner[root[node]]), pa.array(owner[node])], schema=_EDGES)
    if "tiles" not in table.column_names or table.column("tiles")[0].as_py() < 2:
        return pa.concat_tables([edges, _LINKED.empty_table()], promote_options="default")
    heads = table.take(pa.array(np.flatnonzero(root == np.arange(len(root))))).select(["cluster", "owner", "size", "keys"])
    return pa.concat_tables([edges, heads, _LINKED.empty_table()], promote_options="default").select(_LINKED.names)


def set_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key (hash of the text), n_shingles, owner (name of the set), check (its second name): one row per input row."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                h, at = shingle_sets(data, offsets)
                names, check = _set_names(h, at)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(at)), pa.array(names), pa.array(check)], names=["doc_id", "row_key", "n_shingles", "owner", "check"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("row_key"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, row_key long, n_shingles long, owner long, check long")


class Sets:
    """The sets of a table, one row per input row and one per class, and the names that two different sets share.

    Of n different sets n * n / 2**65 pairs share a name, ten of 20 thousand million, so the driver may hold those.
    """

    def __init__(self, rows: DataFrame):
        rows = materialize(rows, "join-sets")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
        own = materialize(rows.groupBy("owner", "check").agg(F.max("n_shingles").alias("n"), first), "join-classes")
        self.shared = frozenset(r.owner for r in own.groupBy("owner").agg(F.count("*").alias("k")).filter("k > 1").collect())
        name = F.when(F.col("owner").isin(list(self.shared)), F.col("check")).otherwise(F.col("owner")).alias("owner") if self.shared else F.col("owner")
        self.rows = rows.select("doc_id", "row_key", "n_shingles", name)
        self.classes = own.select(name, "n", "first")


def _parts(classes: DataFrame, column: str) -> int:
    """Parts of about PART keys."""
    return max(1, -(-(classes.agg(F.sum(F.length(column))).first()[0] or 0) // (8 * PART)))


def _linked(rows: DataFrame, *tile: str) -> DataFrame:
    """Stars (a, b) of the rows that link within each tile of a cluster, and the heads of clusters of several tiles."""
    return rows.groupBy("cluster", *tile).applyInArrow(_cluster_edges, _LINKED_SQL)


def _edges(linked: DataFrame) -> DataFrame:
    return linked.filter("a is not null").select("a", "b")


def _tiles(weights: DataFrame, tile: int) -> DataFrame:
    """How many tiles of about `tile` postings each large cluster takes, from (cluster, w), the bytes of its rows' keys."""
    return weights.groupBy("cluster").agg(F.ceil(F.sum("w") / (8 * tile)).cast("int").alias("tiles")).filter("tiles > 1")


def _dealt(members: DataFrame, tiles: DataFrame, salt: int) -> DataFrame:
    """Rows of clusters with their tile `i`; clusters not in `tiles` are one tile."""
    out = members.join(tiles, "cluster", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    return out.withColumn("i", F.pmod(F.xxhash64("owner", F.lit(salt)), F.col("tiles")).cast("int"))


def _linked_heads(linked: DataFrame, before: int, tile: int) -> DataFrame:
    """Edges between the heads that tiles have left in large clusters, dealt anew as long as that halves them.

    In a group of near copies a tile leaves few heads, so the rounds cost about the size of the group. `before`: the bytes
    of keys that went into the tiles of `linked`.
    """
    found, salt = [], 1
    while True:
        rows = linked.filter("owner is not null").select("cluster", "owner", "size", "keys")
        sizes = materialize(rows.groupBy("cluster").agg(F.sum(F.length("keys")).alias("w")), "join-heads")
        after = sizes.agg(F.sum("w")).first()[0] or 0
        tiles = _tiles(sizes, tile)
        linked = materialize(_linked(_dealt(rows, tiles, salt), "tiles", "i"), "join-edges")
        found.append(_edges(linked))
        if 2 * after > before or tiles.isEmpty():
            return reduce(DataFrame.unionByName, found)
        before, salt = after, salt + 1


def _apart(rows: DataFrame, links: DataFrame, tile: int) -> DataFrame:
    """Tile pairs (lo, hi) of the rows of large clusters in which rows of different components meet.

    A cluster's largest component, in tiles below 0, meets the other rows, in tiles from 0, but not itself. A cluster
    that one tile can hold meets as one; clusters of one component are done. Components are told on (cluster, owner, w)
    alone; keys are only moved for the clusters that are left.
    """
    slim = rows.select("cluster", "owner", F.length("keys").alias("w")).join(links.select(F.col("node").alias("owner"), "root"), "owner", "left")
    slim = materialize(slim.withColumn("root", F.coalesce("root", "owner")), "join-roots")
    parts = slim.groupBy("cluster", "root").agg(F.sum("w").alias("w"))
    parts = parts.groupBy("cluster").agg(F.max(F.struct("w", "root")).alias("most"), F.sum("w").alias("all")).filter(F.col("all") > F.col("most.w"))
    count = lambda n: F.ceil(n / (8 * tile)).cast("int")
    parts = materialize(parts.select("cluster", F.col("most.root").alias("main"), count(F.col("most.w")).alias("p"), count(F.col("all") - F.col("most.w")).alias("q"), (F.col("all") <= 8 * tile).alias("one")), "join-apart")
    h = F.xxhash64("owner")
    place = slim.join(parts, "cluster").withColumn("in_main", F.col("root") == F.col("main"))
    place = place.withColumn("t", F.when(F.col("one"), 0).when(F.col("in_main"), -1 - F.pmod(h, F.col("p"))).otherwise(F.pmod(h, F.col("q"))).cast("int"))
    first = F.when(F.col("one") | F.col("in_main"), 0).otherwise(-F.col("p"))
    place = place.select("owner", "t", first.alias("first"), F.when(F.col("one"), 0).otherwise(F.col("q") - 1).alias("last"))
    met = rows.join(parts.select("cluster"), "cluster", "left_semi").join(place, "owner").withColumn("o", F.explode(F.sequence("first", "last")))
    return met.select("cluster", F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "owner", "size", "keys")


def class_links(docs: DataFrame, tile: int = TILE, text: str = "text", sets: Sets | None = None, pair_tile: int | None = None) -> DataFrame:
    """(node, root) for the set classes that link with another: root is the least class name of the component."""
    sets = Sets(set_table(docs, text=text)) if sets is None else sets
    total = sets.classes.agg(F.sum("n")).first()[0] or 0
    blocks, buckets = max(1, -(-total // BLOCK)), max(1, -(-total // BUCKET))
    postings = _postings(docs.select(F.col(text).alias("text")), blocks, buckets, sets.shared)
    shared = postings.groupBy("to").applyInArrow(lambda t: _screen_block(t, buckets), _PACKED_SQL)
    candidates = materialize(shared.groupBy("to").applyInArrow(_gather, _CLASS_SQL), "join-candidates")
    parts = _parts(candidates, "keys")
    counted = _spread(candidates, "keys", parts).groupBy("to").applyInArrow(lambda t: _count_part(t, parts), _PACKED_SQL)
    rows = materialize(counted.groupBy("to").applyInArrow(_prefix, _CLASS_SQL), "join-rows")
    near = _spread(rows, "rare", _parts(rows, "rare")).groupBy("to").applyInArrow(_part_edges, "a long, b long")
    clusters = least_labels(near, "join-clusters")
    slim = rows.select("owner", F.length("keys").alias("w")).join(clusters.select(F.col("node").alias("owner"), F.col("root").alias("cluster")), "owner")
    slim = materialize(slim, "join-members")
    placed = _dealt(slim.select("owner", "cluster"), _tiles(slim, tile), 0)
    dealt = materialize(rows.select("owner", "size", "keys").join(placed, "owner").select("cluster", "tiles", "i", "owner", "size", "keys"), "join-dealt")
    linked = materialize(_linked(dealt, "tiles", "i"), "join-edges")
    whole = dealt.filter("tiles > 1").select("cluster", "owner", "size", "keys")
    weight = whole.agg(F.sum(F.length("keys"))).first()[0]
    if not weight:
        return least_labels(_edges(linked), "join-links")
    edges = _edges(linked).unionByName(_linked_heads(linked, weight, tile))
    apart = _apart(whole, least_labels(edges, "join-parts"), pair_tile or max(tile, PAIR_TILE))
    return least_labels(edges.unionByName(_edges(_linked(apart, "lo", "hi"))), "join-links")


def _rooted(docs: DataFrame, sets: Sets, tile: int, text: str, pair_tile: int | None = None) -> DataFrame:
    """owner, root, first: the set classes with the class that names their component and their row of least (doc_id, row_key), null ids last."""
    links = class_links(docs, tile, text, sets, pair_tile)
    return sets.classes.filter("n > 0").select("owner", "first").join(links.select(F.col("node").alias("owner"), "root"), "owner", "left").withColumn("root", F.coalesce("root", "owner"))


def similarity_components(docs: DataFrame, tile: int = TILE, doc_id: str = "doc_id", text: str = "text", pair_tile: int | None = None) -> DataFrame:
    """doc_id, row_key, n_shingles, owner (set class), component_id: one row per input row."""
    sets = Sets(set_table(docs, doc_id, text))
    classes = _rooted(docs, sets, tile, text, pair_tile)
    least = classes.groupBy("root").agg(F.min("first")["doc_id"].alias("component_id"))
    ids = classes.join(least, "root").select("owner", "component_id")
    out = sets.rows.join(ids, "owner", "left")
    return out.select("doc_id", "row_key", "n_shingles", "owner", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays, that with the least doc_id (then the least text hash); all columns are kept.

    A component goes by its root class, as ids may be null or repeat. Texts without words link with nothing.
    """
    names = [f"__d{i}" for i in range(len(docs.columns))]
    whole, at = docs.toDF(*names), dict(zip(docs.columns, names, strict=True))
    sets = Sets(set_table(docs, doc_id, text))
    linked = _rooted(docs, sets, TILE, text).groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.row_key")
    kept = linked.unionByName(sets.rows.filter("n_shingles = 0").select("doc_id", "row_key"))
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).distinct()
    rows = whole.withColumn("__id", F.col(at[doc_id]).cast("long")).withColumn("__key", F.xxhash64(F.col(at[text]).cast("string")))
    keys = [F.coalesce("__id", F.lit(0).cast("long")).alias("__a"), F.col("__id").isNull().alias("__b")]
    rows, kept = rows.select("*", *keys), kept.select("__key", *keys)
    found = rows.join(kept, ["__a", "__b", "__key"], "left_semi").dropDuplicates(["__a", "__b", "__key"])
    return found.select(*[F.col(n).alias(c) for c, n in at.items()])
