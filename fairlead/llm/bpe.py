"""Byte-level BPE over public vocabulary files: encoding by a pair occurrence index, decoding, exact prefix counts.

The splitter and the merges follow the file's own rules; nothing is trained and no tokenizer library is called.
Null text counts as empty. Invalid UTF-8 is read with replacement characters. Output keeps one row per input row.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fairlead.llm.common import SpanHasher, slices

#: Fixed value: how the byte-level family splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space inside or at the end of a run of white space: the splitter's run goes on over its front.
SPACE_IN_RUN = re.compile(r" (?<=\s )(?:\s|\Z)")

#: Pretokens whose result a worker keeps between batches.
KEPT_PRETOKENS = 500_000
#: Positions that one occurrence index covers, so that its memory is bounded whatever the partition holds.
INDEX_BYTES = 1 << 20
#: Text that is split and encoded together; its distinct pretokens share one index.
TEXT_BYTES = 1 << 21
_PAIR = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable bytes stand for themselves, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        tokens: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*tokens.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in tokens.items():
            self.bytes_of[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.byte_id = [0] * 256
        for i, raw in enumerate(self.bytes_of):
            if len(raw) == 1:
                self.byte_id[raw[0]] = i
        #: pair -> (rank, merged token)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[tokens[a] * _PAIR + tokens[b]] = (rank, tokens[a + b])
        self.by_rank = [(k // _PAIR, k % _PAIR, v[1]) for k, v in sorted(self.merges.items(), key=lambda kv: kv[1][0])]
        self.id_of = {raw: i for i, raw in enumerate(self.bytes_of) if raw and i not in self.special.values()}
        self.longest = max(map(len, self.id_of))
        self._splitter = regex.compile(SPLIT)
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.encoded: dict[str, bytes] = {}
        self.counted: dict[str, int] = {}
        self._joins: dict[int, bool] = {}
        self._byte_ids = np.array(self.byte_id, np.int32)
        keys = np.array(list(self.merges), np.int64)
        order = np.argsort(keys)
        self._pair_keys = keys[order]
        self._pair_ranks = np.array([r for r, _ in self.merges.values()], np.int32)[order]
        self._token_hashes: np.ndarray | None = None
        #: The rank that makes each token, and the two tokens it is made of.
        self._made, self._left_part, self._right_part = (np.full(size, -1, np.int32) for _ in range(3))
        for rank, (a, b, c) in enumerate(self.by_rank):
            self._made[c], self._left_part[c], self._right_part[c] = rank, a, b

    # -- splitting -------------------------------------------------------------------------------------------
    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Runs of ordinary text and special tokens in order: (text, special id or None)."""
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def split(self, text: str) -> list[str]:
        if self._special is None or self._special.search(text) is None:
            return self._splitter.findall(text)
        out: list[str] = []
        for part, special in self.segments(text):
            if special is None:
                out += self._splitter.findall(part)
            else:
                out.append(part)
        return out

    # -- encoding --------------------------------------------------------------------------------------------
    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair never merges."""
        keys = left.astype(np.int64) * _PAIR + right
        at = np.minimum(np.searchsorted(self._pair_keys, keys), len(self._pair_keys) - 1)
        return np.where((self._pair_keys[at] == keys) & (left >= 0) & (right >= 0), self._pair_ranks[at], -1)

    def index_encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode all pieces together: one index from each adjacent pair to its positions, ranks applied in ascending order.

        The symbols of all pieces stand in one linked list with a stop around each piece. A heap holds the ranks that
        still have positions. Of a rank's positions, those whose pair has changed since they were listed are skipped;
        the others merge at once, from the left where they overlap, and the two pairs that each merge makes are added
        to the lists of their own ranks. Returns (ids of all pieces, ends of the pieces in it).
        """
        raw = np.frombuffer(b"\0".join([b"", *pieces, b""]), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.concatenate([[0], np.cumsum(sizes + 1)])
        symbol = self._byte_ids[raw]
        symbol[stops] = -1
        n = len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def put(ranks: np.ndarray, places: np.ndarray) -> None:
            keep = ranks >= 0
            ranks, places = ranks[keep], places[keep]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            lo = 0
            for hi, r in zip([*cuts.tolist(), len(ranks)], ranks[np.concatenate([[0], cuts])].tolist(), strict=True):
                if r in where:
                    where[r].append(places[lo:hi])
                else:
                    where[r] = [places[lo:hi]]
                    heapq.heappush(active, r)
                lo = hi

        put(self._ranks(symbol[:-1], symbol[1:]), np.arange(n - 1, dtype=np.int32))
        while active:
            rank = heapq.heappop(active)
            a, b, merged = self.by_rank[rank]
            found = where.pop(rank)
            i = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            j = after[i]
            live = (symbol[i] == a) & (symbol[j] == b)
            if not live.all():
                i, j = i[live], j[live]
            if a == b and len(i) > 1:
                taken, keep = -1, []
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    keep.append(x != taken)
                    taken = y if keep[-1] else taken
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            k = after[j]
            symbol[i], symbol[j] = merged, -2
            after[i], before[k] = k, i
            h = before[i]
            put(self._ranks(np.concatenate([symbol[h], symbol[i]]), np.concatenate([symbol[i], symbol[k]])), np.concatenate([h, i]))
        alive = np.flatnonzero(symbol != -2)
        stop = symbol[alive] == -1
        ends = np.flatnonzero(stop)
        return symbol[alive[~stop]], ends[1:] - np.arange(1, len(ends))

    def _chunks(self, texts: list[str]) -> tuple[list[list[str]], set[str]]:
        """Texts cut before each space, where that cannot change how the splitter reads them; else by the splitter.

        A pretoken holds a space only at its front or in a run of white space. A space that begins such a run, or ends
        it before another character, begins a pretoken anyway; texts with a space elsewhere in a run of any white space
        or with special strings go whole.
        """
        out, distinct = [], set()
        for t in texts:
            if SPACE_IN_RUN.search(t) is not None or (self._special is not None and self._special.search(t) is not None):
                parts = self.split(t)
            else:
                parts = t.replace(" ", "\0 ").split("\0") if "\0" not in t else self.split(t)
            out.append(parts)
            distinct.update(parts)
        return out, distinct

    def _new(self, parts: Iterable[str], known: dict) -> dict[str, list[str]]:
        """Pretokens of the chunks that are not known; a kept table that has grown past its bound starts anew."""
        new = [p for p in parts if p not in known]
        if len(known) + len(new) > KEPT_PRETOKENS:
            known.clear()
            new = list(parts)
        return {p: [p] if self._plain(p) else self.split(p) for p in new}

    @staticmethod
    def _plain(part: str) -> bool:
        """Whether a chunk is ASCII letters or digits alone, after one space or none: the splitter keeps it whole."""
        core = part[1:] if part[:1] == " " else part
        return core.isascii() and (core.isalpha() or core.isdigit())

    def learn(self, parts: Iterable[str]) -> None:
        """Make `encoded` hold every given chunk."""
        new = self._new(parts, self.encoded)
        pretokens = list({x for p in new.values() for x in p if x not in self.special})
        ids_of = {text: np.array([i], np.uint32).tobytes() for text, i in self.special.items()}
        at = 0
        while at < len(pretokens):
            size, block = 0, []
            while at < len(pretokens) and (not block or size < INDEX_BYTES):
                block.append(pretokens[at].encode("utf-8", "surrogatepass"))
                size += len(block[-1])
                at += 1
            ids, ends = self.index_encode(block)
            raw, lo = ids.astype("<u4").tobytes(), 0
            for p, hi in zip(pretokens[at - len(block) : at], (ends * 4).tolist(), strict=True):
                ids_of[p] = raw[lo:hi]
                lo = hi
        for p, own in new.items():
            self.encoded[p] = ids_of[own[0]] if len(own) == 1 else b"".join([ids_of[x] for x in own])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces, distinct = self._chunks(texts)
        self.learn(distinct)
        of = self.encoded.__getitem__
        return [b"".join(map(of, p)) for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the decoded text; byte runs that are not UTF-8 come out as U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw

    # -- prefix counts ---------------------------------------------------------------------------------------
    def _adjacent(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges leave each two tokens side by side.

        The merges inside both tokens are undone from the latest to the first, so that every pair of symbols that ever
        met at the border is seen. Such a pair would have merged if its rank came before the merges that took its left
        and its right symbol; of equal ranks the left place merges first.
        """
        keys, back = np.unique(left.astype(np.int64) * _PAIR + right, return_inverse=True)
        x, y = (keys // _PAIR).astype(np.int32), (keys % _PAIR).astype(np.int32)
        never = np.int32(1 << 30)
        taken_x, taken_y = np.full(len(keys), never), np.full(len(keys), never)
        good, at = np.ones(len(keys), bool), np.arange(len(keys))
        while len(at):
            rank = self._ranks(x, y)
            bad = (rank >= 0) & (rank < taken_x) & (rank <= taken_y)
            good[at[bad]] = False
            made_x, made_y = self._made[x], self._made[y]
            go = ~bad & ((made_x >= 0) | (made_y >= 0))
            at, x, y, taken_x, taken_y, made_x, made_y = (v[go] for v in (at, x, y, taken_x, taken_y, made_x, made_y))
            undo_x = made_x > made_y
            taken_x, taken_y = np.where(undo_x, made_x, taken_x), np.where(undo_x, taken_y, made_y)
            x, y = np.where(undo_x, self._right_part[x], x), np.where(undo_x, y, self._left_part[y])
        return good[back]

    def prefix_table(self, raw: bytes) -> list[int]:
        """Token count of raw[:i] as one pretoken, for i from 0 to its length.

        The last token of raw[:i] is the one token that ends there and may stand after the last token of what is
        before it; the merges make it unique. So each prefix takes its count from a shorter one plus one.
        """
        n = len(raw)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        id_of, joins, longest = self.id_of, self._joins, self.longest
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                t = id_of.get(raw[j:i])
                if t is None:
                    continue
                if j and (ok := joins.get(last[j] * _PAIR + t)) is None:
                    if len(joins) > 200_000:
                        joins.clear()
                    ok = joins[last[j] * _PAIR + t] = bool(self._adjacent(np.array([last[j]]), np.array([t]))[0])
                if not j or ok:
                    last[i], count[i] = t, count[j] + 1
                    break
        return count

    def prefix_tables(self, pieces: list[bytes]) -> list[np.ndarray]:
        """prefix_table of many short pieces at once."""
        count, sizes = self._prefix_matrix(pieces)
        return [count[: n + 1, k] for k, n in enumerate(sizes.tolist())]

    def _prefix_matrix(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, a row a position and a column a piece; sizes), filled position by position over all pieces."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        span = SpanHasher(data)
        width = int(sizes.max(initial=0))
        last = np.full((width + 1, len(pieces)), -1, np.int32)
        count = np.zeros((width + 1, len(pieces)), np.int32)
        for i in range(1, width + 1):
            rows = np.flatnonzero(sizes >= i)
            for j in range(max(0, i - self.longest), i):
                if not len(rows):
                    break
                token = self._token_at(span, starts[rows] + j, starts[rows] + i)
                ok = token >= 0
                if j:
                    some = np.flatnonzero(ok)
                    ok[some] = self._adjacent(last[j, rows[some]], token[some])
                hit = rows[ok]
                last[i, hit], count[i, hit] = token[ok], count[j, hit] + 1
                rows = rows[~ok]
        return count, sizes

    def _token_at(self, span: SpanHasher, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._token_hashes is None:
            ids = np.array(list(self.id_of.values()), np.int32)
            raw = list(self.id_of)
            ends = np.cumsum([len(x) for x in raw])
            hashes = SpanHasher(np.frombuffer(b"".join(raw), np.uint8))(np.concatenate([[0], ends[:-1]]), ends)
            order = np.argsort(hashes)
            self._token_hashes, self._token_ids = hashes[order], ids[order]
            self._seen_hashes = np.zeros(1 << 20, bool)
            self._seen_hashes[hashes >> np.uint64(44)] = True
        h = span(start, end)
        out = np.full(len(h), -1, np.int32)
        some = np.flatnonzero(self._seen_hashes[h >> np.uint64(44)])  # most spans are no token
        h = h[some]
        at = np.minimum(np.searchsorted(self._token_hashes, h), len(self._token_hashes) - 1)
        out[some] = np.where(self._token_hashes[at] == h, self._token_ids[at], -1)
        return out

    def count_batch(self, texts: list[str]) -> list[int]:
        """Token count of each whole text: the sum of the last prefix counts of its pretokens."""
        pieces, distinct = self._chunks(texts)
        counted = self.counted
        new = self._new(distinct, counted)
        totals: dict[str, int] = dict.fromkeys(self.special, 1)
        classes: dict[int, list[str]] = {}
        for p in {x for own in new.values() for x in own if x not in self.special}:
            raw = len(p.encode("utf-8", "surrogatepass"))
            if raw > 64:
                totals[p] = self.prefix_table(p.encode("utf-8", "surrogatepass"))[-1]
            else:
                classes.setdefault(-(-raw // 8), []).append(p)
        for own in classes.values():
            for lo in range(0, len(own), 50_000):
                block = own[lo : lo + 50_000]
                count, sizes = self._prefix_matrix([p.encode("utf-8", "surrogatepass") for p in block])
                totals.update(zip(block, count[sizes, np.arange(len(block))].tolist(), strict=True))
        for p, own in new.items():
            counted[p] = totals[own[0]] if len(own) == 1 else sum(map(totals.__getitem__, own))
        return [sum(map(counted.__getitem__, p)) for p in pieces]

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token count of text[:i] for every i, as if that prefix alone were encoded.

        A prefix ends inside at most one pretoken. Three cases differ from that pretoken's own prefix counts: white
        space at the end is one pretoken with the white space before it; a contraction cut short is an apostrophe and
        letters; a special string cut short is ordinary text.
        """
        out = np.zeros(len(text) + 1, np.int64)
        at = 0
        ordinary, tail = "", 0
        for part, special in self.segments(text):
            if special is None:
                tail = self._segment_counts(part, int(out[at]), out, at)
            else:
                for i in range(1, len(part)):  # a few characters, whatever the text before them
                    joined = self._splitter.findall(ordinary[tail:] + part[:i])
                    out[at + i] = out[at - len(ordinary) + tail] + sum(self.prefix_table(p.encode("utf-8", "surrogatepass"))[-1] for p in joined)
                out[at + len(part)] = out[at] + 1
            ordinary, tail = (part, tail) if special is None else ("", 0)
            at += len(part)
        return out

    def _segment_counts(self, part: str, base: int, out: np.ndarray, at: int) -> int:
        """Counts of the prefixes of a segment without special strings; returns where its last pretoken that is no white space starts.

        Each pretoken and each run of white space is counted once, by one table over the whole of it.
        """
        blank: list[int] | None = None  # counts of the prefixes of the white space that ends here
        blank_from = i = tail = 0
        blank_base = total = base
        for p in self._splitter.findall(part):
            raw = p.encode("utf-8", "surrogatepass")
            table = self.prefix_table(raw)
            if regex.match(r"\s", p):  # white space, or one space before a word
                if blank is None:
                    end = regex.match(r"\s+", part, pos=i).end()
                    blank = self.prefix_table(part[i:end].encode("utf-8", "surrogatepass"))
                    blank_from, blank_base = i, total
                    blank_sizes = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in part[i:end]])
            size, white = 0, True
            for k, c in enumerate(p, 1):
                size += len(c.encode("utf-8", "surrogatepass"))
                white = white and bool(regex.match(r"\s", c))
                if white:
                    out[at + i + k] = blank_base + blank[int(blank_sizes[i + k - blank_from - 1])]
                elif p[0] == "'" and 2 == k < len(p) and p[1].isalpha():
                    out[at + i + k] = total + self.prefix_table(b"'")[-1] + self.prefix_table(p[1].encode())[-1]
                else:
                    out[at + i + k] = total + table[size]
            if not white:
                blank, tail = None, i
            i += len(p)
            total += table[-1]
        return tail


_OPEN: dict[str, Vocabulary] = {}


def located(path: str) -> str:
    """A path as it is; a bare name as this machine's public_tokenizers has it."""
    if os.path.dirname(path):
        return path
    import public_tokenizers

    return str(public_tokenizers.path(path))


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a path and Python worker."""
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(located(path))
    return _OPEN[path]


def _texts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def bpe_encode(docs: DataFrame, vocab_path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    One row per input row, repeated doc_ids included; null text encodes as the empty text; an empty table gives none.
    Only doc_id and text are read, so other columns never clash.
    """
    from pyspark.sql import functions as F

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            for rows, data, offsets in slices(batch, most=TEXT_BYTES):
                texts = _texts(data, offsets)
                once = dict.fromkeys(texts)  # copies that stand together, as a mixture's do, are encoded once
                for t, x in zip(once, vocab.encode_batch(list(once)), strict=True):
                    once[t] = (x, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(vocab.decode(x)).hexdigest())
                ids, n, own, decoded = zip(*map(once.__getitem__, texts), strict=True)
                cols = [rows.column(0), pa.array(n, pa.int64()), pa.array(own), pa.array(decoded)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f for f, _ in fields)])

    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>"}
    schema = "doc_id long, " + ", ".join(f"{f} {kinds[f]}" for f, _ in fields)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit by prefix dynamic programming; same cases as bpe_encode."""
    from pyspark.sql import functions as F

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            for rows, data, offsets in slices(batch, most=TEXT_BYTES):
                n = vocab.count_batch(_texts(data, offsets))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def truncation_points(docs: DataFrame, vocab_path: str, budgets: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row and token budget the longest prefix that fits: doc_id, budget, n_chars, n_tokens. Reads the prefix counts; nothing is encoded again."""
    from pyspark.sql import functions as F

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            for rows, data, offsets in slices(batch, most=TEXT_BYTES):
                out = []
                for i, t in zip(rows.column(0).to_pylist(), _texts(data, offsets), strict=True):
                    counts = vocab.prefix_counts(t)
                    for b in budgets:
                        k = int(np.flatnonzero(counts <= b)[-1])
                        out.append((i, b, k, int(counts[k])))
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "budget", "n_chars", "n_tokens"), r, strict=True)) for r in out], schema=pa.schema([("doc_id", pa.int64()), ("budget", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64())]))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, budget long, n_chars long, n_tokens long")
