"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, told apart by their path of tags and classes, and its blocks of text, told apart by
their path and words. Tokens with the same occurrence vector over the pages of a host form an equivalence class.

1. Classes: only tokens that stand once on each of their pages, on at least `support` of the host's pages, and in a class
   of two or more count. The class on most pages is the root.
2. Validity: on every page a class's tokens stand in one order; a token that breaks it leaves its class. A token belongs
   to one slot of the root, the place between two of the root's tokens, on every page; so classes are nested in the root,
   and a class that spans several slots falls apart into one class a slot. Classes of one token that are left go.
3. Template: the text tokens of valid classes are template text. The template's elements hold each other; from the
   outermost one the article is sought inwards, into a child that leaves no text of its own outside, or an article or
   main element with half of the text, or the child with the page's h1 if what it leaves is under a fifth.
4. Slots: what is inside that element, is no template text and not in a part that HTML or ARIA sets apart (navigation,
   forms, asides, footers and the like, and articles inside an article, which are comments), is the page's text. Class
   names only tell elements apart; none has a meaning.

A page that lacks the element, or whose host has fewer than `least_pages` pages, is read by its own elements in the same
way. A page most of whose article would be template text is a copy of others and keeps it.

Null html counts as empty and gives an empty text; a null or odd url is a host of its own kind, named ''; repeated rows
are pages of their own; an empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import materialize

#: HTML's void, raw-text and block elements, elements and ARIA roles that HTML sets apart from an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript iframe template svg math".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"br", "option", "body", "html", "head", "title", "tbody", "tr", "td", "th", "thead", "tfoot", "caption"}
APART = frozenset("nav footer aside form menu button select dialog head title object search".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog status menu menubar toolbar comment".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A host with more than one in HOT_SHARE of the pages is hot: at most HOT_SHARE hosts are, and their templates are
#: broadcast if they have at most HOT_TOKENS tokens together.
HOT_SHARE, HOT_TOKENS = 1000, 4_000_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
LETTERS = re.compile(r"[a-z0-9]+")


class Element:
    """An open element: `apart` and `links` are inherited, `order` is its place among the page's tokens."""

    __slots__ = ("name", "path", "above", "apart", "in_main", "links", "block", "order")

    def __init__(self, name: str, path: int, above: Element | None, apart: bool, in_main: bool, links: bool, order: int):
        self.name, self.path, self.above, self.apart, self.in_main, self.links, self.order = name, path, above, apart, in_main, links, order
        self.block = self if name in BLOCK or above is None else above.block

    def lineage(self):
        e = self
        while e is not None:
            yield e
            e = e.above


class Block:
    """A run of text between block boundaries: pieces (text, element), token, and place among the page's tokens."""

    __slots__ = ("pieces", "token", "order")

    def __init__(self, order: int):
        self.pieces: list[tuple[str, Element | None]] = []
        self.order = order

    def close(self) -> bool:
        words = " ".join("".join(t for t, _ in self.pieces).split())
        e = self.pieces[0][1]
        self.token = xxhash.xxh64_intdigest(f"{e.block.path if e else 0}|{words}") >> 1
        return bool(words)


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements and blocks of text, in page order.

    Void and raw elements hold nothing; a block closes an open paragraph; an end tag closes up to its start tag and is
    passed over if there is none.
    """
    elements: list[Element] = []
    blocks: list[Block] = []
    stack: list[Element] = []
    at, n, count = 0, len(page), 0
    now: Block | None = None

    def text(s: str) -> None:
        nonlocal now, count
        if now is None:
            if s.isspace():
                return
            now, count = Block(count), count + 1
        now.pieces.append((s, stack[-1] if stack else None))

    def boundary() -> None:
        nonlocal now
        if now is not None and now.close():
            blocks.append(now)
        now = None

    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            text(page[at:stop])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK or name in RAW:
            boundary()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in VOID:
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in BLOCK:
                    break
        if name == "li":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == "li":
                    del stack[k:]
                    break
                if stack[k].name in ("ul", "ol", "menu"):
                    break
        words, role = [], ""
        for a in ATTRIBUTE.finditer(m[3]) if m[3] else ():
            value = (a[2] or a[3] or a[4] or "").lower()
            words += (w for w in LETTERS.findall(value) if not w.isdigit())
            role = value.strip() if a[1].lower() == "role" else role
        above = stack[-1] if stack else None
        path = xxhash.xxh64_intdigest(f"{above.path if above else 0}/{name}.{'.'.join(words)}") >> 1
        in_main = bool(above and above.in_main) or name in MAIN or role == "main"
        apart = bool(above and above.apart) or name in APART or role in APART_ROLES or name == "header" and not in_main
        e = Element(name, path, above, apart, in_main, bool(above and above.links) or name == "a", count)
        count += 1
        elements.append(e)
        stack.append(e)
    boundary()
    return elements, blocks


def _comments(elements: list[Element], blocks: list[Block]) -> frozenset[Element]:
    """Articles inside an article with less text than it has itself."""
    inner = [e for e in elements if e.name == "article" and not e.apart and any(x.name == "article" for x in e.lineage() if x is not e)]
    if not inner:
        return frozenset()
    held: Counter = Counter()
    for b in blocks:
        for t, e in b.pieces:
            nearest = next((x for x in e.lineage() if x.name == "article"), None) if e and not e.apart else None
            held[nearest] += len(t)
    outer = lambda e: next(x for x in e.above.lineage() if x.name == "article")
    of: defaultdict = defaultdict(int)
    for e in inner:
        of[outer(e)] += held[e]
    return frozenset(e for e in inner if of[outer(e)] < held[outer(e)])


def _own(e: Element | None, comments: frozenset[Element]) -> bool:
    """Whether text in an element may belong to an article."""
    return e is None or not e.apart and not (comments and any(x in comments for x in e.lineage()))


def _inward(inside: dict, name: dict, chars: dict, headed: set):
    """The element that holds the article: from the whole page (None) into one child after another.

    A child is entered if it leaves no text outside, if it is the first article or main element on the way and has half of
    the text, or if the h1 is in it and it leaves under a fifth.
    """
    now = None
    while inside.get(now):
        child = max(inside[now], key=chars.__getitem__)
        out = chars[now] - chars[child]
        semantic = name[child] in MAIN and name.get(now) not in MAIN and 2 * chars[child] >= chars[now]
        if not chars[child] or out and not semantic and not (child in headed and 5 * out < chars[now]):
            break
        now = child
    return now


_PAGE = 0
_TOKENS = pa.schema([("host", pa.string()), ("token", pa.int64()), ("kind", pa.string()), ("above", pa.int64()), ("at", pa.int64()), ("once", pa.int64()), ("v1", pa.int64()), ("v2", pa.int64())])


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row per page and token: host, token, kind (tag of an element, '' for text, 'page'), above (token of the element around it), at, once, v1, v2.

    The sums of v1 and v2 over a token's rows, hashes of (page, occurrences), stand for its occurrence vector.
    """

    def run(batches):
        for batch in batches:
            out = []
            for key, host, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                elements, blocks = parse(page or "")
                seen: dict[int, list] = {_PAGE: [1, "page", 0, 0]}
                for b in blocks:
                    e = b.pieces[0][1]
                    seen.setdefault(b.token, [0, "", e.block.path if e else 0, b.order])[0] += 1
                for e in elements:
                    seen.setdefault(e.path, [0, e.name, e.above.path if e.above else 0, e.order])[0] += 1
                for token, (n, kind, above, order) in seen.items():
                    v = xxhash.xxh64_intdigest(f"{key}:{n}")
                    out.append((host, token, kind, above, order, int(n == 1), v >> 32, v & 0xFFFFFFFF))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TOKENS, strict=True)], schema=_TOKENS)

    return pages.select(F.xxhash64("page_id", "url", "html").alias("key"), "host", "html").mapInArrow(run, "host string, token long, kind string, above long, at long, once long, v1 long, v2 long")


def classes(pages: DataFrame, support: float = 0.5, least_pages: int = 3) -> DataFrame:
    """host, pages, tokens (class, place, token, kind, above), one row a host: its classes of tokens that stand once a page.

    Tokens are counted over all pages of a host with a map-side sum. Only those on `support` of the pages are gathered, so
    a host's row is bounded by the tokens of 1 / support pages. `class` 0 is the root.
    """
    counted = page_tokens(pages).groupBy("host", "token", "kind", "above").agg(F.count("*").alias("n"), F.sum("once").alias("once"), F.sum("at").alias("at"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"))
    counted = materialize(counted.filter(f"n >= {least_pages} or kind = 'page'"), "html-tokens")
    hosts = counted.filter("kind = 'page'").select("host", F.col("n").alias("pages"))
    often = counted.filter("kind <> 'page' and once = n").join(hosts, "host").filter((F.col("n") >= support * F.col("pages")) & (F.col("n") >= least_pages))
    alike = often.groupBy("host", "pages", "n", "v1", "v2").agg(F.collect_list(F.struct((F.col("at") / F.col("n")).alias("place"), "token", "kind", "above")).alias("t")).filter(F.size("t") > 1)
    listed = alike.groupBy("host", "pages").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.size("t")).alias("size"), "v1", "v2", "t"))).alias("c"))
    tokens = F.flatten(F.transform("c", lambda c, i: F.transform(c["t"], lambda t: F.struct(i.alias("class"), t["place"].alias("place"), t["token"].alias("token"), t["kind"].alias("kind"), t["above"].alias("above")))))
    return materialize(listed.select("host", "pages", F.array_sort(tokens).alias("tokens")), "html-classes")


_SEEN = pa.schema([("host", pa.string()), ("token", pa.int64()), ("slot", pa.int64()), ("n", pa.int64()), ("bad", pa.int64()), ("chars", pa.int64()), ("h1", pa.int64())])


def _look(page: str, tokens: list[dict], seen: dict[tuple[int, int], list[int]]) -> None:
    """Add to seen[token, slot]: pages, breaks of its class's order, text of its own kind inside an element, and h1 inside."""
    elements, blocks = parse(page)
    found = {b.token: b.order for b in blocks}
    found.update({e.path: e.order for e in elements})
    root = sorted(found[t["token"]] for t in tokens if t["class"] == 0 and t["token"] in found)
    known = {t["token"] for t in tokens}
    comments = _comments(elements, blocks)
    held: Counter = Counter()
    for b in blocks:
        if b.token in known:
            continue
        for text, e in b.pieces:
            if _own(e, comments) and not (e and e.links):
                size = len(text) - text.count(" ")
                held[_PAGE] += size
                for x in e.lineage() if e else ():
                    held[x.path] += size
    seen.setdefault((_PAGE, -1), [0, 0, 0, 0])[2] += held[_PAGE]
    h1 = {x.path for e in elements if e.name == "h1" and not e.apart for x in e.lineage()}
    last: dict[int, int] = {}
    for t in tokens:
        at = found.get(t["token"])
        if at is None:
            continue
        slot = -1 if t["class"] == 0 else sum(1 for r in root if r < at)
        row = seen.setdefault((t["token"], slot), [0, 0, 0, 0])
        row[0] += 1
        row[1] += at < last.get(t["class"], -1)
        last[t["class"]] = max(at, last.get(t["class"], -1))
        row[2] += held[t["token"]]
        row[3] += t["token"] in h1


def settle(tokens: list[dict], seen: dict[int, list[tuple[int, int, int, int, int]]]) -> tuple[list[int], list[int]]:
    """(token of the element that holds the article or none, tokens of template text) of a host's classes.

    seen[token] lists (slot, pages, breaks, chars, pages with h1 inside).
    """
    groups: defaultdict = defaultdict(list)
    for t in tokens:
        rows = seen.get(t["token"], [])
        if len(rows) == 1 and not rows[0][2]:
            groups[t["class"], rows[0][0]].append(t)
    valid = [t for g in groups.values() if len(g) > 1 for t in g]
    inside: defaultdict = defaultdict(list)
    for t in valid:
        if t["kind"]:
            inside[t["above"]].append(t)
    name = {t["token"]: t["kind"] for t in valid if t["kind"]}
    inside: defaultdict = defaultdict(list)
    for t in sorted(valid, key=lambda t: t["place"]):
        if t["kind"]:
            inside[t["above"] if t["above"] in name else None].append(t["token"])
    pages, chars, h1 = ({t: sum(r[i] for r in rows) for t, rows in seen.items()} for i in (1, 3, 4))
    main = _inward(inside, name, {None: chars.get(_PAGE, 0), **chars}, {t for t in name if h1[t] == pages[t]})
    return ([] if main is None else [main]), [t["token"] for t in valid if not t["kind"]]


def _with_template(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with the columns of their host's row in `found`, which has `pages` and `tokens`; none is lost.

    The rows of hot hosts are broadcast after a check of their size, so no task has to take all pages of a large host;
    others are joined by host, each with at most one page in HOT_SHARE.
    """
    of = found.agg(F.sum("pages")).first()[0] or 0
    hot = found.filter(F.col("pages") * HOT_SHARE > of)
    if (hot.agg(F.sum(F.size("tokens"))).first()[0] or 0) > HOT_TOKENS:
        return pages.join(found, "host", "left")
    rest = pages.join(F.broadcast(hot.select("host")), "host", "left_anti").join(found, "host", "left")
    return pages.join(F.broadcast(hot), "host").unionByName(rest)


def templates(pages: DataFrame, support: float = 0.5, least_pages: int = 3) -> DataFrame:
    """host, pages, main (element that holds the article), tokens (template text): one row a host with a template. `pages`: host, page_id, url, html."""
    found = classes(pages, support, least_pages)

    def look(batches):
        for batch in batches:
            seen: defaultdict = defaultdict(dict)
            for host, page, tokens in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if tokens:
                    _look(page or "", tokens, seen[host])
            out = [(host, token, slot, *row) for host, rows in seen.items() for (token, slot), row in rows.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SEEN, strict=True)], schema=_SEEN)

    looked = _with_template(pages.select("host", "html"), found).filter("tokens is not null").select("host", "html", "tokens").mapInArrow(look, "host string, token long, slot long, n long, bad long, chars long, h1 long")
    looked = looked.groupBy("host", "token", "slot").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "chars", "h1")])
    looked = looked.groupBy("host").agg(F.collect_list(F.struct("token", "slot", "n", "bad", "chars", "h1")).alias("seen"))

    def run(batches):
        for batch in batches:
            out = []
            for host, n, tokens, rows in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                seen: defaultdict = defaultdict(list)
                for r in rows:
                    seen[r["token"]].append((r["slot"], r["n"], r["bad"], r["chars"], r["h1"]))
                main, fixed = settle(tokens, seen)
                out.append((host, n, main[0] if main else None, sorted(fixed)))
            if out:
                types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["host", "pages", "main", "tokens"])

    return found.join(looked, "host").select("host", "pages", "tokens", "seen").mapInArrow(run, "host string, pages long, main long, tokens array<bigint>")


def _holder(elements: list[Element], texts: list[tuple[str, Element | None]]) -> Element | None:
    """The element of a page that holds the article, by the page's own texts."""
    chars: Counter = Counter()
    for t, e in texts:
        chars[None] += len(t)
        for x in e.lineage() if e else ():
            chars[x] += len(t)
    inside: defaultdict = defaultdict(list)
    for e in elements:
        if chars[e]:
            inside[e.above].append(e)
    return _inward(inside, {e: e.name for e in elements}, chars, {x for e in elements if e.name == "h1" and not e.apart for x in e.lineage()})


def extract(page: str | None, main: int | None = None, fixed: frozenset[int] = frozenset()) -> str:
    """The text in the slots of a page's main element."""
    elements, blocks = parse(page or "")
    comments = _comments(elements, blocks)
    chosen = [e for e in elements if e.path == main and not e.apart] if main is not None else []
    if not chosen:
        own = [(t, e) for b in blocks if b.token not in fixed for t, e in b.pieces if not t.isspace() and _own(e, comments)]
        top = _holder(elements, [(t, e) for t, e in own if not (e and e.links) or any(x.name in HEADINGS for x in e.lineage())])
        chosen = [] if top is None else [top]
    tops = set(chosen)
    kept = []
    for b in blocks:
        text = "".join(entities.unescape(t) for t, e in b.pieces if _own(e, comments) and (not tops or e and not tops.isdisjoint(e.lineage())))
        text = " ".join(text.split())
        if text:
            kept.append((text, b.token in fixed))
    if 2 * sum(len(t) for t, f in kept if f) > sum(len(t) for t, _ in kept):
        return " ".join(t for t, _ in kept)
    return " ".join(t for t, f in kept if not f)


def extract_pages(pages: DataFrame, support: float = 0.5, least_pages: int = 3) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    found = materialize(templates(rows, support, least_pages), "html-templates")

    def run(batches):
        for batch in batches:
            text = [extract(h, m, frozenset(f or ())) for h, m, f in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return _with_template(rows, found).select("page_id", "url", "html", "main", "tokens").mapInArrow(run, "page_id long, url string, text string, n_chars long")
