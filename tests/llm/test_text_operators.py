import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairlead.llm import bpe, chat, exact_dedup, fingerprint, html_extract, mixing, quality, queries, toxicity

EDGE = [(1, "The cat  sat\n\n on it's mat <|endoftext|> end"), (2, None), (3, ""), (3, ""), (None, "é 日本 🎉 'll"), (4, "x" * 3000 + " y"), (4, "THE CAT"), (5, "the cat"), (6, " \t\n "), (2**60, "don't!<|endo")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, long words, and extra columns whose names clash with results and internals."""
    rows = [(i, t, "en", s, n, 9, 9, 9, "k") for (i, t), s, n in zip(EDGE, ["a", None, "b", "a", "a", "b", "a", None, "c", "a"], range(10), strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, size int, h int, kept string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.located(queries.vocab_path()))


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(queries.vocab_path())


def test_bpe_on_odd_rows(odd, library):
    want = sorted((str(i), len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in EDGE for e in [library.encode(t or "", add_special_tokens=False).ids])
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_encode(odd, queries.vocab_path()).collect())
    assert got == want
    counts = sorted((str(r.doc_id), r.n_tokens, r.n_bytes) for r in bpe.token_counts(odd, queries.vocab_path()).collect())
    assert counts == sorted((w[0], w[1], len((t or "").encode())) for w, (_, t) in zip([(str(i), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGE], EDGE, strict=True))
    empty = odd.limit(0)
    assert bpe.bpe_encode(empty, queries.vocab_path()).count() == 0 == bpe.token_counts(empty, queries.vocab_path()).count()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab e'tsrvlmd \n\tÉ日1!<|>endoftxAB🎉")), max_size=40))
def test_prefix_counts_are_those_of_each_prefix(vocab, library, text):
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert vocab.prefix_counts(text).tolist() == want
    assert vocab.count_batch([text]) == want[-1:]
    assert np.frombuffer(vocab.encode_batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_prefix_counts_take_time_in_proportion(vocab):
    """A run of white space is counted once, and text before a special string is not counted again for its characters."""
    import time

    def took(text):
        start = time.perf_counter()
        vocab.prefix_counts(text)
        return time.perf_counter() - start

    for make in (lambda n: "a" + " \u00a0" * n + "b", lambda n: "words and more " * n + "<|endoftext|>", lambda n: "x<|endoftext|>" * n):
        took(make(200))
        assert took(make(4000)) < 12 * took(make(1000)) + 0.2


def test_runs_of_mixed_white_space_are_the_librarys(vocab, library):
    runs = ["\u00a0 ", " \u00a0", " \u00a0 \u00a0 ", "\t ", " \t", "\t \t ", "\n \n", " \n \n ", "\n\n ", "  ", "   ", "\u3000 \u2028 ", "\x85 \x1c ", "\x1c \x1c"]
    texts = [f"{a}{r}{b}" for r in runs for a in ("", "a", "a b") for b in ("", "b", "b c", "\u00a0")]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in vocab.encode_batch(texts)] == want
    assert vocab.count_batch(texts) == [len(w) for w in want]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("a1.   \u00a0\t\n\u3000\x1c")), max_size=14))
def test_any_white_space_is_the_librarys(vocab, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(vocab.encode_batch([text])[0], "<u4").tolist() == want and vocab.count_batch([text]) == [len(want)]


def test_truncation_points(odd):
    got = {(r.doc_id, r.budget): (r.n_chars, r.n_tokens) for r in bpe.truncation_points(odd.filter("doc_id = 5"), queries.vocab_path(), [1, 100]).collect()}
    assert got == {(5, 1): (3, 1), (5, 100): (7, 2)}


def test_exact_dedup_on_odd_rows(odd):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(EDGE)
    groups = {}
    for i, t in EDGE:
        groups.setdefault((t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)), []).append(i)
    for t, ids in groups.items():
        own = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids) and {r.keep_id for r in own} == {keep} and {r.group_size for r in own} == {len(ids)}
        assert [r.doc_id for r in own if r.kept] == [keep]
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_directory_doubles_for_overfull_buckets(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h"))
    buckets = exact_dedup.directory(keys, 3).collect()
    assert sum(b["keys"] for b in buckets) == 4000 and max(b["keys"] for b in buckets) <= 3 and max(b.depth for b in buckets) > 2 * exact_dedup.STEP - 6
    hashes = [r.h & (2**64 - 1) for r in keys.collect()]
    held = [sum(h >> (64 - b.depth) == b.prefix for h in hashes) for b in buckets[:40]]
    assert held == [b["keys"] for b in buckets[:40]]
    assert [tuple(b) for b in exact_dedup.directory(keys, 4000).collect()] == [(0, 0, 4000)]


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_texts_that_share_a_key_are_told_apart_by_their_bytes(spark, hot_rows):
    """Every key is the text's length, so most chains hold several texts; the directory has pages of two keys."""
    r = np.random.default_rng(1)
    rows = [(int(i), "".join(r.choice(list("aB"), r.integers(0, 5))), int(r.integers(0, 9))) for i in r.integers(0, 40, 300)] + [(None, "aB", 1), (None, "Ab", 2), (None, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __h int")
    by_length = lambda c: F.xxhash64(F.length(c))
    groups = {}
    for d, t, _ in rows:
        groups.setdefault((t or "").lower(), []).append(d)
    want = []
    for t, ids in groups.items():
        keep, seen = max((i for i in ids if i is not None), default=None), False
        for i in ids:
            want.append((str(i), str(keep), len(ids), i == keep and not seen, hashlib.sha256(t.encode()).hexdigest()))
            seen = seen or i == keep
    got = exact_dedup.exact_dedup(df, key=by_length, page_keys=2, hot_rows=hot_rows).collect()
    assert sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.kept, x.text_sha256) for x in got) == sorted(want)
    kept = exact_dedup.keep_one(df, key=by_length, page_keys=2, hot_rows=hot_rows)
    assert kept.columns == df.columns and sorted(((x.text or "").lower(), str(x.doc_id)) for x in kept.collect()) == sorted((t, str(max((i for i in ids if i is not None), default=None))) for t, ids in groups.items())
    assert {tuple(x) for x in kept.collect()} <= {tuple(x) for x in rows}


def test_mixing_on_odd_rows(odd):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(EDGE) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(odd).collect()))
    total = sum({(r.source, r.source_size) for r in got} and dict((r.source, r.source_size) for r in got).values())
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total) and all(t <= 2 * s + 1e-9 for t, s in targets.values())
    assert mixing.mixed(odd).count() == sum(r.copies for r in got) and mixing.mixed(odd).columns == odd.columns
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_mixing_comes_near_its_targets(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(300)) + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.least(F.col("id") % 9, F.lit(3))).alias("source"))
    s = mixing.mix_sources(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(s) == 4 and all(abs(r.taken - r.target) <= 0.01 * r.target for r in s)


def test_mixing_of_one_size_and_source_is_dealt_into_parts_that_follow_the_count(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    for salt_rows, least in ((20_000, 30), (20, 130)):
        got = mixing.mix_sources(d, salt_rows=salt_rows)
        r = got.agg(F.sum("taken").alias("taken"), F.max("copies").alias("most"), F.count("*").alias("n")).first()
        assert abs(r.taken - 13_500) <= 3 and r.most == 2 and r.n == 3000
        light = mixing._sized(d, "doc_id", "text", "source")
        assert mixing._dealt(light, max(mixing.LEAST_SALTS, 3000 // salt_rows)).select("__salt").distinct().count() >= least


def test_chat_round_trip_with_parts(spark):
    p = lambda kind, text=None, ref=None, w=None, h=None, s=None, n=None: (kind, text, ref, w, h, s, n)
    odd = "a\\b <|im_end|>\n <\\| </s>[INST]<<SYS>>\\n"
    rows = [
        (1, 0, "us\ner\\n", [p("text", odd), p("image", None, "i.png", 28, 15), p("text", "x")]),
        (1, 1, "assistant", [p("audio", None, "a.wav", s=1.5), p("text", odd)]),
        (1, 1, "assistant", [p("text", None), p("document", None, "d.pdf", n=2)]),
        (2, None, None, None),
        (2, 5, "assistant", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    one = got[1]
    assert [t.role for t in one.turns] == ["us\ner\\n", "assistant", "assistant"]
    assert one.turns[0].text == odd + "<|image|>x"
    assert one.loss_text in ("<|audio|>" + odd + "<|document|>", "<|document|><|audio|>" + odd)
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments if a.kind == "image"] == [("image", "i.png", 4)]
    assert one.attachment_tokens == 4 + 38 + 1024
    assert one.formatted.count("<|im_start|>") == 3
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("assistant", "")] and got[2].loss_text == ""
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_reads_long_conversations_in_proportion_and_keeps_clashing_names_out(spark):
    """Four times the turns take well under the sixteen times of a reading from the start for each turn."""
    import time

    def took(turns):
        df = spark.range(turns).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.array(chat.text_part(F.repeat(F.lit("wörd "), 20))).alias("parts"), F.lit("x").alias("formatted"), F.lit(3).alias("nth"))
        start = time.perf_counter()
        r = chat.read_back(chat.format_conversations(df)).select(F.size("turns").alias("n"), F.length("loss_text").alias("k")).first()
        assert (r.n, r.k) == (turns, turns // 2 * 100)
        return time.perf_counter() - start

    took(1000)
    assert took(24_000) < 9 * took(6000) + 1


def test_fingerprints_against_the_texts(spark, odd):
    got = fingerprint.fingerprint_edits(odd).collect()
    order = sorted(((i, t or "") for i, t in EDGE), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(t) // 2
        want.setdefault(i, []).append((len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert fingerprint.fingerprint_edits(odd.limit(0)).count() == 0
    nulls = odd.filter("doc_id is null")
    assert fingerprint.fingerprint_edits(nulls).first().near_next == 1.0


def test_equal_substrings_share_names_at_any_offset():
    r = np.random.default_rng(4)
    word = lambda: bytes(r.integers(97, 123, r.integers(2, 9)).astype(np.uint8))
    body = b" ".join(word() for _ in range(400))
    other = b" ".join(word() for _ in range(400))
    root, least = fingerprint.fingerprints([body, b"12 345 " + body, body[:900] + b"#" + body[900:], other, body, b"", b"aaaa" * 500])
    near = [fingerprint.likeness(least[0], x, False) for x in least]  # all but the empty text are long
    assert root[0] == root[4] and len({int(x) for x in root}) == 6
    assert near[1] > 0.8 and near[2] > 0.8 and near[3] < 0.1


_SIXTY_FOUR = (1 << 64) - 1


def _mix(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & _SIXTY_FOUR
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & _SIXTY_FOUR
    return x ^ x >> 33


def plain_level(symbols):
    """One level of the parsing, symbol by symbol: runs, three rounds of coin tossing, phrases at local maxima."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    labels = [s for s, _ in runs]
    for _ in range(3):
        tossed = []
        for i, s in enumerate(labels):
            before = labels[i - 1] if i else s ^ 1
            low = ((s ^ before) & -(s ^ before)).bit_length() - 1 if s != before else 0
            tossed.append(2 * low + (s >> low & 1))
        labels = tossed
    names = []
    for s, n in runs:
        name = int(fingerprint.BYTE_VALUES[s]) if isinstance(s, _Byte) else s
        names.append(_mix(name + n * int(fingerprint._SALT) & _SIXTY_FOUR) if n > 1 else name)
    phrases = []
    for i, name in enumerate(names):
        peak = i == 0 or labels[i] > labels[i - 1] and (i + 1 == len(labels) or labels[i] > labels[i + 1])
        if peak:
            phrases.append([])
        phrases[-1].append(name)
    step = int(fingerprint._STEP) | 1
    return [_mix(sum(x * pow(step, k % 4096 + 1, 1 << 64) for k, x in enumerate(p)) + len(p) * int(fingerprint._SALT) & _SIXTY_FOUR) for p in phrases]


class _Byte(int):
    pass


def test_parsing_is_that_of_a_plain_parser():
    r = np.random.default_rng(9)
    texts = [bytes(r.integers(97, 97 + k, n).astype(np.uint8)) for k, n in ((26, 900), (2, 500), (3, 77), (26, 5), (1, 40), (4, 2))] + [b"", "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. ".encode() * 9]
    root, least = fingerprint.fingerprints(texts)
    for t, name, (coarse, fine) in zip(texts, root, least, strict=True):
        level, levels, whole = [_Byte(b) for b in t], [], None
        while t and (whole is None or len(levels) < fingerprint.LEVEL):
            level = plain_level(level)
            levels.append(level)
            if whole is None and len(level) == 1:
                whole = _mix(level[0] + len(levels) & _SIXTY_FOUR)
        low = [sorted({x >> 32 for x in n}) for n in levels]
        assert int(name) == (whole or 0)
        assert coarse.tolist() == (low[fingerprint.LEVEL - 1][: fingerprint.SKETCH] if t else [])
        assert (fine is None) == bool(t and len(low[fingerprint.LEVEL - 1]) >= fingerprint.FEW)
        assert fine is None or fine.tolist() == (low[fingerprint.FINE - 1][: fingerprint.SKETCH] if t else [])


def test_half_edited_short_texts_are_half_alike():
    r = np.random.default_rng(10)
    text = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8))
    found = []
    for n in (24, 40, 60, 120, 250):
        for _ in range(40):
            a, b = text(n), text(n)
            _, least = fingerprint.fingerprints([a, a[: n - n // 2] + b[: n // 2], b])
            found.append((fingerprint.likeness(least[0], least[1], False), fingerprint.likeness(least[0], least[2], False)))
    edited, other = (np.array(x) for x in zip(*found, strict=True))
    assert 0.3 < np.median(edited) < 0.7 and (edited > 0.1).mean() > 0.97 and np.median(other) == 0


def test_fingerprint_of_a_very_long_text(spark):
    word = np.random.default_rng(2).integers(97, 123, 3_000_000).astype(np.uint8).tobytes().decode()
    df = spark.createDataFrame([(2, word), (1, word[1_000_000:]), (0, "x")], "doc_id long, text string")
    got = {x.doc_id: x for x in fingerprint.fingerprint_edits(df).collect()}
    assert got[2].n_chars == 3_000_000 and 0.6 < got[2].near_next < 0.95 and got[1].near_next == 0


def page(body, extra=""):
    return f'<html><head><title>t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">menu</a></ul></nav><!-- no --><div class="ad">buy now</div>{extra}{body}<footer>&copy; me</footer></body></html>'


def test_html_extraction(spark):
    rows = []
    for i in range(8):
        rows.append((i, f"http://a.example/{i}", page(f"<article><h1>Title {i}</h1><p>One &amp;\n two<b>x</b><br>three{i}<p>last &#233;</article>", '<aside>side</aside><form><input>f</form><div id="comments"><p>first!</p></div>')))
    for i in range(8, 14):
        rows.append((i, f"https://b.example/{i}", page(f'<div class="wrap"><div class="content"><p>Body text number {i} long enough to hold most of the page.</p></div><div class="sidebar">links</div><p>All rights reserved</p></div>')))
    rows += [(20, None, None), (21, "http://c.example/", "just text"), (21, "http://[bad", "<article>x<p>y"), (22, "http://d.example/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in html_extract.extract_pages(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    for i in range(8):
        assert got[i] == [f"Title {i} One & twox three{i} last é"]
    for i in range(8, 14):
        assert got[i] == [f"Body text number {i} long enough to hold most of the page."]
    assert got[20] == [""] and sorted(got[21]) == ["just text", "x y"] and got[22] == [""]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def _texts(spark, bodies, host="a"):
    df = spark.createDataFrame([(i, f"http://{host}.example/{i}", page(b)) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    return [r.text for r in sorted(html_extract.extract_pages(df).collect(), key=lambda r: r.page_id)]


def test_html_of_divs_keeps_heading_and_all_sections(spark):
    long = lambda i, n: " ".join(f"word{i}x{k}" for k in range(n))
    post = lambda i: f'<div class="top"><a href="/">home page of this place</a></div><div class="post"><h1>Title {i}</h1><div class="intro">{long(i, 30)}</div><div class="entry-content"><p>{long(i + 50, 70)}</p></div></div><p>Printed on recycled pixels</p>'
    want = [f"Title {i} {long(i, 30)} {long(i + 50, 70)}" for i in range(6)]
    assert _texts(spark, [post(i) for i in range(6)]) == want
    assert _texts(spark, [f'<div class="post"><h1>One</h1><p>{long(1, 90)}</p><blockquote>{long(2, 20)}</blockquote></div>']) == [f"One {long(1, 90)} {long(2, 20)}"]


def test_html_template_text_inside_an_article_goes(spark):
    box = '<div class="k7"><p>Get <b>our</b> letter each week.</p></div>'
    bodies = [f"<article><h1>Title {i}</h1><p>Text <i>our</i> {i} of its own, long enough to be most of it.</p>{box if i % 4 else ''}<p>End {i}</p></article>" for i in range(8)]
    assert _texts(spark, bodies) == [f"Title {i} Text our {i} of its own, long enough to be most of it. End {i}" for i in range(8)]
    headed = [f"<article><h1>{'Shared' if i else 'Own'}</h1><p>Text {i} of its own, long enough to be most of it.</p></article>" for i in range(3)]
    assert _texts(spark, headed) == [f"{'Shared' if i else 'Own'} Text {i} of its own, long enough to be most of it." for i in range(3)]
    copies = ["<article><h1>Same</h1><p>A page that is there twice.</p></article>"] * 2 + ["<article><h1>Other</h1><p>And one more.</p></article>"]
    assert _texts(spark, copies) == ["Same A page that is there twice."] * 2 + ["Other And one more."]


def test_html_class_names_have_no_meaning_inside_an_article(spark):
    bodies = [f'<article><h2 class="share-price header">Market header {i}</h2><section class="related-work"><p>Prior art of {i}, told at some length.</p></section><div class="notice banner">Read {i}</div><p class="side">End {i}</p></article>' for i in range(5)]
    assert _texts(spark, bodies) == [f"Market header {i} Prior art of {i}, told at some length. Read {i} End {i}" for i in range(5)]


def test_html_comments_as_inner_articles_and_aria_parts_go(spark):
    body = '<article><h1>T {0}</h1><p>Body {0} of the text, longer than what follows it.</p><div role="navigation">on</div><article><p>me {0}</p></article><article>you {0}</article></article>'
    assert _texts(spark, [body.format(i) for i in range(4)]) == [f"T {i} Body {i} of the text, longer than what follows it." for i in range(4)]
    assert _texts(spark, ["<article><article><h1>T</h1><p>All of it</p></article></article>"]) == ["T All of it"]


def _neutral(i):
    """No article, no main, no telling class name; a notice in the text, a varying advert, a repeated box after it."""
    own = " ".join(f"w{i}x{k}" for k in range(40))
    return f'<div class="q1"><p>ad {i} {i}</p></div><div class="q2"><h1>Head {i}</h1><div class="q3"><p>{own}</p><div class="q4"><p>Get our letter</p></div><p>Last {i}</p></div></div><div class="q5"><p>Printed on</p><p>recycled pixels</p></div>', f"Head {i} {own} Last {i}"


def test_html_template_alone_finds_the_text(spark):
    """Without the template the same pages read otherwise; rows that repeat change nothing; columns may clash."""
    pairs = [_neutral(i) for i in range(9)]
    assert _texts(spark, [b for b, _ in pairs]) == [t for _, t in pairs]
    assert all(html_extract.extract(page(b)) != t for b, t in pairs)
    rows = [(i, "http://a.example/x", page(b), "k", 5) for i, (b, _) in enumerate(pairs) for _ in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, tokens int")
    assert sorted((r.page_id, r.text) for r in html_extract.extract_pages(df).collect()) == sorted((i, t) for i, (_, t) in enumerate(pairs) for _ in range(2))


def test_html_of_a_very_long_page(spark):
    own = [" ".join(f"w{i}x{k}" for k in range(150_000)) for i in range(3)]
    assert _texts(spark, [f"<article><p>{t}</p></article>" for t in own]) == own


def test_classes_and_template_are_those_of_a_plain_search(spark):
    """Random pages of a few hosts: classes by whole occurrence vectors, validity by looking at every page."""
    r = np.random.default_rng(6)
    pages_ = []
    for i in range(36):
        bits = ["<div class=a1><p>Top line</p></div>" if r.random() < 0.7 else "", f"<div class=b2><h1>H {i}</h1>" + "".join(f"<p>t {i} {k}</p>" for k in range(r.integers(1, 4))) + "</div>", "<ul class=c3><li>One<li>Two</ul>" if r.random() < 0.8 else ""]
        if r.random() < 0.3:
            bits.reverse()
        pages_.append((i, f"h{i % 3}", "<body>" + "".join(bits) + ("<p>Foot</p><i>note</i>" if r.random() < 0.9 else "") + "</body>"))
    df = spark.createDataFrame([(i, f"http://{h}/", h, b) for i, h, b in pages_], "page_id long, url string, host string, html string")
    got = {x.host: x for x in html_extract.classes(df).collect()}
    final = {x.host: x for x in html_extract.templates(df).collect()}
    for host in ("h0", "h1", "h2"):
        own = []
        for _, h, b in pages_:
            if h == host:
                elements, blocks = html_extract.parse(b)
                own.append([(t, k) for _, t, k in sorted([(e.order, e.path, e.name) for e in elements] + [(x.order, x.token, "") for x in blocks])])
        vectors = {}
        for t in {t for p in own for t, _ in p}:
            v = tuple(sum(x == t for x, _ in p) for p in own)
            if max(v) == 1 and sum(v) >= max(3, 0.5 * len(own)):
                vectors.setdefault(v, set()).add(t)
        plain = {frozenset(c) for c in vectors.values() if len(c) > 1}
        found = {}
        for t in got[host].tokens:
            found.setdefault(t["class"], set()).add(t.token)
        assert {frozenset(c) for c in found.values()} == plain
        root = found[0]
        assert max(len(c) for c in plain) >= 2 and sum(any(x in root for x, _ in p) for p in own) == max(sum(any(x in c for x, _ in p) for p in own) for c in plain)
        valid = set()
        for number, c in found.items():
            order = [t.token for t in got[host].tokens if t["class"] == number]
            slots = {}
            for t in order:
                places = set()
                for p in own:
                    line = [x for x, _ in p]
                    if t in line:
                        i = line.index(t)
                        places.add((-1 if number == 0 else sum(x in root for x in line[:i]), any(line.index(b) > i for b in order[: order.index(t)])))
                if len(places) == 1 and not next(iter(places))[1]:
                    slots.setdefault(next(iter(places))[0], set()).add(t)
            valid |= {t for s in slots.values() if len(s) > 1 for t in s}
        texts = {t for p in own for t, k in p if not k}
        assert set(final[host].tokens) == valid & texts


def _accuracy(scored, labels, label, hold):
    y = {r.doc_id: r[label] for r in labels.collect()}
    s = [(r.score, y[r.doc_id]) for r in scored.collect() if r.doc_id in y and hold(zlib.crc32(str(r.doc_id).encode()))]
    good = [p for p, t in s if t == 1]
    bad = [p for p, t in s if t == 0]
    return np.mean([(np.array(bad) < g).mean() + 0.5 * (np.array(bad) == g).mean() for g in good])


def test_classifiers_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    q = quality.score_quality(docs, quality.train_quality(docs, labels))
    assert _accuracy(q, labels, "quality", lambda c: c % 3 == 1) > 0.97
    t = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))
    assert _accuracy(t, labels, "toxic", lambda c: c % 5 == 0) > 0.85


def test_classifiers_without_labels_and_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train_quality(odd, none) is None and toxicity.train_toxicity(odd, none) is None
    assert {r.score for r in quality.score_quality(odd, None).collect()} == {0.5}
    net, field = quality.ByteNetwork(), toxicity.ToxicField()
    for scored in (quality.score_quality(odd, net), toxicity.score_toxicity(odd, field, with_spans=True)):
        rows = scored.collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(odd, none).count() == len(EDGE)


def plain_score(net, text):
    """The network chunk by chunk: filters, segment maxima, maximum and mean of the segments, probability."""
    n = max(1, -(-len(text) // quality.STRIDE))
    at = lambda i: text[i] if 0 <= i < len(text) else 0
    eight = lambda i: bytes(at(i + k) for k in range(8))
    outs = []
    for c in range(n):
        i = quality.STRIDE * c
        again = i + quality.TAPS <= len(text) and at(i + quality.TAPS - 1) != 0 and any(eight(i - lag) == eight(i) for lag in range(2, quality.LAGS + 1))
        z = net.bias.astype(float) + again * net.repeat
        for k in range(quality.TAPS):
            z = z + net.taps[k][at(i + k)]
        outs.append(z)
    tops = [np.maximum(np.max(outs[s : s + quality.SEGMENT], axis=0), 0) for s in range(0, n, quality.SEGMENT)]
    return 1 / (1 + np.exp(-(np.concatenate([np.max(tops, axis=0), np.mean(tops, axis=0)]) @ net.out + net.out_bias)))


def test_network_is_that_of_plain_loops():
    r = np.random.default_rng(12)
    net = quality.ByteNetwork()
    texts = [bytes(r.integers(1, 256, n).astype(np.uint8)) for n in (0, 1, 7, 8, 33, 700)] + [b"the same " * 40, b"ab" * 300, "größer ".encode() * 20]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert got == pytest.approx([plain_score(net, t) for t in texts], abs=2e-5)
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    y, weight = np.array([1, 0, 1, 0, 1, 0, 1, 0, 1.0]), r.uniform(0.5, 2, 9)
    for name in ("taps", "repeat", "bias", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.out_bias = np.float64(0.1)
    _, grads, g_bias = net.gradients(raw, y, weight)
    loss = lambda: net.gradients(raw, y, weight)[0]
    for param, grad in zip((net.taps, net.repeat, net.bias, net.out), grads, strict=True):
        for spot in [tuple(i) for i in np.argwhere(np.abs(grad) > np.abs(grad).max() / 3)[:5]]:
            param[spot] += 1e-5
            up = loss()
            param[spot] -= 2e-5
            down = loss()
            param[spot] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(grad[spot], rel=0.02, abs=1e-5)
    net.out_bias += 1e-5
    up = loss()
    net.out_bias -= 2e-5
    assert (up - loss()) / 2e-5 == pytest.approx(g_bias, rel=0.01)


def test_scores_of_very_long_texts_are_those_of_their_words(spark):
    """A text beyond a slice is scored whole: what stands at its end counts."""
    field, net = toxicity.ToxicField(), quality.ByteNetwork()
    start, end, _, f = toxicity.features(np.frombuffer(b"foul", np.uint8), np.array([0, 4]))
    field.weight[f[0]] = 3.0
    field.trans, field.begin, field.top = np.array([[0.0, -4.0], [0.0, -2.0]]), np.array([0.0, -4.0]), (np.array([1.0, 0.0]), 0.0)
    long = "clean words " * 200_000
    rows = [(1, long), (2, long + "foul"), (3, "foul"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, field, with_spans=True).collect()}
    assert got[2].score > 0.9 > 0.5 > got[1].score and got[3].score > 0.9 and got[4].score < 0.5
    assert [(s.start, s.end) for s in got[2].spans] == [(len(long), len(long) + 4)] and not got[1].spans
    scores = {r.doc_id: r.score for r in quality.score_quality(df, net).collect()}
    assert scores[1] == pytest.approx(plain_score(net, (long[: 12 * 2000]).encode()), abs=0.02) and scores[4] == pytest.approx(plain_score(net, b""), abs=1e-5)


def test_field_marginals_are_those_of_all_paths():
    import itertools

    f = toxicity.ToxicField()
    f.trans, f.begin = np.array([[0.3, -1.0], [-0.5, 0.8]]), np.array([0.1, -0.7])
    r = np.random.default_rng(0)
    sizes = [1, 0, 7, 3]
    doc = np.repeat(np.arange(4), sizes)
    emit = r.normal(size=len(doc))
    got = f.marginals(emit, doc, 4)
    at = 0
    for n in sizes:
        e = emit[at : at + n]
        w = {p: np.exp(f.begin[p[0]] + sum(f.trans[a, b] for a, b in itertools.pairwise(p)) + sum(x for x, t in zip(e, p, strict=True) if t)) for p in itertools.product((0, 1), repeat=n)} if n else {}
        for i in range(n):
            assert got[at + i] == pytest.approx(sum(v for p, v in w.items() if p[i]) / sum(w.values()))
        at += n
    long = f.marginals(r.normal(size=200), np.zeros(200, int), 1)
    assert len(long) == 200 and np.all((long > 0) & (long < 1))
