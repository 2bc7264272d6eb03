import collections
import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from conftest import same_rows
from fairlead.llm import mixing, ngram_join, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_components(rows):
    """(doc_id, shingles, component) of every row, by comparing all sets that share a shingle."""
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        met = collections.Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, n in met.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def corpus():
    """Texts with exact copies, a large group of near copies, chains, a passage that many share, short and empty texts."""
    r = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(4000)]
    text = lambda n: [vocab[i] for i in r.integers(0, 4000, n)]
    rows, base, passage = [], text(120), text(60)
    for _ in range(60):
        t = list(base)
        for i in r.integers(0, 120, r.integers(0, 5)):
            t[i] = "edit" + str(r.integers(0, 10**6))
        rows.append(t)
    chain = text(200)
    for k in range(12):
        rows.append([f"c{k}"] * (7 * k) + chain[7 * k :] + text(1) * 0)
    for _ in range(40):
        rows.append(text(r.integers(30, 300)) + passage)
    rows += [text(3), text(3)[:2], ["A", "b"], ["a", "B"], ["a"], []]
    out = [(i, " ".join(t)) for i, t in enumerate(rows)]
    out += [(500 + i, out[i % 30][1].upper()) for i in range(50)]
    return out + [(900, None), (900, ""), (None, out[70][1]), (7, out[7][1]), (901, " \t\n")]


@pytest.mark.parametrize("tile", [ngram_join.TILE, 1500])
def test_join_against_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2000)
    rows = corpus()
    monkeypatch.setattr(ngram_join, "BUCKET", 1500)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, owner int, size int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.similarity_components(df, tile, pair_tile=tile).collect())
    assert got == plain_components(rows)


def test_sets_that_share_a_name_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 11, 3, 7, 70), (2, 12, 3, 7, 70), (3, 13, 5, 7, 71), (4, 14, 2, 8, 80), (5, 15, 0, 0, 0)], "doc_id long, row_key long, n_shingles long, owner long, check long")
    sets = ngram_join.Sets(rows)
    assert sets.shared == {7}
    assert sorted((r.doc_id, r.owner) for r in sets.rows.collect()) == [(1, 70), (2, 70), (3, 71), (4, 8), (5, 0)]
    assert sorted((r.owner, r.n, r["first"].doc_id) for r in sets.classes.collect()) == [(0, 0, 5), (8, 2, 4), (70, 3, 1), (71, 5, 3)]
    h, at = np.arange(6, dtype=np.uint64), np.array([0, 2, 2, 6])
    own, check = ngram_join._set_names(h, at)
    again, _ = ngram_join._set_names(h, at, frozenset([int(own[0])]))
    assert again.tolist() == [check[0], 0, own[2]] and own[1] == 0


def test_a_very_long_text_and_its_near_copy_link(spark):
    words = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-50], "other"])), (3, " ".join(words[:140_000]))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 199_996, 1), (2, 199_947, 1), (3, 139_996, 3)]


def test_one_of_each_component_stays_with_null_and_repeated_ids(spark):
    r = np.random.default_rng(3)
    text = lambda: " ".join(f"w{i}" for i in r.integers(0, 5000, 80))
    alone, twice, near, mixed = [text() for _ in range(4)], [text(), text()], text(), text()
    rows = [(None, t, "alone") for t in alone] + [(5, t, "twice") for t in twice]
    rows += [(None, near, "near"), (None, near + " x", "near"), (7, mixed, "mixed"), (None, mixed + " y", "mixed"), (7, text(), "other"), (None, "", "blank"), (None, " ", "blank"), (7, "", "blank")]
    got = [tuple(x) for x in ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, __id string")).collect()]
    assert collections.Counter(k for _, _, k in got) == {"alone": 4, "twice": 2, "near": 1, "mixed": 1, "other": 1, "blank": 3}
    assert (7, mixed, "mixed") in got and {t for _, t, k in got if k in ("alone", "twice")} == {*alone, *twice}


def test_large_cluster_of_many_components(spark):
    """Windows that slide over one text share n-grams along a chain, but only near ones link; tiles of all sizes agree."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(2600)]
    rows, at = [], 0
    for i in range(90):
        rows.append((i, " ".join(words[at : at + 100])))
        at += r.choice((2, 6, 30, 45))
    rows += [(100 + i, " ".join([*words[:90], *(f"x{i}y{k}" for k in range(3)), *words[90:100]])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (1200,):
        got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in ngram_join.similarity_components(df, tile, pair_tile=tile).collect())
        assert got == plain_components(rows)
    assert 5 < len({c for _, _, c in got}) < 90


def test_join_of_empty_and_wordless_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similarity_components(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " "), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.similarity_components(blank).collect()) == [(1, 1), (2, 2), (2, 2)]


def test_frequent_ngrams_go_past_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    rows = corpus()
    h, at = ngram_join.shingle_sets(*_buffers([t or "" for _, t in rows]))
    n = np.diff(at)
    t = ngram_join._deal(np.arange(1, len(n) + 1), n, np.repeat(np.arange(len(n)), n), h, 4, 3)
    parts = [ngram_join._screen_block(t.filter(np.array(t.column("to")) == b), 3) for b in set(t.column("to").to_pylist())]
    found = collections.Counter()
    for p in parts:
        o, _, c, _, _, _ = ngram_join._opened(p)
        for x, k in zip(o.tolist(), c.tolist(), strict=True):
            found[x] += k
    often = collections.Counter(h.tolist())
    want = {i + 1: sum(often[x] > 1 for x in h[at[i] : at[i + 1]].tolist()) for i in range(len(n))}
    assert {i: found[i] for i in want} == want


def _buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


def test_pipeline_stages_against_plain_python(spark, sf_dir):
    """Each stage on its own input: rejected, copied and near documents go, the mixture repeats, tokens cover every row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, sf_dir).cache()
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    one = stages[1](spark, good, sf_dir).cache()
    last = {}
    for r in good.collect():
        key = (r.text or "").translate(LOWER)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in one.collect()) == sorted(last.values())
    near = stages[2](spark, one, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted(str(r.doc_id) for r in near.collect()) == sorted({c for _, _, c in plain_components(rows)})
    mix = stages[3](spark, near, sf_dir).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(near).collect()}
    assert collections.Counter(r.doc_id for r in mix.collect()) == {d: n for d, n in copies.items() if n}
    out = stages[4](spark, mix, sf_dir).collect()
    assert len(out) == mix.count()
    text = {r.doc_id: r.text or "" for r in near.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in out)


def test_pipeline_of_empty_and_textless_tables(spark, sf_dir):
    """No rows give no rows at each stage; of textless rows one stays after exact dedup, and its tokens are none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for rows in ([], [(i, None, None, None, None) for i in range(3)] + [(None, None, "x", "y", 0)]):
        d = spark.createDataFrame(rows, docs.schema)
        for name, stage in corpus_pipeline.STAGES[1:]:
            d = stage(spark, d, sf_dir).cache()
            if name == "exact dedup":
                assert [r.doc_id for r in d.collect()] == ([2] if rows else [])
        assert {r.n_tokens for r in d.collect()} <= {0}
