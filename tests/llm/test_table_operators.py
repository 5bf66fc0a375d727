"""Operators over whole tables: archives, search, similarity join and the pipeline."""

import base64
import gzip
import hashlib
import io
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from orthoquad.llm import common, ngram_join, queries, topk, toxicity, warc

SF = "/root/testdata/sf0.001"


# ---- SQL ------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


# ---- WARC -----------------------------------------------------------------------------
PAGES = "page_id bigint, url string, html string, record_type string"


def bare(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archive_round_trip(spark, tmp_path):
    rows = [(5, "http://a/5", "same", "q"), (3, "http://a/3", "same", "q"), (3, "http://a/3", "same", "q"), (7, None, None, "q"), (8, "http://a/8\r\nX: y", "", "q"), (9, "http://é/", "x" * 200_000, "q"), (None, "http://a/n", "same", "q"), (11, "u", "é🎉\r\n\r\n", "q")]
    pages = spark.createDataFrame(rows, PAGES)
    got = sorted(map(tuple, warc.archive(pages).collect()), key=repr)
    want = []
    for i, _, html, _ in rows:
        first = {"same": 3, "": 7}.get(html or "")
        revisit = first is not None and first != i
        want.append((i, len((html or "").encode()), bare(html), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=repr)
    few = {(r.page_id, r.record_type) for r in warc.archive(pages, min_bytes=5).collect()}
    assert (5, "response") in few and (8, "response") in few
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0
    warc.write(pages, f"{tmp_path}/w")
    stored = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, f"{tmp_path}/w", payload=True).where("record_type = 'response'").collect()}
    assert stored == {3: "same", 7: "", 9: "x" * 200_000, 11: "é🎉\r\n\r\n"}
    for path in (tmp_path / "w").glob("part-*"):  # ordinary tools read it too
        data = path.read_bytes()
        if data:
            assert gzip.GzipFile(fileobj=io.BytesIO(data)).read().startswith(b"WARC/1.1")


def test_archive_of_odd_ids(spark, tmp_path):
    ids = ["a\r\nX-Evil: 1", "<b>", "", None, "c:d=%20 é", "same", "same", "same"]
    rows = [(i, "u", f"text {at // 2}" if i != "same" else ["x", "y", "x"][at - 5], "q") for at, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, record_type string")
    got = warc.archive(pages).collect()
    assert sorted(map(repr, (r.page_id for r in got))) == sorted(map(repr, ids))
    first = {}
    for i, _, t, _ in rows:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    for r, (i, _, t, _) in ((r, x) for r in got for x in rows if (r.page_id, r.payload_digest) == (x[0], bare(x[2]))):
        assert r.refers_to == (None if first.get(t, i) == i else first[t]) and r.record_type == ("response" if r.refers_to is None else "revisit")
    warc.write(pages, f"{tmp_path}/w")
    seen = [x for p in (tmp_path / "w").glob("part-*") for b in [p.read_bytes()] if b for x in warc.read_records(warc.pieces(b, 100))]
    assert {x.kind for x in seen} >= {"warcinfo", "response"} and not any("x-evil" in x.headers for x in seen)
    names = [x.headers["warc-record-id"] for x in seen]
    assert len(set(names)) == len(names) - 1  # the row that repeats id and payload


def test_long_records_are_read_in_pieces():
    big = bytes(range(256)) * 40_000
    data = warc.member(warc.record("response", "n", "u", big)) + warc.member(warc.record("revisit", "m", "u", b"", refers_to="n"))
    for payload in (True, False):
        a, b = warc.read_records(warc.pieces(data, 1000), payload)
        assert (a.payload == big) if payload else (a.payload is None)
        assert (a.http["content-length"], b.kind, b.payload) == (str(len(big)), "revisit", None)
    raw = warc.record("response", "n", "u", big)
    for bad in (raw.replace(b"Content-Length: 10240", b"Content-Length: 10239"), raw.replace(b"Content-Length: 1024", b"Content-Length: 2024"), raw[:-9], raw[:60]):
        with pytest.raises(warc.WarcError):
            list(warc.read_records([warc.member(bad)], payload=False))


def test_reader_at_any_cut_and_damage():
    whole = b"".join(warc.member(warc.record("response", f"urn:x-page:{i}", "u", b"p" * i)) for i in range(5))
    for size in (1, 7, 100_000):
        assert [len(r.payload) for r in warc.read_records(warc.pieces(whole, size))] == list(range(5))
    with pytest.raises(warc.WarcError):
        list(warc.read_records([whole[:-3]]))
    raw = warc.record("response", "n", "u", b"payload")
    for bad in (raw.replace(b"payload", b"paYload"), raw[:-4], raw.replace(b"WARC/1.1", b"XXXX/1.1"), raw + b"z", re.sub(rb"Content-Length: \d+(?=\r\n\r\nHTTP)", b"Content-Length: x", raw)):
        with pytest.raises(warc.WarcError):
            list(warc.read_records([warc.member(bad)]))
    with pytest.raises(zlib.error):
        list(warc.read_records([b"not gzip at all"]))


# ---- top-k ------------------------------------------------------------------------------
def plain_search(q, q_ids, p, ids, k):
    out = {}
    for v, name in zip(q, q_ids, strict=True):
        found = sorted((-int(v @ w), int(i)) for w, i in zip(p, ids, strict=True) if i != name)
        out[int(name)] = [(-s, i) for s, i in found[:k]]
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 12), st.sampled_from([1, 3, 16]), st.booleans())
def test_dual_search_is_exact(seed, n, k, leaf, clustered):
    rng = np.random.default_rng(seed)
    p = rng.integers(-9, 10, (n, 5))
    if clustered:
        p = p // 8 * 40 + rng.integers(0, 2, (n, 5))
    ids = rng.permutation(1000)[:n]
    take = rng.random(n) < 0.5
    best = topk.dual_search(p[take], ids[take], p, ids, k, leaf)
    want = plain_search(p[take], ids[take], p, ids, k)
    for i, name in enumerate(ids[take].tolist()):
        got = [(int(s), int(j)) for s, j in zip(best.score[i], best.id[i], strict=True) if s > -(2**62)]
        assert got == want[name]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.sampled_from([1, 4, 16]), st.sampled_from(["even", "clusters", "copies", "outliers"]))
def test_tree_covers_and_separates(seed, n, leaf, kind):
    rng = np.random.default_rng(seed)
    p = rng.standard_normal((n, 4))
    p += {"even": 0, "clusters": 50 * rng.integers(0, 3, (n, 1)), "copies": -p, "outliers": 10.0 ** rng.integers(0, 6, (n, 1))}[kind]

    def check(node, above):
        away = np.linalg.norm(p[node.rows] - p[node.centre], axis=1)
        assert node.centre in node.rows and away.max() <= node.radius + 1e-6 and node.radius <= above + 1e-6
        if node.children:
            centres = p[[c.centre for c in node.children]]
            gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2) + 1e9 * np.eye(len(centres))
            assert gaps.min() >= node.scale - 1e-6 and node.children[0].centre == node.centre
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
            for c in node.children:
                check(c, node.scale)

    tree = topk.cover_tree(p, np.arange(n), leaf)
    assert len(tree.rows) == n
    check(tree, tree.radius)


def test_products_of_any_size():
    rng = np.random.default_rng(4)
    for size in (10**7, 2**40, 2**62):
        p = np.array([[int(x) * size // 10**6 for x in rng.integers(-(10**6), 10**6, 8)] for _ in range(30)])
        best = topk.dual_search(p, np.arange(30), p, np.arange(30), 4, 2)
        for i in range(30):
            exact = [(max(-(2**63) + 2, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(p[i], p[j], strict=True)))), j) for j in range(30) if j != i]
            assert list(zip(best.score[i].tolist(), best.id[i].tolist(), strict=True)) == sorted(exact, key=lambda x: (-x[0], x[1]))[:4]


@pytest.mark.parametrize("kind", ["clusters", "even", "hot"])
def test_search_over_many_cells(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(6)
    p = rng.standard_normal((700, 6)) + {"clusters": 40 * rng.integers(-1, 2, (8, 6))[rng.integers(0, 8, 700)], "even": 0, "hot": 0}[kind]
    if kind == "hot":
        p[:300] = p[0]
    rows = [(i if kind != "hot" or i > 50 else 0, v.tolist()) for i, v in enumerate(p)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    seen = []
    visits = topk.visits
    monkeypatch.setattr(topk, "visits", lambda *a: (seen.append(visits(*a).count()), visits(*a))[1])
    got = topk.search(frame, k=9).collect()
    ids, whole = np.array([i for i, _ in rows]), np.floor(64 * p).astype(np.int64)
    for q in {i for i in ids.tolist() if i % 20 == 0}:
        want = plain_search(whole[ids == q][:1], [q], whole, ids, 9)[q]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(n + 1, i, s) for n, (s, i) in enumerate(want)]
    if kind == "clusters":
        assert 35 <= seen[0] < 0.5 * 12 * 35


def test_pruning_happens(monkeypatch):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.integers(0, 3, (400, 4)) + 1000 * np.eye(4, dtype=int)[c] for c in range(4)])
    scored = []
    offer = topk.Best.offer
    monkeypatch.setattr(topk.Best, "offer", lambda self, q, score, ids, own: (scored.append(score.size), offer(self, q, score, ids, own))[1])
    topk.dual_search(p, np.arange(len(p)), p, np.arange(len(p)), 5, 32)
    assert sum(scored) < 0.5 * len(p) ** 2


def test_search_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 1)
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [2.0, 2.0]), (4, [2.0, 2.0]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [9.0, 9.0]), (40, [float("inf"), 1.0]), (8, [3.0]), (3, [2.0, 2.0]), (-20, [-0.01, 0.0])]
    got = topk.search(spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, score int"), k=4).collect()
    whole = {i: [int(np.floor(64 * x)) for x in v] + [0] * (2 - len(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    names = [i for i, v in rows if i in whole and v and None not in v and np.isfinite(v).all()]
    for q in (0, 20, -20):
        want = sorted((-int(np.dot(whole[q], whole[i])), i) for i in names if i != q)[:4]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert {r.query_id for r in got} == {0, 20, -20}
    assert topk.search(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


# ---- n-gram join ----------------------------------------------------------------------------
def grams(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def plain_join(rows, n, percent):
    sets = [(i, grams(t, n)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(grams(t, n)), None if i is None else find(i)) for i, t in rows), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_join_equals_all_pairs(spark, n, percent):
    rng = np.random.default_rng(n)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(14):
        text = list(rng.choice(words, int(rng.integers(1, 260))))
        for _ in range(int(rng.integers(1, 14))):
            near = list(text)
            for _ in range(int(rng.integers(0, 1 + len(text) // 14))):
                near[int(rng.integers(len(near)))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(near[: len(near) - int(rng.integers(0, 4))])))
    hot = " ".join(words[:60])  # a passage that many texts share
    rows += [(1000 + i, hot + " " + " ".join(rng.choice(words, 30))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one  TWO"), (2005, "É é"), (2006, "é é"), (None, "one two"), (2003, "one two"), (2007, rows[0][1].upper())]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, component_id int").repartition(5)
    assert sorted(map(tuple, ngram_join.join(frame, n=n, percent=percent).collect()), key=repr) == plain_join(rows, n, percent)


def test_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: int(rng.integers(40, 60))] + list(rng.choice(base, int(rng.integers(0, 6)))))) for i in range(60)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string"), n=2, percent=80).collect()
    assert sorted(map(tuple, got), key=repr) == plain_join(rows, 2, 80)


def test_join_links_texts_behind_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "other"])
    rows = [(None, " ".join(base)), (1, " ".join(base)), (None, near), (2, near)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_join(rows, 4, 85)
    assert {r.component_id for r in got if r.doc_id} == {1}


def test_join_takes_rows_of_an_id_for_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(0, a), (5, a), (5, b), (7, b + " more"), (7, ""), (8, "alone"), (None, b), (5, b), (5, b.upper())]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_join(rows, 4, 85)
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 5: 0, 7: 0, 8: 8, None: None}
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(40)), " ".join(str(int(rng.integers(9))) + x for x in a.split()[: int(rng.integers(1, 6))])) for _ in range(120)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_join(rows, 4, 85)


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_join_of_a_large_group_with_outliers(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rng = np.random.default_rng(rounds)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(260):
        near = list(base)
        for at in rng.choice(150, int(rng.integers(0, 10)), replace=False):
            near[at] = f"x{int(rng.integers(10**6))}"
        rows.append((i, " ".join(near)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = ngram_join.join(frame, n=5, percent=80).collect()
    want = plain_join(rows, 5, 80)
    assert sorted(map(tuple, got), key=repr) == want and 10 < len({c for _, _, c in want}) < 200


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_that_collide_under_polynomials_are_told_apart(spark):
    """A Thue-Morse word and its complement have one hash under any polynomial modulo 2 ** 64."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"x {word} y z w"), (4, f"x {other} y z w"), (5, word)]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_links_need_equal_words_not_hashes(spark):
    """With all words hashed alike the sets look similar; words tell that they aren't."""
    a, b = b"a b c d e f g h", b"i j k l m n o p"
    sets = [np.arange(5, dtype=np.uint64)] * 2
    roles = (np.ones(2, int), np.zeros(2, int), np.arange(2))
    assert ngram_join.spanning(sets, *roles, 85) == [(0, 1)]
    assert ngram_join.spanning(sets, *roles, 85, lambda i, j: ngram_join.exactly_similar((a, b)[i], (a, b)[j], 4, 85)) == []
    assert ngram_join.exactly_similar(a, a + b" ", 4, 100) and ngram_join.exactly_similar(b"x y", b"x  y", 4, 100) and not ngram_join.exactly_similar(b"", b"", 4, 85)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 40), st.sampled_from([50, 80]), st.booleans())
def test_spanning_links_join_all_that_similarity_joins(seed, m, percent, whole):
    rng = np.random.default_rng(seed)
    base = np.arange(1, 41, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(40) < 0.85], rng.integers(100, 10**6, int(rng.integers(0, 9)), dtype=np.uint64)])) for _ in range(m)]
    own, component = rng.integers(0, 2, m), rng.integers(0, max(1, m // 2), m)

    def groups(pairs):
        label = component.copy()
        for i, j in pairs:
            label[label == label[j]] = label[i]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}

    allowed = lambda i, j: whole or own[i] != own[j]
    true = [(i, j) for i in range(m) for j in range(i) if allowed(i, j) and ngram_join.similar(sets[i], sets[j], percent)]
    found = ngram_join.spanning(sets, np.full(m, int(whole)), own, component, percent)
    assert len(found) < m and all(ngram_join.similar(sets[i], sets[j], percent) for i, j in found)
    assert groups(found) == groups(true)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB \n\té")), max_size=400), st.integers(1, 5))
def test_sets_do_not_depend_on_spans(text, n):
    texts = [text, None, text * 3, "x" * 100]
    want = ngram_join.ngram_sets(texts, n)
    span = ngram_join.SPAN
    try:
        for ngram_join.SPAN in (1, 7, 64):
            assert all((a == b).all() and len(a) == len(b) for a, b in zip(want, ngram_join.ngram_sets(texts, n), strict=True))
    finally:
        ngram_join.SPAN = span
    assert [len(s) for s in want] == [len(grams(t, n)) for t in texts]


def test_sets_of_very_long_texts():
    long = " ".join(f"word{i}" for i in range(400_000))  # more than one span
    assert len(long) > 3 * ngram_join.SPAN
    a, b, c = ngram_join.ngram_sets([long, long + " end", "y" * (2 * ngram_join.SPAN) + " z"], 4)
    assert (len(a), len(b), len(c)) == (399_997, 399_998, 1) and ngram_join.similar(a, b, 99)


def test_join_of_nothing(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    lone = ngram_join.join(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, lone)) == [(1, 0, 1), (2, 0, 2)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 900), st.sampled_from([80, 85]))
def test_similar_sets_share_a_signature(seed, size, percent):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, size, dtype=np.uint64)
    cut, new = int(rng.integers(0, size // 8 + 2)), int(rng.integers(0, size // 8 + 2))
    b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
    a = np.unique(a)
    if ngram_join.similar(a, b, percent):
        assert set(ngram_join.signatures(a, percent).tolist()) & set(ngram_join.signatures(b, percent).tolist())
        apart = int(np.bitwise_count(ngram_join.sketch(a) ^ ngram_join.sketch(b)).sum())
        assert apart <= len(np.setxor1d(a, b)) <= (100 - percent) * (len(a) + len(b)) // (100 + percent)


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5, 5)]
    rows = spark.createDataFrame(chain, "a bigint, b bigint").orderBy(F.rand(3))
    got = {r.node: r.component for r in ngram_join.components(rows).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}


# ---- shared helpers ---------------------------------------------------------------------------
def test_drop_ids(spark):
    rows = spark.createDataFrame([(i if i else None, "x") for i in range(500)], "doc_id bigint, text string")
    dropped = rows.where("doc_id % 3 = 0").select("doc_id")
    assert common.drop_ids(rows, "doc_id", dropped).where("doc_id % 3 = 0").count() == 0
    assert common.drop_ids(rows, "doc_id", dropped).count() == 500 - dropped.count()
    assert common.drop_ids(rows, "doc_id", dropped.limit(0)).count() == 500


def test_bounded_sample(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"))
    few = common.bounded_sample(rows, "k", 200)
    assert len(few) == 200 and few == common.bounded_sample(rows.repartition(7), "k", 200)
    assert len(common.bounded_sample(rows.limit(20), "k", 200)) == 20


def test_slices_lose_nothing():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (0, 3, 50, 1, 1)] + [None]})
    parts = [texts for _, texts in common.slices([batch, batch], "t", max_chars=5, max_rows=2)]
    assert [t for p in parts for t in p] == batch.column("t").to_pylist() * 2 and all(len(p) <= 2 for p in parts)


# ---- pipeline ------------------------------------------------------------------------------------
def test_stage_rejects_what_the_operator_predicts_toxic(spark, monkeypatch):
    network = toxicity.Network.fresh()
    network.p["w"][:], network.p["b"][:] = 0, np.log(0.4 / 0.6)  # scores 0.4 on any words
    monkeypatch.setattr(toxicity, "fit", lambda *args: network)
    predicted = queries.op1_toxicity(spark, SF).groupBy("predicted").count().collect()
    assert [r.predicted for r in predicted] == [1]
    assert corpus_pipeline.toxicity_filter(spark, common.table(spark, SF, "documents"), SF).count() == 0


def test_stages(spark, monkeypatch):
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: train(texts, labels, steps=40))
    docs = common.table(spark, SF, "documents")
    odd = spark.createDataFrame([(900_000, None, None, "x", None), (900_001, "", "en", "x", 0), (None, "of the and", "en", "x", 10), (900_002, docs.first().text, "en", "x", 3)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, docs, SF), name)
        assert after.columns == corpus_pipeline.COLUMNS
        if name == "language_id":
            assert after.where("doc_id IN (900000, 900001)").count() == 0
        if name == "ngram_join":
            docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(3))
            after = common.materialize(stage(spark, docs, SF), name)
            assert after.where("doc_id IS NOT NULL").count() == after.select("doc_id").where("doc_id IS NOT NULL").distinct().count()
            found = plain_join([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert {r.doc_id for r in after.collect()} == {i for i, _, c in found if i == c}
        if name == "secret_scan":
            assert after.count() == docs.count() and after.where("n_chars <> length(text)").count() == 0
            assert after.where("text RLIKE '[0-9a-f]{16,}'").count() == 0
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    assert public_tokenizers.path("word_bpe_49k.json") and corpus_pipeline.ORACLE_SQL is None


def tables(spark, path, rows, labels):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id int, score double, _id string, sig bigint"
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, 0.5, "x", 2) for i, t, lang in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_on_odd_tables(spark, tmp_path, monkeypatch):
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: train(texts, labels, steps=20))
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "empty", [], [])).count() == 0
    long = " ".join(f"word{i}" for i in range(250_000))  # longer than a slice of the join
    rows = [(1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (2, "The CAT and the dog", "en"), (3, None, None), (4, "", "en"), (5, " 12 ", "fr"), (None, "the cat and the dog", "en"), (None, None, "en"), (7, "le chat token = 'abcdefghijkl1234'", "fr"), (8, long, "en"), (9, long + " end", "en"), (10, "日本 текст", None)]
    pieces = corpus_pipeline.run(spark, tables(spark, tmp_path / "odd", rows, [])).collect()
    assert {r.doc_id for r in pieces} == {1, None, 7, 8, 10}
    assert sum(r.start == 0 for r in pieces if r.doc_id == 1) == 1
    whole = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces if r.doc_id == 8) == whole[8] > 250_000
