"""Nearest neighbours, ranked lexical search and the conversation trie against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.llm import prefix_forest, queries, radix_trie, sliced_signatures

# --- op11 ---


def nearest_plain(rows, asked, k):
    """query row -> [(vec_id, score)], over all rows."""
    out = {}
    for i, q, _ in rows:
        if not asked(i):
            continue
        found = [(float((np.array(q) * np.array(v)).sum()), j) for j, v, _ in rows if j != i]
        out[i] = [(j, s) for s, j in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def clusters(seed=3, n=900, d=16):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((20, d)) * r.uniform(0.5, 2, (20, 1))
    rows = [centres[r.integers(20)] + r.standard_normal(d) * r.choice([0.01, 0.3]) for _ in range(n - 100)]
    rows += [centres[0]] * 60 + [centres[0] * 0.5] * 40  # copies, and one direction of two lengths
    return [(i, v.tolist(), "x") for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [(4096, 2048), (64, 8)])
def test_all_rows_are_found_with_a_whole_budget(spark, block):
    rows = clusters()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = defaultdict(list)
    for r in prefix_forest.nearest(table, F.col("vec_id") % 20 == 0, k=7, budget=10**9, block=block).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = nearest_plain(rows, lambda i: i % 20 == 0, 7)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12) for q in want)


@pytest.mark.parametrize("block", [(4096, 2048), (64, 8)])
def test_recall_of_the_fitted_budget(spark, block):
    rows = clusters()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = defaultdict(set)
    for r in prefix_forest.nearest(table, F.col("vec_id") % 5 == 0, k=10, block=block).collect():
        got[r.query_id].add(r.score)
    want = nearest_plain(rows, lambda i: i % 5 == 0, 10)
    hits = [sum(any(math.isclose(s, t, rel_tol=1e-9) for t in got[q]) for _, s in v) for q, v in want.items()]
    assert np.mean(hits) >= 9.3


def test_small_budgets_look_at_fewer_rows(spark):
    rows = clusters()
    own = spark.createDataFrame([(i, i, v, i % 5 == 0) for i, v, _ in rows], "row long, id long, vector array<double>, asked boolean")
    forest = prefix_forest.planted(own, 16, 5)
    some = prefix_forest.found(forest, 40, (64, 8)).groupBy("number").agg(F.max("score").alias("best")).count()
    assert some == forest.rows.filter("wanted").count() and forest.count < len(rows)


def test_unusable_vectors_and_repeated_ids(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0]]
    rows = [(20 * i, v) for i, v in enumerate(bad)] + [(200, [1.0, 0.0]), (200, [1.0, 0.0]), (1, [2.0, -0.0]), (2, [2.0, 0.0]), (None, [0.5, 0.5]), (220, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in prefix_forest.nearest(table, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == sorted(2 * [(200, 1, 1, 2.0), (200, 2, 2, 2.0), (200, 3, 200, 1.0)])
    assert prefix_forest.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e200, 1e200]), (1, [3e200, 0.0]), (2, [1e-200, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in prefix_forest.nearest(huge, F.col("vec_id") == 2).orderBy("rank").collect()] == [1, 0]


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0 if j == i % 8 else 0.0 for j in range(8)] + [float(i)], 0) for i in range(40)]
    table = spark.createDataFrame([(i, v[:8] + [0.0], x) for i, v, x in rows], "vec_id long, embedding array<double>, label int")
    got = [r.vec_id for r in prefix_forest.nearest(table, F.col("vec_id") == 9, k=10).orderBy("rank").collect()]
    assert got == [1, 17, 25, 33, 0, 2, 3, 4, 5, 6]


# --- op12 ---


def terms(text):
    found = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode())
    return Counter(bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in found)


def search_plain(docs, items, k=20):
    tf = [(d, terms(t)) for d, t in docs]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    n_docs, total = len(tf), sum(n for _, _, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in tf:
            m = 75 + (25 * n * n_docs) // total
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in terms(text).items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def texts(seed=5, n=300):
    r = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(80)] + ["Ä", "ñe", "X9"])
    weight = 1 / np.arange(1, len(words) + 1)
    one = lambda size: " ".join(r.choice(words, size, p=weight / weight.sum()))
    docs = [(i, one(int(r.integers(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(40)] + [(n + 50, None), (n + 51, ""), (n + 52, "..."), (None, one(30)), (None, one(30)), (3, one(20)), (n + 53, one(30000))]
    items = [(i, one(int(r.integers(1, 25)))) for i in range(20)] + [(20, docs[7][1]), (21, None), (22, ""), (23, "unheard"), (5, one(4)), (None, one(4))]
    return docs, items


@pytest.mark.parametrize("query_terms", [1 << 14, 30])
def test_search_is_exact(spark, query_terms):
    docs, items = texts()
    d = spark.createDataFrame([(*x, "a") for x in docs], "doc_id long, text string, rank string").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int")
    got = Counter(tuple(r) for r in sliced_signatures.search(d, b, query_terms=query_terms).collect())
    assert got == Counter(search_plain(docs, items))


def test_search_without_rows_or_terms(spark):
    d, b = (spark.createDataFrame([(1, "a b"), (2, None)], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert sliced_signatures.search(d.limit(0), b).count() == sliced_signatures.search(d, b.limit(0)).count() == 0
    assert sliced_signatures.search(d.filter("doc_id = 2"), b).count() == 0
    assert [tuple(r) for r in sliced_signatures.search(d, b).collect()] == search_plain([(1, "a b"), (2, None)], [(1, "a b"), (2, None)])


def test_bounds_are_never_too_low():
    docs, items = texts(9, 120)
    index = sliced_signatures.Index(None, None, 121, 4000)
    every = sorted({t for _, x in docs + items for t in terms(x)})
    data, offsets = np.frombuffer(b"".join(every), np.uint8), np.cumsum([0, *map(len, every)])
    _, term, _ = sliced_signatures.term_counts(data, offsets)
    asked = sliced_signatures.Asked(np.unique(term), [0], [np.arange(0, len(every), 3)], [np.arange(1, len(every[::3]) + 1)], index.n_docs, index.n_terms)
    kept = [(i, t) for i, t in enumerate(t for _, t in docs) if terms(t)]
    raw = [t.encode() for _, t in kept]
    doc, term, count = sliced_signatures.term_counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    shelf = sliced_signatures.Shelf(256)  # overfull signatures: many false positives
    for i in range(len(kept)):
        shelf.add(i, int(count[doc == i].sum()), term[doc == i], count[doc == i])
    ids, lengths, positions, bitmaps, _, _ = shelf.block()
    (bound,) = asked.bounds(ids, lengths, positions, bitmaps)
    exact = [asked.score(0, term[doc == i], count[doc == i], int(m)) for i, m in enumerate(asked.norms(lengths))]
    assert (bound >= exact).all() and max(exact) > 0


def test_long_texts_are_taken_apart_between_words(monkeypatch):
    text = ("ab cd " * 50 + "x" * 300 + " ef " * 40).encode()
    data, offsets = np.frombuffer(text + b"gh ab", np.uint8), np.array([0, len(text), len(text), len(text) + 5])
    whole = sliced_signatures.term_counts(data, offsets)
    monkeypatch.setattr(sliced_signatures, "PIECE", 64)
    for a, b in zip(whole, sliced_signatures.term_counts(data, offsets), strict=True):
        assert a.tolist() == b.tolist()


# --- op13 ---


def trie_plain(rows, heads=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, radix_order(role, text), role or "", text or ""))
    own = {c: [(role, text) for _, _, _, role, text in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if heads else 0
        built[c] = (*own.get(c - c % 5, [])[:h], *t[h:]) if heads else tuple(t)
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if built[c] == node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def radix_order(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]


def talks(seed=2, n=120):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        first = int(r.integers(3))
        for turn in range(int(r.integers(1, 7)) if c != 44 else 80):
            rows.append((c, turn, ("user", "assistant")[turn % 2], "hot" if c % 3 == 0 and turn < 3 else f"t{first if turn < 2 else int(r.integers(4))}é"))
    rows += [(c, turn, "user", t) for c in range(200, 300, 7) for turn, t in enumerate(("same", "talk"))]
    rows += [(400, None, "user", "null turn"), (400, 0, None, None), (400, 0, None, None), (None, 0, "user", "nowhere"), (401, 1, "ab", "c"), (401, 1, "a", "bc"), (403, 0, "x", "")]
    return rows


@pytest.mark.parametrize("block_rows", [20_000, 7, 1])
@pytest.mark.parametrize("heads", [True, False])
def test_trie_matches_brute_force(spark, block_rows, heads):
    rows = talks()
    table = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, base int").repartition(4)
    rule = {"base": lambda c: c - F.pmod(c, F.lit(5)), "borrowed": lambda c: F.crc32(c.cast("string")) % 9} if heads else {}
    got = radix_trie.prefix_trie(table, block_rows=block_rows, **rule)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == trie_plain(rows, heads)


def test_nodes_widen(spark):
    tree = radix_trie.Branch(b"")
    keys = [bytes([a, b]) for a in range(256) for b in (3, 200)] + [b"\x07" * 9, b"", b"\x07\x03\x01"]
    kinds = set()
    for key in keys:
        tree.insert(key, (key,))
        kinds.add((type(tree.children).__name__, getattr(tree.children, "room", 0)))
    assert kinds == {("Few", 4), ("Few", 16), ("Indexed", 0), ("Direct", 0)}
    got, stack = [], [(b"", tree)]
    while stack:
        head, node = stack.pop()
        if node.value:
            got.append(node.value[0])
            assert head + node.prefix == node.value[0]
        stack += [(head + node.prefix + bytes([b]), c) for b, c in node.children.items()]
    assert sorted(got) == sorted(keys)


def test_no_conversations_give_no_nodes(spark):
    table = spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert radix_trie.prefix_trie(table).count() == 0 == radix_trie.prefix_trie(table.limit(0)).count()


# --- the queries ---

DATA = "/root/testdata/sf0.001"


def test_registered_queries(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, 0) for r in table.collect()]
    want = nearest_plain(rows, lambda i: i % 20 == 0, 20)
    got = defaultdict(dict)
    for r in queries.op11_nearest_neighbours(spark, DATA).collect():
        got[r.query_id][r.vec_id] = r.score
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[q].keys() & {j for j, _ in v}) / 20 for q, v in want.items()]) >= 0.9
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{DATA}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert Counter(tuple(r) for r in queries.op12_lexical_search(spark, DATA).collect()) == Counter(search_plain(docs, items))
    talks_ = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in queries.op13_prefix_trie(spark, DATA).collect()) == trie_plain(talks_)
