"""N-gram join, suffix arrays, decontamination, quality and language model against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import convnet, decontaminate, katz, suffixes, trie_join
from quaymark.llm.suffixes import suffix_array
from quaymark.llm.text import copies_numbered
from quaymark.llm.trie_join import Trie

DOCS = "doc_id long, text string, lang string, n_chars long, copy string, node string, score string, item_ids string"


def corpus(seed=3, n=60):
    """Invented prose with copies, near copies, shared passages, junk, short and empty texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioubcdé") for _ in range(r.randint(2, 7))) for _ in range(300)]

    def prose(k):
        return " ".join(r.choice(vocabulary) for _ in range(k))

    passage = prose(60)
    texts = [None, "", "   ", "one", "One ", "a b c", "a b c d e", "x" * 500, "x" * 300, "ab " * 400]
    while len(texts) < n:
        kind = r.randrange(5)
        old = r.choice(texts) or ""
        if kind == 0 and len(old) > 50:
            texts.append(old)
        elif kind == 1 and len(old.split()) > 20:
            words = old.split()
            words[r.randrange(len(words))] = "CHANGED"
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(prose(r.randint(5, 80)) + "\n" + passage + " " + prose(5))
        else:
            texts.append(prose(r.randint(1, 120)))
    r.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "xx", len(t or ""), "c", "n", "s", "i") for i, t in docs], DOCS)


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_array_is_sorted(symbols):
    text = [*symbols, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=14), min_size=1, max_size=25), st.sets(st.integers(0, 30), min_size=1, max_size=14))
@settings(max_examples=200, deadline=None)
def test_trie_finds_exactly_the_similar_sets(sets, probe):
    trie = Trie([(i, sorted(s)) for i, s in enumerate(sets)])
    assert sorted(trie.similar(sorted(probe), 75)) == [i for i, s in enumerate(sets) if 100 * len(s & probe) >= 75 * len(s | probe)]


@pytest.mark.parametrize("block", [256, 2])
def test_near_copies_match_brute_force(spark, block):
    docs = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in trie_join.similar_groups(frame(spark, docs), block=block).collect()}
    assert got == brute.near_copies(docs)


def test_near_copies_with_repeated_and_missing_ids(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (None, text), (None, None), (2, "alone"), (7, text + " eight")]
    got = trie_join.similar_groups(frame(spark, rows)).collect()
    assert len(got) == 6
    assert {r.component_id for r in got if r.n_shingles == 3} == {5} and {r.component_id for r in got if r.n_shingles == 4} == {5}
    kept = trie_join.one_per_group(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (2, "alone"), (5, text)]


def test_repeats_match_brute_force(spark):
    docs = corpus(4)
    got = {r.doc_id: r for r in suffixes.removed(frame(spark, docs)).collect()}
    want = brute.repeats(docs)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got.values())


def test_repeats_in_small_turns(spark, monkeypatch):
    docs = [(i, f"{i:02d}" + "common part of all texts " * 6 + f"{i % 3}" * 40) for i in range(30)]
    rows = suffixes.copies_numbered(frame(spark, docs))
    rows = rows.selectExpr("doc_id doc", "copy", "text")
    ranges = {r.doc: sum(x.last - x.first for x in r.ranges) for r in suffixes.repeated_ranges(rows, chunk=4).collect()}
    assert ranges == {r.doc: sum(x.last - x.first for x in r.ranges) for r in suffixes.repeated_ranges(rows).collect()}


def test_repeated_rows_and_whole_characters(spark):
    long = "é" * 80
    rows = [(1, long), (1, long), (None, long), (2, None)]
    got = sorted((r.doc_id is None, r.n_removed) for r in suffixes.removed(frame(spark, rows)).collect())
    assert got == [(False, 0), (False, 158), (False, 160), (True, 160)]  # a text of one character also repeats itself
    cut = suffixes.deduplicated(frame(spark, [(1, "a" + long), (2, "bb" + long), (3, None)]))
    assert cut.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    texts = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert texts[1][0][:1] == "a" and texts[2][0] == "bb" and texts[2][1] == 2 and texts[3] == (None, None)


def test_contamination_matches_brute_force(spark):
    docs = corpus(5)
    items = [(i, t) for i, t in docs if t and len(t.split()) > 30][:6] + [(90, "one"), (91, "a b c"), (92, None), (93, "..")]
    items = [(i, " ".join((t or "").split()[3:30]) if i < 90 else t) for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (1_000_000, 20):
        rows = decontaminate.verdicts(decontaminate.found(frame(spark, docs), bench, block_words=words))
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.digest, r.contaminated) for r in rows.withColumn("digest", decontaminate.items_digest()).collect()}
        assert got == brute.contamination(docs, items)
    kept = decontaminate.decontaminated(frame(spark, docs), bench)
    assert kept.columns == frame(spark, docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in brute.contamination(docs, items).items() if not x[4]}


def test_longest_matches_and_no_benchmark(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "before " + " ".join(f"w{i}" for i in range(5, 25)) + " after"), (2, "nothing")]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = [tuple(r) for r in decontaminate.longest_matches(frame(spark, docs), bench).collect()]
    assert got == [(1, 9, 1, 5, 20)]
    assert decontaminate.decontaminated(frame(spark, docs), bench.limit(0)).count() == 2


def test_scores_match_brute_force(spark, tmp_path):
    docs = corpus(6, 80)
    path = str(tmp_path / "docs")
    frame(spark, docs).repartition(3).write.parquet(path)
    want = brute.katz(docs, katz.discounts)
    for options in ({}, {"frequent": 20, "group_tokens": 300, "part_tokens": 200}):
        got = {r.doc_id: r for r in katz.scored(spark.read.parquet(path), **options).collect()}
        assert got.keys() == want.keys()
        for i, (n, known, total, base, score) in want.items():
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(i).encode()) % 10 == 0)
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=1e-5, abs=1e-4)


@pytest.mark.parametrize("junk_id", [range(1000, 1040), [None]])
def test_scores_of_a_junk_source_that_repeats_one_pair(spark, tmp_path, junk_id):
    docs = [*corpus(6, 80), *((i, "buy " * (80 if i else 3200)) for i in junk_id)]
    path = str(tmp_path / "docs")
    frame(spark, docs).repartition(3).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("training", katz.is_training())
    words = katz.known_words(katz.word_counts(rows), rows.filter("training").count(), 100, katz.K)
    dealt = katz.dealt(rows, spark.sparkContext.broadcast(words), 8, 500).filter("kind in ('ff', 'fr', 'rf', 'rr')").collect()
    placed = Counter()
    for r in dealt:
        placed[r.part] += len(r.c) // 2
    # a third of all tokens is one pair: not one partition has more of them than of anything else
    assert max(placed.values()) < sum(placed.values()) / 3 and sum(placed.values()) > 2000
    want = brute.katz(docs, katz.discounts)
    got = {r.doc_id: r for r in katz.scored(spark.read.parquet(path), frequent=100, group_tokens=500, part_tokens=700).collect()}
    assert got.keys() == want.keys()
    for i, (n, known, total, base, score) in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score, rel=1e-5, abs=1e-4)


def test_scores_without_training_texts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = katz.scored(frame(spark, [(held, "a b"), (None, None)])).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3]
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in rows)


def test_quality_is_learnt_and_held_out_rows_are_right(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        good = " ".join("".join(r.choice("aeiourst") for _ in range(5)) for _ in range(r.randint(5, 60)))
        bad = i % 3 == 0
        rows.append((i, good + (" ### $$$ &&&" * 3 if bad else "") + good))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None), (1001, ""), (None, "x"), (1001, "")]
    table = spark.createDataFrame([*labels, (None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    got = convnet.classified(frame(spark, rows), table).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 300]
    assert len(held) > 30 and np.mean([x.predicted == (x.doc_id % 3 != 0) for x in held]) > 0.95


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in convnet.classified(frame(spark, [(1, "a"), (2, None)]), none).collect()} == {0.5}


def test_very_long_text(spark):
    r = random.Random(9)
    text = " ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(60_000))
    docs = [(1, text), (2, text[:200_000])]
    assert {x.doc_id: x.component_id for x in trie_join.similar_groups(frame(spark, docs)).collect()} == {1: 1, 2: 2}
    assert {x.doc_id: x.n_removed for x in suffixes.removed(frame(spark, docs)).collect()} == {1: 0, 2: 200_000}


def test_many_rows_with_one_id(spark):
    text = "a string of a hundred bytes that all rows share, so that it is cut from every row but the first one.."
    rows = spark.createDataFrame([(None, 300_000, text), (5, 0, text)], "doc int, copy long, text string")
    far = rows.selectExpr("cast(coalesce(doc, 9) as long) doc", "copy", "text")
    assert [(r.doc, r.copy) for r in suffixes.repeated_ranges(far).collect()] == [(9, 300_000)]
    docs = spark.range(6000).selectExpr("cast(null as long) doc_id", "concat('same head ', id div 3 % 500) text").unionByName(frame(spark, [(1, "b"), (2, "c"), (2, "a")]).select("doc_id", "text"))
    got = copies_numbered(docs).collect()
    assert sorted(r.copy for r in got if r.doc_id is None) == list(range(6000))
    assert {(r.doc_id, r.text, r.copy) for r in got if r.doc_id} == {(1, "b", 0), (2, "a", 0), (2, "c", 1)}
    # as by the text itself, though no task orders the whole group
    texts = [r.text for r in sorted((r for r in got if r.doc_id is None), key=lambda r: r.copy)]
    assert texts == sorted(texts)


def test_stages_keep_columns_with_their_own_names(spark, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "other words altogether")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ["score", "held_out", "Predicted", "n_words", "hit_starts", "hit_ends", "item_ids", "n_hit", "n_items", "contaminated"]
    docs = spark.createDataFrame([(i, f"text {i}", *extra) for i in range(10)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    for stage in (corpus_pipeline.good_quality, corpus_pipeline.uncontaminated):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_further_stars_are_drawn_where_groups_meet_too_often(spark, monkeypatch):
    drawn, starred = [], trie_join.starred

    def counted(shared, groups, most, turn):
        drawn.append((shared.count(), None if groups is None else trie_join.meetings(shared, groups).agg({"n": "sum"}).first()[0]))
        return starred(shared, groups, most, turn)

    monkeypatch.setattr(trie_join, "starred", counted)
    monkeypatch.setattr(trie_join, "FEW", 0)
    docs = corpus(n=120)
    got = {r.doc_id: r.component_id for r in trie_join.similar_groups(frame(spark, docs)).collect()}
    monkeypatch.undo()
    assert got == {r.doc_id: r.component_id for r in trie_join.similar_groups(frame(spark, docs)).collect()}
    assert len(drawn) > 1 and drawn[1][0] < drawn[0][0] and drawn[1][0] == drawn[1][1]


def test_few_sets_are_read_beyond_the_wanted_ones(spark):
    docs = copies_numbered(spark.createDataFrame([(i, f"a b c d w{i}") for i in range(3000)], "doc_id long, text string"))
    often = spark.sparkContext.broadcast(np.zeros(1 << 8, np.int32))
    sets = trie_join.sets_of(docs, docs.filter("doc_id < 60").select("doc_id", "copy"), 5, often, 8)
    wanted = trie_join.sets_of(docs.filter("doc_id < 60"), docs.select("doc_id", "copy"), 5, often, 8)
    assert sets.join(wanted, "node", "left_semi").count() == 60 and sets.count() <= 65


@pytest.mark.parametrize("run", [trie_join.similar_groups, trie_join.one_per_group, suffixes.removed, suffixes.deduplicated, katz.scored])
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).count() == 0
