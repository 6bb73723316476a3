"""Packing, token counts and sharding."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import packing, sharding, token_counts, tokens
from quaymark.llm.text import utf8

HARD = [
    "", "don't 'sab  'll''s x'", "  a\n\n b \t c  ", "é ü\n", " ", "\n", "a  ", "'s't 're", " 'tis", "x'S", "½ ²3 ٣",
    "​　a  b", "<|endoftext|> a", "a <|endoftext|>\n\n b<|endoftext|><|endoftext|>'s", "<|endof", "text|>", "<|endoftext|>",
    "👍🏽 ok", "a'", "a b", "1'2", "\r\n'd", "…  …", "日本語 です。 次",
]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab '\n s.td1é", max_size=30)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_tokenizers(texts):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    coder = tokens.pieces()
    codes, counts, _ = coder.codes(*utf8(pa.array(texts + HARD, pa.string())))
    got = coder.ids(codes).tolist()
    assert got == [i for t in texts + HARD for i in whole.encode(t, add_special_tokens=False).ids]
    assert len(counts) == len(texts + HARD)


def docs(n=60, seed=2):
    r = random.Random(seed)
    texts = [None, "", *HARD]
    while len(texts) < n:
        texts.append(" ".join(r.choice(["alpha", "beta.", "gamma,\n", "delta!"]) for _ in range(r.choice([1, 10, 200, 3000]))))
    return list(enumerate(texts))


def test_every_id_lies_in_one_piece(spark, tokenizer):
    rows = [*docs(), (3, "again"), (3, "again"), (None, "no id")]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int").repartition(3)
    pieces = packing.pack(table, horizon=20_000, with_ids=True).collect()
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(p.length for p in pieces) == total and sum(p.start == 0 for p in pieces) == len(rows)
    texts = dict(rows[:-3])
    for i, text in texts.items():
        own = sorted((p for p in pieces if p.doc_id == i and p.doc_tokens == len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1), key=lambda p: p.start)
        if i == 3:
            continue
        ids = [x for p in own for x in p.ids]
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in own)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        size = sum(p.length for p in own)
        assert size <= 2048
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    assert padding < 0.01 * total + 2048


def test_cuts_are_the_cheapest():
    r = random.Random(5)
    for _ in range(60):
        at = np.unique([0, *(r.randrange(1, 60) for _ in range(14)), *range(8, 61, 8)])
        cost = np.array([r.choice([0, 3, 9]) for _ in at])
        best = {0: 0}
        for j in range(1, len(at)):
            best[j] = cost[j] + min(best[i] + 16 - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 16)
        found = packing.cuts(at, cost, 16, True)
        ends = [0, *found]
        price = dict(zip(at.tolist(), cost.tolist(), strict=True))
        assert all(b - a <= 16 for a, b in zip(ends, ends[1:], strict=False)) and found[-1] == at[-1]
        assert sum(price[b] + 16 - (b - a) for a, b in zip(ends, ends[1:], strict=False)) == best[len(at) - 1]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_are_allocated_by_the_rule(spark, tokenizer, rule):
    rows = [(i, "en", t, "s") for i, t in docs(30)] + [(1, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string")
    got = token_counts.count_tokens(table, rule=rule).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, lang, text, source in rows:
        whole = "\n".join([source or "", lang or "", text or ""])
        coded = tokenizer.encode(whole, add_special_tokens=False)
        own = sorted(by_doc[i, len(coded.ids)], key=lambda r: r.section)
        marks = [source or "", lang or "", *(text or "").split("\n")]
        begin = np.minimum(np.cumsum([0] + [len(m) + 1 for m in marks]), len(whole))
        want = np.zeros(len(marks))
        for a, b in coded.offsets:
            share = [max(0, min(b, begin[k + 1]) - max(a, begin[k])) for k in range(len(marks))]
            if rule == "split":
                want += np.array(share) / (b - a)
            elif rule == "most":
                want[int(np.argmax(share))] += 1
            else:
                want[max(k for k in range(len(marks)) if begin[k] <= a)] += 1
        assert [r.field for r in own] == ["source", "lang"] + ["text"] * (len(marks) - 2)
        assert sum(r.n_tokens for r in own) == pytest.approx(len(coded.ids))
        assert [r.n_tokens for r in own] == pytest.approx(want.tolist())


def test_shards_are_near_equal_and_gapless(spark):
    r = random.Random(4)
    rows = [(i, "x" * int(r.paretovariate(1.1) * 30)) for i in range(3000)] + [(None, None)] * 50 + [(7, "same")] * 20
    table = spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id long, text string, virtual_slot string")
    got = sharding.shard(table).collect()
    assert len(got) == len(rows)
    load, places = {}, {}
    for x in got:
        load[x.shard] = load.get(x.shard, 0) + x.size
        places.setdefault(x.shard, []).append(x.slot)
    assert set(load) == set(range(40)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    mean, largest = sum(load.values()) / 40, max(x.size for x in got)
    assert max(load.values()) <= max(1.01 * mean, mean + largest)
    texts = dict(rows[:3000])
    assert all(x.text_crc32 == zlib.crc32((texts[x.doc_id] or "").encode()) for x in got if x.doc_id not in (None, 7))


def test_rows_without_id_and_text_spread(spark):
    rows = [(i, "z" * (i % 90)) for i in range(10_000)] + [(None, None)] * 10_000
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(table).collect()
    load, places, slots = {}, {}, {}
    for x in got:
        load[x.shard] = load.get(x.shard, 0) + x.size
        places.setdefault(x.shard, []).append(x.slot)
        slots[x.virtual_slot] = slots.get(x.virtual_slot, 0) + 1
    assert len(got) == len(rows) and sum(x.doc_id is None for x in got) == 10_000
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) <= 1.01 * sum(load.values()) / 40 and max(slots.values()) < 10 * sharding.COPIES


def test_map_versions_are_edits(spark, tmp_path):
    rows = sharding.records(spark.createDataFrame([(i, "y" * (i % 50)) for i in range(2000)], "doc_id long, text string"), 128)
    sizes = sharding.slot_sizes(rows)
    first = sharding.first_map(spark, 128, 4)
    second = sharding.rebalanced(first, sizes, 4)
    third = sharding.rebalanced(second, sizes, 5)
    path = str(tmp_path / "map")
    for version in (first, second, third):
        sharding.save_version(version, path)
    assert sharding.load_version(spark, path).count() == 128
    assert {r.version for r in sharding.load_version(spark, path, 1).collect()} == {1}
    moved = sharding.edits(sharding.load_version(spark, path, 1), sharding.load_version(spark, path, 2)).collect()
    assert 0 < len(moved) < 64 and {r.to_shard for r in moved} <= set(range(5)) and any(r.to_shard == 4 for r in moved)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert packing.pack(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert token_counts.count_tokens(none).count() == 0
