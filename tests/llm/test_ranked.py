"""Treap search against scoring every document."""

import re
import tracemalloc
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from casework.llm import ranked
from casework.llm.scratch import stored
from casework.llm.treap import Treap


def grid(seed, rows, columns, n, top=50):
    r = np.random.default_rng(seed)
    cells = r.choice(rows * columns, min(n, rows * columns), replace=False)
    return cells // columns, cells % columns, r.integers(1, top, len(cells))


@pytest.mark.parametrize("rows, columns, n", [(1, 1, 1), (1, 9, 5), (300, 1, 40), (7, 64, 200), (1000, 100, 3000), (5, 2048, 6000)])
def test_treap_finds_what_scoring_all_columns_finds(rows, columns, n):
    y, x, v = grid(n, rows, columns, n)
    treap = Treap.unpacked(Treap.of(y, x, v, (rows, columns)).packed())
    dense = np.zeros((rows, columns), np.int64)
    dense[y, x] = v
    for seed in range(12):
        r = np.random.default_rng(seed)
        asked, weights = r.integers(0, rows, r.integers(1, 9)), None
        asked = np.unique(asked)
        weights = r.integers(1, 4, len(asked))
        sums = (dense[asked] * weights[:, None]).sum(axis=0)
        for k, least, batch in ((1, 1, 1), (5, 1, 2), (20, 1, 128), (3, 60, 7)):
            order = [c for c in np.lexsort((np.arange(columns), -sums)) if sums[c] >= least][:k]
            found, got = treap.best_columns(asked, weights, k, least, batch)
            assert found.tolist() == order and got.tolist() == sums[order].tolist()


def test_a_cell_holds_the_maximum_below_it():
    y, x, v = grid(3, 60, 60, 500)
    treap = Treap.of(y, x, v, (60, 60))
    assert treap.maxima[0] == v.max() and treap.maxima[-1] == 0
    inner = np.flatnonzero(treap.masks)
    for c in inner:
        below = treap.child(np.full(4, c), np.arange(4))
        assert treap.maxima[c] == treap.maxima[below].max()


def by_hand(docs, items, k):
    split = lambda t: re.findall(ranked.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(d, Counter(split(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 75 + 25 * c.total() * n // total
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def sample():
    r = np.random.default_rng(8)
    vocabulary = ["the", "of", "Éa", "x1", "naïve", "日本", *(f"w{i}" for i in range(60))]
    text = lambda n: " ".join(np.array(vocabulary)[np.minimum(r.geometric(0.06, n), len(vocabulary)) - 1])
    docs = [(i, text(int(r.integers(1, 80)))) for i in range(150)]
    docs += [(7, docs[3][1]), (7, docs[3][1]), (None, docs[3][1]), (None, None), (900, ""), (901, "--- ..."), (902, text(5000)), (903, "THE The the"), (904, docs[3][1])]
    items = [(0, text(12)), (1, "w59 the the"), (2, None), (3, ""), (4, "unknownterm"), (5, docs[3][1]), (5, docs[3][1] + "!"), (None, "w3-w4,W5"), (6, "the")]
    return docs, items


@pytest.mark.parametrize("block_docs, block_terms", [(2048, 1_000_000), (9, 1_000_000), (50, 300)])
def test_search_equals_scoring_every_document(spark, block_docs, block_terms):
    docs, items = sample()
    table = spark.createDataFrame([(d, t, "x", 3, 4) for d, t in docs], "doc_id long, text string, term string, score int, ids int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    got = ranked.search(ranked.build_index(table, block_docs=block_docs, block_terms=block_terms), asked, k=5).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(docs, items, 5)


def test_many_packs_in_several_waves_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEMS_PER_PACK", 2)
    monkeypatch.setattr(ranked, "BROADCAST_BYTES", 600)
    monkeypatch.setattr(ranked, "MOST_HELD", 3)
    docs, items = sample()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = ranked.search(ranked.build_index(table, block_docs=40), spark.createDataFrame(items, "item_id long, text string"), k=5).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(docs, items, 5)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame(x, s) for x, s in zip(sample(), ("doc_id long, text string", "item_id long, text string")))
    assert ranked.search(ranked.build_index(docs.limit(0)), items).count() == 0
    assert ranked.search(ranked.build_index(docs), items.limit(0)).count() == 0


def test_waves_stay_below_the_bound():
    half = ranked.BROADCAST_BYTES // 2
    assert ranked.waves([(0, half), (1, half), (2, 1), (3, 3 * half), (4, 5)]) == [[0, 1], [2], [3], [4]]


def test_a_treap_takes_few_bytes_a_cell():
    y, x, v = grid(4, 4000, 2048, 300_000, top=1_000_000)
    packed, peaks = Treap.of(y, x, v, (4000, 2048)).packed(), []
    for step in (lambda: Treap.of(y, x, v, (4000, 2048)).packed(), lambda: Treap.unpacked(packed).first):
        tracemalloc.start()
        step()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    treap = Treap.unpacked(packed)
    cells = len(treap.masks)
    assert treap.maxima.nbytes + treap.first.nbytes == 8 * cells
    assert peaks[0] < 60 * cells and peaks[1] < 26 * cells


def test_values_beyond_32_bits_keep_their_maxima():
    treap = Treap.of(np.array([0, 3]), np.array([1, 2]), np.array([5, 1 << 40]), (4, 4))
    assert treap.maxima[0] == 1 << 40 and treap.best_columns(np.array([3]), np.array([2]), 1)[1].tolist() == [1 << 41]


def test_few_rows_of_many_bytes_make_a_row_group(spark):
    rows = spark.range(12, numPartitions=1).select("id", F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.xxhash64("id", i)).alias("heavy"))
    groups = []
    for size in (None, 1 << 20):
        table = stored(rows, "heavy", size)
        assert table.agg(F.sum(F.size("heavy"))).first()[0] == 12 * 40_000
        groups.append(sum(pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in table.inputFiles()))
    assert groups[0] == 1 and groups[1] >= 4


def test_a_block_leaves_each_task_alone(spark):
    """Grids come in batches of many, treaps leave one by one: an index of several blocks equals that of one."""
    docs, items = sample()
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = ranked.build_index(table, block_docs=20)
    blocks = index.blocks.collect()
    assert len(blocks) >= 7 and sum(len(b.ids) for b in blocks) == index.n_docs == len([1 for _, t in docs if ranked.terms((t or "").encode())])
    counts = Counter(t for _, text in docs for t in set(ranked.terms((text or "").encode())))
    held = Counter()
    for b in blocks:
        assert list(zip(b.df, b.vocabulary)) == sorted(zip(b.df, b.vocabulary), key=lambda p: (-p[0], p[1].encode()))
        held.update({t.encode(): n for t, n in zip(b.vocabulary, b.df)})
    assert held == counts
