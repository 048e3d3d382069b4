"""What the language model's packs and buckets exchange: counts by brute force, size on disk."""

import random
import uuid
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("zstandard")

from casework.llm import hpylm, scratch  # noqa: E402


def texts(n, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(4000)]
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 400))) for _ in range(n)]


def grams(body, order):
    text = hpylm.END * (order - 1) + body
    return [text[i : i + order] for i in range(len(body))]


def spelled(last, gram, order):
    """A row of a bucket as the bytes it stands for."""
    b = int(gram).to_bytes(8, "big")
    return (bytes([last]) + b[:-1])[: order - 1][::-1] + b[-1:]


@pytest.mark.parametrize(("order", "buckets"), [(4, 7), (7, 3), (9, 7), (9, 3000)])  # many: some have words only, or none
def test_buckets_count_every_gram(spark, monkeypatch, order, buckets):
    rows = [(i, t) for i, t in enumerate([None, "", "ä\x00 é", "A  b", *texts(60), *texts(5)])]
    rows += [(None, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) text").repartition(3)
    asks = hpylm.asked(hpylm.packs(docs, 20_000), order, buckets).collect()
    bodies = [(hpylm.held_out(i), hpylm._body(t.encode() if t else None)) for i, t in rows]
    want = Counter({g: 0 for _, b in bodies for g in grams(b, order)})
    want.update(g for held, b in bodies if not held for g in grams(b, order))
    words = Counter({w: 0 for _, b in bodies for w in [*b.split(), hpylm.END]})
    words.update(w for held, b in bodies if not held for w in [*b.split(), hpylm.END])
    got, n_words = {}, []
    for row in asks:
        b = hpylm.Bucket([a.asDict() for a in row["asks"]], order)
        b.build()
        assert [len(level.c) for level in b.levels] == [len({spelled(x, g, order)[-n:] for x, g in zip(b.last, b.gram, strict=True)}) for n in range(order, 3, -1)]
        got |= {spelled(x, g, order): n for x, g, n in zip(b.last, b.gram, b.n.tolist(), strict=True)}
        n_words += b.word_n.tolist()
    assert got == dict(want)
    assert sorted(n_words) == sorted(words.values())
    # the same positions and n-grams, however few are held at a time
    stream, begin, length = hpylm._stream([b for _, b in bodies], order)
    whole = [(v, dict(zip(at.tolist(), key.tolist(), strict=True))) for v, at, key in hpylm._by_context(stream, begin, length, order)]
    monkeypatch.setattr(hpylm, "GROUP", 1000)
    monkeypatch.setattr(hpylm, "SLICE", 64)
    assert whole == [(v, dict(zip(at.tolist(), key.tolist(), strict=True))) for v, at, key in hpylm._by_context(stream, begin, length, order)]


def test_numbers_survive_pressing():
    r = np.random.default_rng(5)
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        assert hpylm._pressed(np.empty(0, kind))
        a = r.integers(0, np.iinfo(kind).max, 1000, kind)
        assert (hpylm._numbers(hpylm._planes(hpylm._pressed(a), 1000)) == a).all()


def test_seating_by_brute_force():
    d, others, base, c = 0.4, 2, 0.3, 7
    ways = {(0, 0): 1.0}
    for n in range(1, c + 1):
        for t in range(1, n + 1):
            ways[n, t] = ways.get((n - 1, t - 1), 0) + (n - 1 - d * t) * ways.get((n - 1, t), 0)
    want = np.array([ways[c, t] * np.prod([1 + d * (others + k) for k in range(t)]) * base**t for t in range(1, c + 1)])
    rng, level = np.random.default_rng(2), hpylm.Level(np.arange(2000).repeat(2), np.tile([c, 2], 2000), d=d)
    drawn = []
    for _ in range(10):
        level.t = np.tile([1, others], 2000)
        level.sweep(np.full(4000, base), rng)
        drawn.append(level.t[::2])
    got = np.bincount(np.concatenate(drawn), minlength=c + 1)[1:] / 20_000
    assert np.abs(got - want / want.sum()).max() < 0.015


def test_many_buckets(spark, monkeypatch):
    docs_text = ["", "", "one", *texts(8)]
    docs = spark.createDataFrame([(i, t or None) for i, t in enumerate(docs_text)], "doc_id long, text string")
    few = {r["doc_id"]: r for r in hpylm.score(docs).collect()}
    monkeypatch.setattr(hpylm, "BUCKET_BYTES", 50)
    many = {r["doc_id"]: r for r in hpylm.score(docs).collect()}
    assert len(many) == len(few) == 11
    for i, r in many.items():
        assert [r[k] for k in ("held_out", "n_tokens", "n_known", "train_tokens")] == [few[i][k] for k in ("held_out", "n_tokens", "n_known", "train_tokens")]
        assert r["base_score"] == pytest.approx(few[i]["base_score"])
        assert -len(docs_text[i]) * 3 - 3 < r["score"] < 0  # discounts are a bucket's own


def test_little_is_written(spark, monkeypatch, tmp_path):
    # before, a row for each n-gram that a pack asked for, and more tables of them: many times the text
    monkeypatch.setattr(scratch, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    rows = list(enumerate(texts(1000)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert hpylm.score(docs).where("score < 0").count() == 1000
    assert sum(p.stat().st_size for p in Path(tmp_path).rglob("*.parquet")) < 3 * sum(len(t) for _, t in rows)
