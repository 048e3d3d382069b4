"""The dealt operators against brute force, on small tables with every awkward case."""

import calendar
import hashlib
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from casework.llm import chat, components, fingerprints, hpylm, jaccard, lines, mixing, pieces, pii, quality, queries, sharding  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def texts(seed=3, n=60):
    """Copies, near copies, common lines, nulls, empty, blank and very long texts."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("th", "on", "Re", "é", "st") for b in ("an", "er", "ion", "x,", "U.")]
    make = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    base = make(90)
    out = [None, "", "  \n\t", "one", "one two", make(4000), base, base]
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(r.choice([" ".join(w), make(r.randint(3, 120)), "Shared LINE \n" + make(60) + "\n shared line\n\n" + make(5)]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(i * 3, x, "en", [None, "b", "a", ""][i % 4], len(x or "")) for i, x in enumerate(t)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_dict(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def by_id(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# 1


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_classes(docs, n, percent):
    t = by_id(docs)
    want = brute.classes(t, n, percent)
    got = as_dict(jaccard.jaccard_classes(docs, n, percent), "n_shingles", "component_id")
    assert got == {i: (len(brute.shingles(t[i], n)), want[i]) for i in t}


def test_jaccard_heavy_only_and_light_only(docs, monkeypatch):
    want = brute.classes(by_id(docs), 4, 85)
    for boundary in (0, 255):
        monkeypatch.setattr(jaccard, "choose_boundary", lambda *a, b=boundary: b)
        assert {i: c for i, (c,) in as_dict(jaccard.jaccard_classes(docs, 4, 85), "component_id").items()} == want


def test_jaccard_defined_cases(spark, docs, empty):
    assert jaccard.jaccard_classes(empty).count() == 0
    odd = docs.where("doc_id < 30").withColumn("doc_id", F.when(F.col("doc_id") == 21, None).otherwise(F.col("doc_id"))).withColumn("h", F.lit(1)).withColumn("key", F.lit(2))
    got = jaccard.jaccard_classes(odd.union(odd)).collect()
    assert len(got) == 2 * odd.count()
    assert all((r["component_id"] is None) == (r["doc_id"] is None) for r in got)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)]
    got = {x["vertex"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61))
    parent = {v: v for e in edges for v in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {v: got.get(v, v) for v in parent} == parent


# 2


def test_fingerprints_of_edits(docs):
    t = sorted(by_id(docs).items())
    got = as_dict(fingerprints.edited_pairs(docs), "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next")
    assert len(got) == len(t)
    for k, (i, x) in enumerate(t):
        x, y = x or "", t[(k + 1) % len(t)][1] or ""
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        assert got[i][:2] == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((got[i][3], edited), (got[i][4], y)):
            a, b = brute.shingles(x, 5), brute.shingles(other, 5)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    same = defaultdict(set)
    for i, x in t:
        same[x or ""].add(got[i][2])
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_merge_and_estimate(spark, docs, empty):
    marked = fingerprints.fingerprints(docs.where("length(text) > 0").withColumn("fingerprint", F.lit("x")), k=64)
    merged = fingerprints.merged(marked.withColumn("g", F.lit(1)), ["g"], k=64).first()["fingerprint"]
    every = sorted({h for r in marked.collect() for h in r["fingerprint"]})
    assert merged == every[:64]
    long = marked.where("length(text) > 10000").select(F.col("fingerprint").alias("a"), "text")
    row = long.select(fingerprints.distinct_shingles(F.col("a"), 64).alias("n"), fingerprints.resemblance(F.col("a"), F.col("a"), 64).alias("r"), fingerprints.containment(F.col("a"), F.col("a"), 64).alias("c"), "text").first()
    true = len(brute.shingles(row["text"], 5))
    assert abs(row["n"] - true) < 0.5 * true
    assert row["r"] == row["c"] == 1
    assert fingerprints.edited_pairs(empty).count() == 0
    one = spark.createDataFrame([(5, "a b", "", "", 3), (5, "a b", "", "", 3), (None, None, "", "", 0)], SCHEMA)
    assert fingerprints.edited_pairs(one).count() == 3


# 3


def test_chat(spark):
    rows = [(1, 0, "ann", "Hi <|im_start|>"), (1, 1, "bob", None), (1, 2, "ann", ""), (1, 2, "ann", ""), (1, None, None, "x"), (None, 0, "z", "alone"), (2, 200, "bob", "late"), (2, 1, "ann", "é")]
    out = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    at = {(r["conversation"], r["speaker"], r["part"]): r for r in out}
    assert set(at) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", -1), (1, "bob", -1), (None, "z", 0), (2, "ann", 0), (2, "bob", 0), (2, "ann", 3), (2, "bob", 3)}
    ann = at[1, "ann", 0]
    assert ann["rendered"] == (
        "<|im_start|>assistant\nHi <\\|im_start|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n" + 2 * "<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [ann["rendered"][s["begin"] : s["end"]] for s in ann["mask"]] == ["Hi <\\|im_start|><|im_end|>", "<|im_end|>", "<|im_end|>"]
    assert at[1, "bob", -1]["rendered"] == "<|im_start|>user name=unknown\nx<|im_end|>\n"
    assert at[2, "bob", 3]["n_learned"] == 1


# 4


def test_pii_round(spark):
    valid = {"card": "4111 1111 1111 1111", "phone": "+1 (017) 555-7713", "date": "2024-02-29", "ssn": "123-45-6789", "ip": "10.0.255.7", "email": "Ann.34@mail7.example.com"}
    bad = ["4111 1111 1111 1112", "2023-02-30", "666-12-3456", "300.1.2.3", "no@where", "12345"]
    text = "; ".join([*valid.values(), *bad]) + "."
    rows = [(1, text), (2, "seen 4111111111111111 twice 4111-1111-1111-1111"), (3, None), (4, ""), (5, "plain " * 5000)]
    got = {r["doc_id"]: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    new = dict((x["old"], x["new"]) for x in got[1]["__replaced"])
    assert set(new) == set(valid.values())
    assert all(b in got[1]["text"] for b in bad)
    want = text
    for o, n in new.items():
        want = want.replace(o, n)
    assert got[1]["text"] == want
    digits = lambda s: "".join(c for c in s if c.isdigit())
    card = digits(new[valid["card"]])
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(card)))) % 10 == 0
    assert [digits(x["new"]) for x in got[2]["__replaced"]] == [card, card]
    assert (got[3]["text"], got[4]["text"], got[5]["text"]) == (None, "", "plain " * 5000)


def test_pii_is_a_permutation(spark):
    df = spark.range(3000).select(F.col("id"), pii.permuted_pair(F.floor(F.col("id") / 50), F.col("id") % 50, 60, 50, "k", "t").alias("p"))
    got = {(r["p"]["a"], r["p"]["b"]) for r in df.collect()}
    assert len(got) == 3000
    assert all(0 <= a < 60 and 0 <= b < 50 for a, b in got)
    df = spark.range(1000).select(pii.permuted_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p"))
    assert {r["p"] for r in df.collect()} == {f"{i:03}" for i in range(1000)}


def test_pii_dates_are_a_permutation(spark):
    def is_date(y: int, m: int, d: int) -> bool:
        return 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]

    every = {f"{a:02}/{b:02}/{y}" for y in range(1900, 2102) for a in range(1, 32) for b in range(1, 32) if is_date(y, a, b) or is_date(y, b, a)}
    bad = {"02/30/2020", "13/13/2020", "00/05/2020", "05/00/2020", "02/29/2100", "29/02/1900", "31/04/2000", "32/01/2000", "01/05/1899", "01/05/2102"}
    df = spark.createDataFrame([(x,) for x in sorted(every | bad)], "text string").repartition(8)
    new = {r["text"]: r["p"] for r in df.select("text", pii.pseudonym(F.col("text"), "k").alias("p")).collect()}
    assert {new[x] for x in every} == every
    assert all(new[x] == x for x in bad)
    assert sum(new[x] == x for x in every) < 100


def test_pii_keeps_other_columns(spark):
    df = spark.createDataFrame([("a@b.de", 1, 2)], "text string, __found int, __new int")
    row = pii.pseudonymised(df, "k").first()
    assert (row["__found"], row["__new"]) == (1, 2)
    assert row["text"] != "a@b.de"


# 5


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
def test_pieces_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(4)
    some = [*texts(5, 20), *("".join(r.choice(a) for _ in range(r.randint(0, 90))) for a in ("ab \n", "a", "a-= ", "é漢🎉 a\t", "    x", "1².x") for _ in range(12))]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("key", F.lit(1))
    for chunk in (pieces.CHUNK, 40):
        got = pieces.decode(pieces.encode(df, chunk=chunk)).collect()
        assert len(got) == len(some)
        for row in got:
            assert row["ids"] == lib.encode(row["text"] or "")
            assert row["decoded"] == (row["text"] or "")


def test_pieces_when_words_are_let_go(monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    monkeypatch.setattr(pieces, "MOST_WORDS", 40)
    e = pieces.Encoder(pieces.Model.load())
    for t in [*texts(6, 40), None, "", "x" * 500]:
        rows = e.encode_all([t, t])
        assert rows.to_pylist() == [lib.encode(t or "")] * 2
        assert e.model.decode(rows) == [t or ""] * 2


def test_pieces_of_a_giant_without_spaces():
    e = pieces.Encoder(pieces.Model.load())
    t = pieces.normal("ababab" * 300)
    whole = e.encode("ababab" * 300)
    near = 2 * e.model.longest
    cut = [(t[max(0, b - near) : b + 50 + near], min(b, near), min(50, len(t) - b), b + 50 >= len(t)) for b in range(0, len(t), 50)]
    matrices = [e.transfer(*c) for c in cut]
    for group in (1, 3, 7):  # products of blocks lead to the same states
        blocks = [matrices[i : i + group] for i in range(0, len(matrices), group)]
        total = []
        for b in blocks:
            m = b[0]
            for x in b[1:]:
                m = pieces.product(m, x)
            total.append(m)
        outer = pieces.states(total, 0, None)
        states = [0]
        for b, begin, end in zip(blocks, outer, outer[1:]):  # noqa: B905
            states += pieces.states(b, begin, end)[1:]
        assert sum((e.between(*c, states[i], states[i + 1]) for i, c in enumerate(cut)), []) == whole


# 6


def test_mix(docs, empty):
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == docs.count()
    assert mixing.mix_documents(docs).orderBy("doc_id").collect() == sorted(rows, key=lambda r: r["doc_id"])
    taken, target, have = Counter(), {}, Counter()
    for r in rows:
        assert r["size"] == len(brute.words(by_id(docs)[r["doc_id"]]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        have[r["source"]] += r["size"]
    assert sum(target.values()) == pytest.approx(sum(have.values()))
    assert all(target[s] <= 3 * have[s] + 1e-9 for s in target)
    largest = max(r["size"] for r in rows if r["size"] < 1000)
    assert all(abs(taken[s] - target[s]) <= largest or have[s] > 4000 for s in target)
    assert mixing.mix_documents(empty).count() == 0


# 7


def test_language_model(docs, empty, spark):
    t = by_id(docs)
    tokens = {i: [*brute.words(brute.lower(x or "")), None] for i, x in t.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in t}
    c = Counter(w for i in t if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    got = as_dict(hpylm.score(docs, pack_bytes=20_000), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for i, w in tokens.items():
        base = sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert got[i][:4] == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert got[i][4] == pytest.approx(base)
        assert got[i][5] < 0
    same = defaultdict(set)
    for i, x in t.items():
        same[x or ""].add(round(got[i][5], 6))
    assert all(len(s) == 1 for s in same.values())
    # held-out texts of the same vocabulary are likelier than random bytes
    some = [i for i in t if held[i] and len(tokens[i]) > 20]
    assert all(got[i][5] > -len((t[i] or "").encode()) * np.log10(256) / 2 for i in some)
    assert hpylm.score(empty).count() == 0
    assert hpylm.score(docs.limit(3).union(docs.limit(3))).count() == 6


def test_language_model_knows_the_word_before(spark):
    # words that end alike, each followed by the same one: their frequencies say nothing, the word before says all
    r = random.Random(8)
    words = [f"{c}ation" for c in "bdfghklmnprstvwz"]
    after = dict(zip(words, r.sample(words, len(words)), strict=True))

    def text():
        w = [r.choice(words)]
        while len(w) < 40:
            w.append(after[w[-1]] if len(w) % 8 else r.choice(words))
        return " ".join(w)

    some = spark.createDataFrame([(i, text()) for i in range(120)], "doc_id long, text string")
    held = hpylm.score(some, pack_bytes=9_000).where("held_out").collect()
    assert len(held) > 5
    assert all(x["score"] > 0.7 * x["base_score"] for x in held)


@needs_tables
def test_language_model_beats_word_frequencies(spark):
    held = hpylm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    n, score, base = held.agg(F.sum("n_tokens"), F.sum("score"), F.sum("base_score")).first()
    assert score / n > base / n + 0.3


def test_lookup_of_wide_grams():
    r = np.random.default_rng(4)
    near, far = r.integers(0, 3, 5000).astype(np.uint64) << np.uint64(50), np.arange(5000).astype(np.uint16)
    look = hpylm.Lookup((near, far), np.arange(5000))
    assert (look[near, far] == np.arange(5000)).all()


def test_restaurants():
    rng = np.random.default_rng(1)
    r, w = np.divmod(np.arange(40), 8)
    c = rng.integers(0, 60, 40)
    level = hpylm.Level(r, c)
    base = np.full(40, 1 / 8)
    for _ in range(5):
        level.sweep(base, rng)
        assert ((level.t <= c) & (level.t >= np.minimum(c, 1))).all()
        # with every dish listed and a base that adds up to one, so do predictions
        assert np.allclose(np.bincount(r, level.predict(base)), 1)
    # two customers of one dish: chance of a second table is known
    one = hpylm.Level(np.zeros(1, int), np.array([2]), d=0.5)
    draws = []
    for _ in range(4000):
        one.sweep(np.array([0.25]), rng)
        draws.append(one.t[0])
    ways = (1 - 0.5) * (1.0) * 0.25, (1.0) * (1.0 + 0.5) * 0.25**2
    assert abs(np.mean(np.array(draws) == 2) - ways[1] / sum(ways)) < 0.03


# 8


def test_lines(docs, empty):
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    want = brute.drop_lines([r["text"] for r in rows], 10)
    got = as_dict(lines.drop_common_lines(docs.withColumn("line", F.lit(1)).withColumn("n", F.lit(2)), 10), "text", "__n_dropped", "line", "n", "source")
    assert got == {r["doc_id"]: (*w, 1, 2, r["source"]) for r, w in zip(rows, want, strict=True)}
    assert any(w[1] for w in want)
    assert lines.drop_common_lines(empty).count() == 0
    twice = docs.where("doc_id < 60")
    assert lines.drop_common_lines(twice.union(twice), 2).where("__n_dropped > 0").count() > 0


def test_lines_are_asked_once_for_equal_texts(spark):
    batch = pa.record_batch({"key": pa.array([b"a" * 16] * 500 + [b"b" * 16], pa.binary()), "text": pa.array([b"one\ntwo\none"] * 500 + [b"two"], pa.binary())})
    asked = pa.Table.from_batches(lines.questions(iter([batch, batch]), 1, {0: 7}, 1))
    assert sorted(asked.column("text_key").to_pylist()) == [b"a" * 16] * 2 + [b"b" * 16]
    rows = spark.createDataFrame([(i, "hot\ncommon") for i in range(300)] + [(300 + i, f"own {i}\ncommon") for i in range(9)] + [(400, "own")], "doc_id long, text string")
    got = as_dict(lines.drop_common_lines(rows, 10), "text", "__n_dropped")
    assert got == {**{i: ("", 2) for i in range(300)}, **{300 + i: (f"own {i}", 1) for i in range(9)}, 400: ("own", 0)}


def test_perfect_hash():
    keys = np.random.default_rng(2).integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    mph = lines.PerfectHash.build(keys)
    assert sorted(mph.index(keys)) == list(range(5000))
    assert len(lines.PerfectHash.build(keys[:0]).index(keys[:3])) == 3


# 9


def test_quality_features(docs, empty):
    t = by_id(docs)
    extra = docs.withColumn("features", F.lit(1)).withColumn("w", F.lit(1)).drop("features")
    got = as_dict(quality.with_features(extra).select("doc_id", "features.*"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == {i: brute.quality(x) for i, x in t.items()}
    assert quality.judge(empty).count() == 0


def test_quality_estimate():
    good, noisy, repeated = (1, 1, 1), (0, 1, 1), (1, 0, 0)
    model = quality.estimate({good: 900, noisy: 60, repeated: 40, (-1, -1, -1): 5}, 3)
    p = {v: model.shares(v)[0] for v in (good, noisy, repeated)}
    assert p[good] > 0.9 > 0.5 > max(p[noisy], p[repeated])
    assert quality.estimate({}, 3).shares(good)[0] > 0.5


def test_quality_verdict_is_the_same_at_any_size_and_share():
    for rule in (0, 4):
        lone = tuple(int(j != rule) for j in range(6))
        for share in (0.0002, 0.0005, 0.001, 0.003, 0.01, 0.05):
            p = []
            for n in (10**4, 10**5, 3 * 10**6, 10**7):
                model = quality.estimate({(1,) * 6: n - round(n * share), lone: round(n * share)}, 6)
                assert model.shares((1,) * 6)[0] > 0.9
                p.append(model.shares(lone)[0])
            assert max(p) < 0.5
            assert max(p) - min(p) < 1e-6
    # a fault that the estimate has not met is one too, and a model of a mix does not depend on how often it is repeated
    mix = {(1,) * 6: 97_000, (0, 1, 1, 1, 1, 1): 20, (1, -1, 0, 1, 1, -1): 2900, (-1,) * 6: 80}
    one, many = quality.estimate(mix, 6), quality.estimate({v: 1000 * c for v, c in mix.items()}, 6)
    assert one.weight == pytest.approx(many.weight)
    assert one.shares((1, 1, 1, 1, 1, 0))[0] < 0.5 < one.shares((-1,) * 6)[0]


@needs_tables
def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    kept = queries.op9_quality_rules(spark, d).where("not base_failed")
    both = kept.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("kept", "quality").count().collect()
    n = {(r["kept"], r["quality"]): r["count"] for r in both}
    assert n.get((False, 1), 0) == 0
    assert n.get((True, 0), 0) <= 0.05 * n[True, 1]


# 10


def test_capacity_against_brute_force():
    r = random.Random(6)
    for _ in range(150):
        keys = sorted({f"{r.randrange(16 ** 4):04x}{r.randrange(16 ** 4):04x}" for _ in range(r.randint(1, 120))})
        size = {k: r.choice([1, 3, 10, 200]) * r.randint(1, 9) for k in keys}
        shards = r.randint(1, 9)

        def sums(digits, within=None):
            found = defaultdict(list)
            for k in keys:
                if within is None or k[: digits - 1] in within:
                    found[k[:digits]].append(size[k])
            return [(p, sum(v), len(v) == 1) for p, v in found.items()]

        split = lambda ps: [x for d in sorted({len(p) for p in ps}) for x in sums(d + 1, {p for p in ps if len(p) == d})]
        capacity, known = sharding.smallest_capacity(sums(1), split, shards)
        assert capacity == brute.smallest_capacity([size[k] for k in keys], shards)
        cuts = [0, *sharding.even_cuts(known, capacity, shards), len(known.nodes)]
        assert all(known.ends[b] - known.ends[a] <= capacity for a, b in zip(cuts, cuts[1:]))  # noqa: B905


def test_shards(docs, empty):
    rows = sharding.shard_documents(docs.union(docs.limit(7)), shards=6).collect()
    assert len(rows) == docs.count() + 7
    t = by_id(docs)
    slots, where, load = defaultdict(list), {}, Counter()
    for r in rows:
        body = (t[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 8, zlib.crc32(body))
        slots[r["shard"]].append(r["slot"])
        assert where.setdefault(body, r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


# the queries and the pipeline


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((key(r) for r in got.select(*columns).collect())) == sorted(key(r) for r in want)


def test_pipeline_stages(spark, docs, empty):
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, "")
        assert out.count() == 0, name
        assert i == 4 or out.columns == list(corpus_pipeline.COLUMNS)


@needs_tables
def test_pipeline_against_brute_force(spark, monkeypatch):
    seen = []
    table = spark.read.parquet(f"{SF}/documents.parquet")
    df = table
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF).cache()
        seen.append(df)
    before = {r["doc_id"]: r["text"] for r in table.collect()}
    good = {r["doc_id"]: r["text"] for r in seen[0].collect()}
    assert all(good[i] == before[i] for i in good)
    bad = [brute.quality(before[i]) for i in before if i not in good]
    assert 0 < len(bad) < 0.4 * len(before)
    ids = sorted(good)
    lined = {r["doc_id"]: r["text"] for r in seen[1].collect()}
    assert lined == {i: w[0] for i, w in zip(ids, brute.drop_lines([good[i] for i in ids], 10), strict=True)}
    root = brute.classes(lined, 5, 80)
    single = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    assert single == {i: lined[i] for i in lined if root[i] == i}
    copies = Counter(r["doc_id"] for r in seen[3].collect())
    assert set(copies) <= set(single)
    assert max(copies.values()) <= 3
    total = sum(len(brute.words(single[i])) for i in single)
    assert abs(sum(len(brute.words(single[i])) * k for i, k in copies.items()) - total) < 0.1 * total
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    final = seen[4].collect()
    assert Counter(r["doc_id"] for r in final) == copies
    assert all(r["ids"] == lib.encode(single[r["doc_id"]]) for r in final)
