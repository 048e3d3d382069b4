"""Filter audit against running every order by hand."""

from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from casework.llm import audit

DOCS = "doc_id long, text string, source string, mask int, part string, `first` string, good string"
LABELS = "doc_id long, quality int, toxic int"
WORDS = " ".join(f"word{i}" for i in range(250))


def sample():
    texts = [
        (1, WORDS, "a"), (2, WORDS, "a"), (3, WORDS, "b"), (None, WORDS, "b"), (3, WORDS, "b"), (4, None, None), (5, "", ""), (6, "short $ text", "a"),
        (7, "the " * 300, "a"), (8, WORDS.upper(), "a"), (9, WORDS + " #" + WORDS * 40, "a"), (10, "the " * 300, "b"), (None, None, None), (11, " \t\n ", "b"),
        (12, "UPPER | case " * 5, "b"), (12, "UPPER | case " * 5, "b"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, None), (3, 1, None), (6, None, 1), (None, 1, 1), (12, 1, 1), (99, 1, 1)]
    return texts, labels


def failures(texts):
    least = {}
    for d, t, _ in texts:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, _ in texts:
        t = t or ""
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        out.append("".join(
            n for n, bad in zip("ABCDE", (
                len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), d is not None and least[t] < d,
            )) if bad
        ))
    return out


def by_hand(texts, labels):
    fails = failures(texts)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows, shapley = {}, {}
    for part in {s or "" for _, _, s in texts}:
        own = [(d, f) for (d, _, s), f in zip(texts, fails) if (s or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                rows[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == f for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def run(spark, texts, labels):
    df = spark.createDataFrame([(d, t, s, 7, "x", "y", "z") for d, t, s in texts], DOCS)
    rows = audit.documents_with_failures(df, spark.createDataFrame(labels, LABELS))
    return audit.audit(rows, "ABCDE", list(permutations("ABCDE")), "mask", "part", {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


def test_audit_equals_every_order_by_hand(spark):
    texts, labels = sample()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in run(spark, texts, labels).collect()}
    assert got == by_hand(texts, labels)


def test_audit_of_nothing(spark):
    assert run(spark, [], []).count() == 0


def test_audit_sums_hold_at_every_state(spark):
    texts, _ = sample()
    for r in run(spark, texts, []).collect():
        assert r["removed"] + r["redundant"] >= r["unique_fails"] and r["good_lost"] == 0


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_each_order_walks_one_edge_a_level(n):
    counts = audit.orders_through(n)
    for level in range(n):
        assert sum(counts[s * n + f] for s in range(1 << n) if s.bit_count() == level for f in range(n)) == factorial(n)


def test_seven_filters_in_a_chosen_order(spark):
    """More filters than anyone lists orders of: states are counted, and only the asked order is printed."""
    df = spark.createDataFrame([(i % 128, "p") for i in range(300)], "m int, p string")
    names = [f"f{i}" for i in range(7)]
    got = audit.audit(df, names, [names], "m", "p", {}).orderBy("step").collect()
    assert [r["kept"] for r in got] == [sum(i % 128 % (2 << s) == 0 for i in range(300)) for s in range(7)]
    assert sum(r["shapley"] for r in got) == factorial(7) * sum(i % 128 != 0 for i in range(300))
