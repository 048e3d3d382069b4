"""Which filter removes what, over every order in which filters may run.

A document is the set of filters it fails. The filters applied so far are a state of the subset lattice, and applying one more
is an edge that removes the documents which pass the state and fail that filter. Orders that reach a state (forward) times
orders that leave the edge's end (backward) say in how many of all orders the edge is walked; Shapley sums weigh removals by
it, and the steps of an order are read from the same edges. So 2 ** n states are counted instead of n! orders, and what reaches
the lattice is one row of at most 2 ** n counts per part.

Defined cases: null text is empty; a null part is the empty string; a row without id has no smaller id and no label; rows of one
id and one text are no copies of each other and count each; an id with several labels has a trait if any of them says so; a
table without rows has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casework.operators.shape import settled

from .scratch import stored
from .text import UPPER, count_of, words

SYMBOLS = "[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2


def orders_through(n: int) -> list[int]:
    """For edge ``state * n + f`` the number of orders of all ``n`` filters that walk it; 0 where the state has f already."""
    full = (1 << n) - 1
    reach, leave = [1] + [0] * full, [0] * full + [1]
    for state in range(full):
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in reversed(range(full)):
        leave[state] = sum(leave[state | 1 << f] for f in range(n) if not state >> f & 1)
    return [0 if state >> f & 1 else reach[state] * leave[state | 1 << f] for state in range(full + 1) for f in range(n)]


def audit(df: DataFrame, filters: Sequence[str], orders: Sequence[Sequence[str]], mask: str, part: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row per part, order and step.

    ``mask`` has bit i where a row fails ``filters[i]``; ``measures`` are further amounts to sum over removed rows. Returns ``part``,
    filter_order, step, kept, removed, redundant, unique_fails, every measure, shapley (removals summed over all orders).
    """
    filters, n, names = list(filters), len(filters), ["__rows", *measures]
    amounts = {"__rows": F.lit(1), **measures}
    counts = df.groupBy(F.col(part).alias("__part"), F.col(mask).alias("__mask")).agg(*[F.sum(a.cast("long")).alias(m) for m, a in amounts.items()])
    cells = counts.groupBy("__part").agg(F.collect_list(F.struct("__mask", *names)).alias("__cells"))  # at most 2 ** n entries

    def total(test, m: str = "__rows") -> Column:  # noqa: ANN001
        return F.aggregate("__cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(test(c["__mask"]), c[m]).otherwise(0))

    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(1 << f).alias("bit")) for s in range(1 << n) for f in range(n)])
    def removed(e: Column, m: str) -> Column:
        return total(lambda k: (k.bitwiseAND(e["state"]) == 0) & (k.bitwiseAND(e["bit"]) != 0), m)

    walked = F.transform(edges, lambda e: F.struct(*[removed(e, m).alias(m) for m in names]))
    weights = F.array(*[F.lit(w).cast("long") for w in orders_through(n)])
    per_filter = lambda f: F.struct(
        total(lambda k: k.bitwiseAND(F.lit(1 << f)) != 0).alias("fails"),
        total(lambda k: k == (1 << f)).alias("only"),
        F.aggregate(
            F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"),
            lambda acc, s: acc + F.get(weights, s * n + f) * F.get(F.col("__edges"), s * n + f)["__rows"],
        ).alias("shapley"),
    )
    parts = settled(cells.withColumn("__edges", walked))
    parts = settled(parts.select("__part", "__edges", total(lambda k: F.lit(True)).alias("__all"), F.array(*[per_filter(f) for f in range(n)]).alias("__filters")))
    listed = F.array(*[F.array(*[F.lit(filters.index(f)) for f in o]) for o in orders])
    steps = parts.withColumn("__order", F.explode(listed)).withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    bit = lambda f: F.call_function("shiftleft", F.lit(1), f)
    state_of = lambda k: F.aggregate(F.slice("__order", F.lit(1), k), F.lit(0), lambda acc, f: acc.bitwiseOR(bit(f)))
    at = lambda k: F.get(F.col("__edges"), state_of(k) * n + F.get(F.col("__order"), k))
    f, here = F.get(F.col("__filters"), F.get(F.col("__order"), F.col("__step"))), at(F.col("__step"))
    gone = F.aggregate(F.sequence(F.lit(0), F.col("__step")), F.lit(0).cast("long"), lambda acc, k: acc + at(k)["__rows"])
    return steps.select(
        F.col("__part").alias(part),
        F.array_join(F.transform("__order", lambda i: F.get(F.array(*map(F.lit, filters)), i)), "").alias("filter_order"),
        (F.col("__step") + 1).alias("step"),
        (F.col("__all") - gone).alias("kept"),
        here["__rows"].alias("removed"),
        (f["fails"] - here["__rows"]).alias("redundant"),
        f["only"].alias("unique_fails"),
        *[here[m].alias(m) for m in measures],
        f["shapley"].alias("shapley"),
    )


def text_failures(text: str) -> dict[str, Column]:
    """Filters A to D over a column that holds a struct of ``text_counts``."""
    c = F.col(text)
    return {
        "A": c["n_words"] < LEAST_WORDS,
        "B": 100 * c["n_distinct"] < LEAST_DISTINCT * c["n_words"],
        "C": 100 * c["n_capitals"] > MOST_CAPITALS * c["n_chars"],
        "D": c["symbols"],
    }


def text_counts(body: str, tokens: str) -> Column:
    return F.struct(
        F.size(tokens).alias("n_words"),
        F.size(F.array_distinct(tokens)).alias("n_distinct"),
        count_of(F.col(body), UPPER).alias("n_capitals"),
        F.length(body).alias("n_chars"),
        F.rlike(F.col(body), F.lit(SYMBOLS)).alias("symbols"),
    )


def documents_with_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits of A to E), good, toxic of every document.

    Copies are found by one aggregate over hashes of texts, and joined back on (id, hash), of which a text has one, so a text that
    a third of all rows share is no hot key. Only ids, hashes and masks are shuffled.
    """
    body = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("body")
    )
    split = settled(body.withColumn("tokens", words(F.col("body"))))
    counted = settled(split.select("doc_id", "part", F.sha2(F.col("body").cast("binary"), 256).alias("key"), text_counts("body", "tokens").alias("counts")))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures("counts").values())]
    slim = stored(counted.select("doc_id", "part", "key", sum(bits[1:], bits[0]).alias("mask")), "audit-rows")

    with_id = slim.where(F.col("doc_id").isNotNull())
    first = with_id.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    traits = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    known = with_id.join(first, ["doc_id", "key"], "left").join(traits, "doc_id", "left").select(
        "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << len(bits))).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    return known.unionByName(slim.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
