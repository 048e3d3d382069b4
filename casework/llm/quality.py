"""Quality rules by weak supervision.

Each rule looks at one trait of a text and votes good (1), bad (0) or abstains (-1). The votes of all documents are counted
by pattern (at most three to the number of rules), expectation-maximisation over these counts estimates how often each rule
votes bad among good and among poor documents, and a document is kept when its posterior probability of being good reaches
``threshold``. Only DataFrame expressions touch documents; the estimate itself runs over the pattern counts.

Defined cases: a null or empty text has no words and every rule abstains; a table without rows gives the prior alone; equal
texts get equal votes; repeated rows count as often as they occur. Other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from casework.operators.shape import settled

from .text import words

SYMBOLS = "[#*$%&|<>]"
UNSEEN = 1e-9  # stands for the share of a rule's bad votes where it has none


@dataclass(frozen=True)
class Rule:
    """Votes bad where 100 * amount >= bad * of, good where 100 * amount <= good * of, else abstains; both name features."""

    name: str
    amount: str
    of: str
    bad: int
    good: int

    def vote(self, f: Column) -> Column:
        amount, of = 100 * f[self.amount], f[self.of]
        return F.when(of == 0, -1).when(amount >= self.bad * of, 0).when(amount <= self.good * of, 1).otherwise(-1)


RULES = (
    Rule("symbols", "n_symbols", "n_words", bad=20, good=8),
    Rule("repeated_windows", "n_repeat_words", "n_words", bad=35, good=15),
    Rule("repeated_lines", "n_dup_lines", "n_lines", bad=60, good=20),
    Rule("capitals", "n_capitals", "word_chars", bad=30, good=12),
    Rule("exclamations", "n_exclamations", "n_words", bad=30, good=8),
    Rule("word_length", "word_chars", "n_words", bad=1500, good=1000),
)


def with_features(docs: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """``docs`` and a struct of counts over the whole text."""
    t, w, h, s, ln = (f"__{out}_{x}" for x in ("t", "w", "h", "s", "l"))
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(w, words(F.col(t)))
    df = df.withColumn(ln, F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(F.col(w))
    df = df.withColumn(
        h,
        F.when(
            n >= 3,
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.xxhash64(F.get(F.col(w), i), F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # windows with equal hashes lie side by side; most texts have none and skip the sort
    df = df.withColumn(
        s,
        F.when(
            F.size(F.array_distinct(F.col(h))) < F.size(F.col(h)),
            F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    same = lambda k, j: F.get(F.col(s), k)["h"].eqNullSafe(F.get(F.col(s), k + j)["h"])
    starts = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(F.col(s)) - 1), lambda k: F.when(k > 0, same(k, -1)).otherwise(False) | same(k, 1)),
        lambda k: F.get(F.col(s), k)["i"],
    )
    repeated = F.when(
        F.size(F.col(s)) > 0,
        F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))),
    ).otherwise(0)
    lines = F.col(ln)
    long = lambda x: x.cast("long")
    df = df.withColumn(
        out,
        F.struct(
            long(n).alias("n_words"),
            long(F.length(F.array_join(F.col(w), ""))).alias("word_chars"),
            long(F.regexp_count(F.col(t), F.lit(SYMBOLS))).alias("n_symbols"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            long(repeated).alias("n_repeat_words"),
            long(F.size(lines)).alias("n_lines"),
            long(F.regexp_count(F.col(t), F.lit("[A-Z]"))).alias("n_capitals"),
            long(F.regexp_count(F.col(t), F.lit("!"))).alias("n_exclamations"),
        ),
    ).drop(t, w, h, s, ln)
    return settled(df)  # else each use of a count repeats its derivation


def votes(features: Column, rules: Sequence[Rule] = RULES) -> Column:
    return F.array(*[r.vote(features).cast("byte") for r in rules])


@dataclass(frozen=True)
class LabelModel:
    """Latent kinds of document: kind 0 is good, kind j + 1 is poor in the way that rule j is there to notice.

    ``weight[k]`` is the share of kind k, ``bad[k][j]`` the chance that rule j, if it votes, votes bad on it.
    """

    weight: tuple[float, ...]
    bad: tuple[tuple[float, ...], ...]

    def shares(self, vote: Sequence[int]) -> list[float]:
        """Posterior of each kind."""
        p = []
        for weight, rates in zip(self.weight, self.bad, strict=True):
            for v, r in zip(vote, rates, strict=True):
                weight *= 1.0 if v < 0 else r if v == 0 else 1.0 - r
            p.append(weight)
        return [x / sum(p) for x in p]

    def posterior(self, vote: Column) -> Column:
        """Probability that a document with these votes is good."""
        p = []
        for weight, rates in zip(self.weight, self.bad, strict=True):
            x = F.lit(weight)
            for j, r in enumerate(rates):
                v = F.get(vote, F.lit(j))
                x = x * F.when(v == 0, r).when(v == 1, 1.0 - r).otherwise(1.0)
            p.append(x)
        return p[0] / sum(p[1:], p[0])


def estimate(
    patterns: dict[tuple[int, ...], int], n_rules: int, most_false: float = 0.002, rounds: int = 200, least_right: float = 0.95
) -> LabelModel:
    """Maximum a posteriori by expectation-maximisation over shares of vote patterns.

    Faults need not come together, so one poor class would leave a fault that shows in one rule alone to the good class.
    Each rule therefore has a poor kind of its own. On good documents it votes bad at most ``most_false`` of the time, and at least
    ``least_right`` of its bad votes fall to poor documents, however rare they are, which is what makes it a rule. Beta priors keep
    rates inside (0, 1); they are shares of all documents or of the rule's bad votes, so that neither the size of the corpus nor
    the share of a fault changes a verdict.
    """
    kinds = range(n_rules + 1)
    documents = sum(patterns.values())
    rows = sorted((vote, count / documents) for vote, count in patterns.items() if count)
    cast = [sum(x for vote, x in rows if vote[j] >= 0) for j in range(n_rules)]
    noticed = [sum(x for vote, x in rows if vote[j] == 0) for j in range(n_rules)]
    most = [min(most_false, (1 - least_right) * (n / c if n else UNSEEN)) for n, c in zip(noticed, cast, strict=True)]
    # prior shares of bad votes and of all votes, by kind and rule
    weak = [0.001 if k == 0 else 0.1 * (noticed[k - 1] or UNSEEN) for k in kinds]
    mean = [[0.001 if k == 0 else 0.9 if k == j + 1 else 0.25 for j in range(n_rules)] for k in kinds]
    model = LabelModel(
        tuple(0.9 if k == 0 else 0.1 / n_rules for k in kinds),
        tuple(tuple(min(x, most[j]) if k == 0 else x for j, x in enumerate(row)) for k, row in enumerate(mean)),
    )
    for _ in range(rounds):
        share = [0.001 if k == 0 else 0.1 * noticed[k - 1] or UNSEEN for k in kinds]
        bad, all_ = [[w * x for x in row] for w, row in zip(weak, mean, strict=True)], [[w] * n_rules for w in weak]
        for vote, count in rows:
            for k, q in enumerate(model.shares(vote)):
                share[k] += count * q
                for j, v in enumerate(vote):
                    if v >= 0:
                        all_[k][j] += count * q
                        bad[k][j] += count * q * (v == 0)
        rates = [[min(a / b, most[j] if k == 0 else 1.0) for j, (a, b) in enumerate(zip(bad[k], all_[k], strict=True))] for k in kinds]
        new = LabelModel(tuple(x / sum(share) for x in share), tuple(map(tuple, rates)))
        moved = max(abs(a - b) / max(a, b) for a, b in zip(sum(new.bad, new.weight), sum(model.bad, model.weight), strict=True))
        model = new
        if moved < 1e-9:
            break
    return model


def fit(voted: DataFrame, vote: str = "votes", n_rules: int = len(RULES)) -> LabelModel:
    """Estimates over the votes of all rows; only the counts of patterns (bounded by the rules) reach the driver."""
    rows = voted.groupBy(vote).count().collect()
    return estimate({tuple(r[0]): r[1] for r in rows}, n_rules)


def base_failed(f: Column, least_words: int = 50, most_repeated: int = 50) -> Column:
    return (f["n_words"] < least_words) | (100 * f["n_repeat_words"] > most_repeated * f["n_words"])


def judge(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, threshold: float = 0.5, model: LabelModel | None = None
) -> DataFrame:
    """``docs`` and __features, __votes, __good (posterior), __kept. Without ``model`` it is fitted on all of ``docs`` first."""
    df = with_features(docs, text, "__features").withColumn("__votes", votes(F.col("__features"), rules))
    model = model or fit(df, "__votes", len(rules))
    df = df.withColumn("__good", model.posterior(F.col("__votes")))
    return df.withColumn("__kept", ~base_failed(F.col("__features")) & (F.col("__good") >= threshold))
