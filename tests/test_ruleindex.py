"""The rule index against testing every rule on every path."""

import random
import re

import pytest
from pyspark.sql import functions as F

from casework.operators import inventory as inv
from casework.operators.detect import detect
from casework.plans import targets as T
from casework.plans.catalog import DETECTION_RULES, tag, with_path_parts
from casework.plans.ruleindex import ANY, RuleIndex, literal_components
from bindings.views import PATHS


@pytest.mark.parametrize(
    "regex, components",
    [
        (r"^windows/tasks/.+$", ["windows", "tasks"]), (r"^\$extend/\$usnjrnl/\$j\.bin$", ["$extend", "$usnjrnl", "$j.bin"]), (r"^users/[^/]+/ntuser\.dat$", ["users", ANY, "ntuser.dat"]),
        (r"\.(?:log|blf)$", []), (r"^(?:boot|efi/microsoft/boot)/bcd$", []), (r"^a/b[^/]*/c$", ["a"]), (r"^a/b", ["a"]), (r"^a/b\d/c$", ["a"]), (r"^a/(?:b/c|d)/e$", ["a"]), (r"^a|b/c$", []),
        (r"^a b/c-d_1/$", ["a b", "c-d_1"]),
    ],
)
def test_literal_components(regex, components):
    assert literal_components(regex) == components


def paths():
    r = random.Random(2)
    shapes = [p.lower().split("/", 1)[-1].replace("@u", "7").replace("@e", "31").replace("@q", "5").replace("@s", "2") for p in PATHS]
    words = ["windows", "system32", "users", "bob", "appdata", "local", "tasks", "config", "system", "x", "", "wbem", "repository001", "a.mof", "ntuser.dat", "recent", "y.lnk", "prefetch", "z.pf"]
    return shapes + ["/".join(r.choice(words) for _ in range(r.randint(1, 7))) for _ in range(1500)] + ["", "/", "windows", "windows/"]


def test_a_path_is_tested_on_few_rules_and_none_is_missed():
    regexes = [rx for _, _, rx in T.EXPECTED]
    index, tested = RuleIndex(regexes), 0
    for p in paths():
        some = index.candidates(p)
        tested += len(some)
        assert [i for i, rx in enumerate(regexes) if re.search(rx, p)] == [i for i in some if re.search(regexes[i], p)]
    assert tested < 0.1 * len(paths()) * len(regexes)


def test_hits_of_the_tree_equal_all_tests(spark):
    df = spark.createDataFrame([(p,) for p in paths()], "p string")
    regexes = [rx for _, _, rx in T.EXPECTED] + [t.regex for t in T.TARGETS] if hasattr(T, "TARGETS") else [rx for _, _, rx in T.EXPECTED]
    got = df.withColumn("f", F.split("p", "/")).select("p", RuleIndex(regexes).hits("p", "f").alias("n"))
    for r in got.collect():
        assert list(r.n) == [i for i, rx in enumerate(regexes) if re.search(rx, r.p)], r.p


def test_detection_equals_all_tests(spark):
    df = spark.createDataFrame([("c", "C/" + p) for p in paths()], "case_id string, os_path string")
    parted, parts = with_path_parts(df)
    rules = list(DETECTION_RULES)
    every = tag(parted, [r.matches(parts, None) for r in rules], [dict(family=r.family, artifact=r.artifact, grain=r.grain) for r in rules])
    columns = ["os_path", "family", "artifact", "grain"]
    got = sorted(map(tuple, detect(df).select(*columns).collect()))
    assert got == sorted(map(tuple, every.select(*columns).collect())) and len(got) > 40


def test_the_first_kind_of_a_collector_wins(spark):
    rules = [T.Target("c1", "a", "^users/[^/]+/x$", ("public",)), T.Target("c1", "b", "x$"), T.Target("c2", "c", "^users/.*$"), T.Target("c1", "d", "^users/[^/]+/x$")]
    df = spark.createDataFrame([("C/Users/Bob/x",), ("C/Users/Public/x",), ("C/users/bob/y",), ("x",)], "os_path string")
    got = sorted((r.os_path, r.collector, r.kind) for r in inv.find_targets(df, rules).collect())
    assert got == [("C/Users/Bob/x", "c1", "a"), ("C/Users/Bob/x", "c2", "c"), ("C/Users/Public/x", "c1", "b"), ("C/Users/Public/x", "c2", "c"), ("C/users/bob/y", "c2", "c"), ("x", "c1", "b")]
