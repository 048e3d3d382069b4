"""Artifact detection, plan building and plan selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casework.functions import paths, text
from casework.functions.flags import present
from casework.plans.catalog import (
    CHROMIUM_ROOTS, DETECTION_RULES, EDGE, HIVE_MAGIC, HIVE_NAMES, PARSER_FAMILIES, PathParts, Rule,
    tag_numbers, with_path_parts,
)

_CUSTOM_RULES: dict[str, tuple[str, str, str, Callable[[PathParts], Column]]] = {}


def register_rule(name: str, test: Callable[[PathParts], Column], family: str, artifact: str, grain: str = "file") -> None:
    """Add a detection rule given as a Column -> Column test; no Python runs per row."""
    _CUSTOM_RULES[name] = (family, artifact, grain, test)


def unregister_rule(name: str) -> None:
    _CUSTOM_RULES.pop(name, None)


def detect(
    files: DataFrame,
    rules: Sequence[Rule] = tuple(DETECTION_RULES),
    path: str = "os_path",
    content: str | None = None,
) -> DataFrame:
    """Every (file, family, artifact) the rules bind; one file may match several.

    One pass over the listing serves all rules, without join or shuffle: names and endings are looked up, other rules tested. Pass ``content`` to also test leading bytes; without it
    magic rules bind by name alone, so a metadata-only listing never reads file bodies.
    """
    df, parts = with_path_parts(files, path)
    head = F.hex(F.substring(F.col(content), 1, 4)) if content else None
    by_name, by_ext, tests = {}, {}, []
    for i, rule in enumerate(rules):  # most rules are a name or an ending alone: one look-up serves them all
        plain = not (rule.prefix or rule.suffix or rule.path_suffix or rule.contains or rule.excludes or rule.path_regex or (rule.magic and content))
        if plain and bool(rule.names) != bool(rule.exts):
            for key in rule.names or rule.exts:
                (by_name if rule.names else by_ext).setdefault(key, []).append(i)
        else:
            tests.append((i, rule.matches(parts, head)))
    labels = [dict(family=r.family, artifact=r.artifact, grain=r.grain) for r in rules]
    for family, artifact, grain, test in _CUSTOM_RULES.values():
        tests.append((len(labels), test(parts)))
        labels.append(dict(family=family, artifact=artifact, grain=grain))
    found = [_looked_up(parts.name, by_name), _looked_up(parts.ext, by_ext), present([F.when(test, F.lit(i)) for i, test in tests])]
    return tag_numbers(df, F.concat(*found), labels).select(*files.columns, "family", "artifact", "grain")


def _looked_up(key: Column, rules: dict[str, list[int]]) -> Column:
    """Numbers of the rules listed under a key."""
    none = F.array().cast("array<int>")
    if not rules:
        return none
    out = None
    for numbers in sorted(map(list, {tuple(n) for n in rules.values()})):
        keys = [k for k, n in rules.items() if n == numbers]
        here = F.array(*map(F.lit, numbers))
        out = F.when(key.isin(*keys), here) if out is None else out.when(key.isin(*keys), here)
    return out.otherwise(none)


def browser_kind(path: Column) -> Column:
    """chrome, edge, firefox or mac_chrome for a history database; null for other files."""
    p = paths.norm_path(path)
    history = p.endswith("/history")
    chromium = F.lit(False)
    for root in CHROMIUM_ROOTS:
        chromium = chromium | p.contains(root)
    return (
        F.when(history & p.contains(EDGE), "edge")
        .when(history & chromium, "chrome")
        .when(p.endswith("/places.sqlite") & p.contains("/mozilla/firefox/profiles/"), "firefox")
        .when(history & p.contains("/library/application support/google/chrome/"), "mac_chrome")
    )


def is_scheduled_task(path: Column) -> Column:
    p = paths.norm_path(path)
    job = paths.extension(paths.file_name(p)) == "job"
    return p.contains("/windows/system32/tasks/") | F.coalesce(p.contains("/windows/tasks/") & job, F.lit(False))


def is_hive(path: Column, content: Column) -> Column:
    name = text.ascii_lower(paths.file_name(path))
    return name.isin(*HIVE_NAMES) & F.coalesce(F.hex(F.substring(content, 1, 4)) == HIVE_MAGIC, F.lit(False))


def build_plans(detected: DataFrame, root: Sequence[str] = ("case_id",)) -> DataFrame:
    """One plan per root and artifact that has at least one file."""
    grouped = detected.groupBy(*root, "family", "artifact", "grain").agg(F.count("*").alias("n_files"))
    bindings = F.create_map(*[F.lit(x) for kv in PARSER_FAMILIES.items() for x in kv])
    return grouped.select(
        *root,
        "family",
        F.try_element_at(bindings, F.col("family")).alias("collection"),
        "artifact",
        text.sanitize_name(F.col("artifact")).alias("output_name"),
        F.concat_ws("::", "family", "artifact").alias("plan_id"),
        "grain",
        F.col("n_files").cast("bigint").alias("n_files"),
    )


def work_units(detected: DataFrame, order: str, root: Sequence[str] = ("case_id",), path: str = "os_path") -> DataFrame:
    """What a family processes: each file, or each distinct parent directory.

    Directories that differ only in case are one unit, under the spelling met first in ``order``.
    """
    by_dir = F.col("grain") == "directory"
    unit = F.when(by_dir, paths.parent_dir(F.col(path))).otherwise(F.col(path))
    key = F.when(by_dir, text.ascii_lower(unit)).otherwise(unit)
    return (
        detected.withColumns({"__unit": unit, "__key": key})
        .groupBy(*root, "family", "artifact", "grain", "__key")
        .agg(F.min_by("__unit", order).alias("unit"), F.count("*").alias("n_files"))
        .select(*root, "family", "artifact", "grain", "unit", F.col("n_files").cast("bigint").alias("n_files"))
    )


class NoPlanSelected(ValueError):
    """A selection was given but matches no detected plan."""


def select_plans(plans: DataFrame, ids: DataFrame | Sequence[str], check: bool = False) -> DataFrame:
    """Plans whose ``family::artifact`` id was selected.

    A short literal list becomes an ``IN`` filter, a table of ids a semi join. ``check`` runs a
    one-row probe and raises when an active selection leaves nothing.
    """
    if isinstance(ids, DataFrame):
        chosen = plans.join(ids.select(F.col(ids.columns[0]).alias("plan_id")), "plan_id", "left_semi")
    else:
        chosen = plans.where(F.col("plan_id").isin(*ids))
    if check and chosen.isEmpty():
        raise NoPlanSelected("no supported artifacts matched the selection")
    return chosen
