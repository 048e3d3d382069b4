"""An index of path rules: each path is led by its folders to the few rules that can fit it, and only those are tested.

Rules are regular expressions over a lower-case path. Their leading components, as far as they are literal text or stand for any
one folder, become a tree of folders; a rule waits at the node where its literal part ends. A path walks down by comparing
components, which is cheap, and tests what waits along its way, once each. Rules without a literal begin wait at the root.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

ANY = "[^/]+"
FEW = 2  # no further branching for so few rules
_LITERAL = re.compile(r"(?:[^\\.\[\](){}|*+?^$]|\\[^a-zA-Z0-9])+")
_COMPONENT = re.compile(r"((?:\\.|\[(?:\\.|[^\]])*\]|\((?:\\.|\[(?:\\.|[^\]])*\]|\([^()]*\)|[^()\\\[])*\)|[^/\\\[(|])*)(/|$)")


def literal_components(regex: str) -> list[str]:
    """Components that every matching path begins with; ANY stands for any one. Literal text only up to the first that is not."""
    if not regex.startswith("^"):
        return []
    out, at = [], 1
    while at < len(regex):
        m = _COMPONENT.match(regex, at)
        if m is None:
            break
        part, whole = m[1], m[2] == "/" or (m[1].endswith("$") and not m[1].endswith("\\$"))
        part = part[:-1] if m[2] != "/" and whole else part
        if not whole or not (part == ANY or _LITERAL.fullmatch(part)):
            break
        out.append(part if part == ANY else re.sub(r"\\(.)", r"\1", part))
        at = m.end()
        if m[2] != "/":
            break
    return out


class RuleIndex:
    def __init__(self, regexes: Sequence[str]) -> None:
        self.regexes = list(regexes)
        self.rules = [(i, literal_components(r)) for i, r in enumerate(self.regexes)]

    def candidates(self, path: str) -> list[int]:
        """Numbers of the rules that are tested on a path."""
        waiting, rules = [], self.rules
        for k, folder in enumerate([*path.split("/"), None]):
            if len(rules) <= FEW:
                break
            waiting += [i for i, c in rules if len(c) == k]
            rules = [(i, c) for i, c in rules if len(c) > k and c[k] in (folder, ANY)]
        return sorted({*waiting, *(i for i, _ in rules)})

    def hits(self, path: str, folders: str) -> Column:
        """Ascending numbers of the rules that fit the column ``path``, whose components are in the column ``folders``.

        The tree is written as SQL text: one call to Spark instead of one per comparison.
        """
        return F.expr(f"array_compact({self._below(f'`{path}`', f'`{folders}`', 0, [], self.rules)})")

    def _below(self, path: str, folders: str, k: int, waiting: list[int], rules: list[tuple[int, list[str]]]) -> str:
        waiting = waiting + [i for i, c in rules if len(c) == k]
        rules = [(i, c) for i, c in rules if len(c) > k]
        if len(rules) <= FEW:
            return self._tested(path, [*waiting, *(i for i, _ in rules)])
        anywhere = [r for r in rules if r[1][k] == ANY]
        rest = self._below(path, folders, k + 1, waiting, anywhere) if anywhere else self._tested(path, waiting)
        names = sorted({c[k] for _, c in rules} - {ANY})
        branches = [f"WHEN {_text(n)} THEN {self._below(path, folders, k + 1, waiting, [r for r in rules if r[1][k] in (n, ANY)])}" for n in names]
        return f"CASE get({folders}, {k}) {' '.join(branches)} ELSE {rest} END" if branches else rest

    def _tested(self, path: str, rules: list[int]) -> str:
        tests = [f"IF({path} RLIKE {_text(self.regexes[i])}, {i}, NULL)" for i in sorted(rules)]
        return f"CAST(array({', '.join(tests)}) AS array<int>)"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
