"""Sending rows through fitted trees with array look-ups.

Trees are flat arrays (feature, threshold, children) held as literals. A fold
over the levels moves a row from the root to its leaf in one expression, whose
size does not depend on the depth and which a pushed-down filter may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_text(values, kind: str) -> str:
    """SQL text of a constant array, folded once by the optimizer."""
    text = ",".join(repr(float(v)) if kind == "double" else str(int(v)) for v in values)
    return f"cast(split('{text}', ',') AS array<{kind}>)"


def literal_array(values, kind: str) -> Column:
    return F.expr(array_text(values, kind))


class FlatTrees:
    """Nodes of one or more trees side by side.

    ``op`` is 0 for ``x >= threshold``, 1 for ``x <= threshold`` and 2 for
    ``x == threshold``; the left child takes rows for which the test holds.
    Missing values fail every test.
    """

    SIGNS = {0: ">=", 1: "<=", 2: "="}

    def __init__(self, feature, threshold, op, left, right, roots, depth):
        self.feature, self.threshold, self.op = feature, threshold, op
        self.left, self.right, self.roots, self.depth = left, right, roots, depth

    def _step(self, x: str) -> str:
        feature, threshold = array_text(self.feature, "int"), array_text(self.threshold, "double")
        value, cut = f"get({x}, get({feature}, at))", f"get({threshold}, at)"
        ops = sorted(set(self.op))
        if len(ops) > 1:
            tests = " ".join(f"WHEN {o} THEN {value} {self.SIGNS[o]} {cut}" for o in ops)
            test = f"CASE get({array_text(self.op, 'int')}, at) {tests} END"
        else:
            test = f"{value} {self.SIGNS[ops[0]]} {cut}"
        return (
            f"CASE WHEN get({feature}, at) < 0 THEN at WHEN coalesce({test}, false) "
            f"THEN get({array_text(self.left, 'int')}, at) ELSE get({array_text(self.right, 'int')}, at) END"
        )

    def leaf(self, x: str, root: str) -> str:
        """Text of the leaf reached from ``root``."""
        if self.depth == 0:
            return root
        return f"aggregate(array_repeat(0, {self.depth}), {root}, (at, level) -> {self._step(x)})"

    def _root(self, slot: str | None) -> str:
        return f"{self.roots[0]}" if slot is None else f"get({array_text(self.roots, 'int')}, {slot})"

    def route(self, df: DataFrame, x: str, name: str, slot: str | None = None) -> DataFrame:
        """Add the leaf reached in the first tree, or in the tree numbered by ``slot``."""
        return df.withColumn(name, F.expr(self.leaf(x, self._root(slot))))

    def route_once(self, df: DataFrame, x: str, name: str, keep: list[str], slot: str | None = None):
        """The leaf as a generated column: a later filter reuses it instead of a copy of the fold."""
        return df.selectExpr(*keep, f"explode(array({self.leaf(x, self._root(slot))})) AS {name}")
