"""Key checks in the job that uses the keys.

``star_enrich`` keeps the fact's rows if every dimension key it meets is unique.
``KeyChecks`` counts the rows before and after each dimension's join with
``observe``: the counts come with the job that computes the result, without a
job or a shuffle of their own, and a repeated key is reported by its dimension's name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .enrich import star_enrich


class RepeatedKeyError(ValueError):
    """A dimension's key occurs more than once, so that a join to it has repeated rows."""


class KeyChecks:
    """Counts of one result's joins; ask for them after an action on the result."""

    def __init__(self) -> None:
        self._before: Observation | None = None
        self._after: dict[str, Observation] = {}

    def enrich(self, fact: DataFrame, dims: Mapping[str, tuple[DataFrame, str | list[str], Sequence[str]]]) -> DataFrame:
        """``star_enrich`` with a count of the rows, and of those without a key, at each join; ``dims`` by name."""
        if self._before is not None:
            raise ValueError("these checks are in use")
        self._before = Observation()
        nulls = {name: F.count_if(self._no_key(key)).alias(name) for name, (_, key, _) in dims.items()}
        out = fact.observe(self._before, F.count(F.lit(1)).alias("_rows"), *nulls.values())
        for name, dim in dims.items():
            self._after[name] = Observation()
            out = star_enrich(out, [dim]).observe(self._after[name], F.count(F.lit(1)).alias("rows"))
        return out

    @staticmethod
    def _no_key(key: str | list[str]):
        missing = F.lit(False)
        for c in [key] if isinstance(key, str) else key:
            missing = missing | F.col(c).isNull()
        return missing

    def report(self) -> dict[str, dict[str, int]]:
        """By dimension: rows before and after its join, and rows that had no key for it. Waits for the action."""
        rows, out = self._before.get["_rows"], {}
        for name, seen in self._after.items():
            after = seen.get["rows"]
            out[name] = {"before": rows, "after": after, "without_key": self._before.get[name]}
            rows = after
        return out

    def require_unique(self) -> None:
        """Raise if a join has repeated rows, naming the dimensions."""
        bad = {name: r["after"] - r["before"] for name, r in self.report().items() if r["after"] != r["before"]}
        if bad:
            raise RepeatedKeyError(", ".join(f"{name}: {n} rows more" for name, n in bad.items()))
