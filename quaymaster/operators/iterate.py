"""Fixpoints: each round is written in the shared folder and read again, so lineage stays short and lost executors cost one round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import drop, staged

#: How many levels may be read one by one before they are written together.
APART = 6


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], name: str, rounds: int = 200) -> DataFrame:
    """step applied until the table does not change (by its row count and sums of its rows' hashes)."""
    now, mark = staged(start, name), None
    for _ in range(rounds):
        new = staged(step(now), name)
        h = F.xxhash64(*new.columns)
        got = tuple(new.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 32))).first())
        drop(now)
        now = new
        if got == mark:
            return now
        mark = got
    raise RuntimeError(f"{name} did not settle in {rounds} rounds")


def levels(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], name: str, most: int, back: int | None = None) -> list[DataFrame]:
    """The tables of each level, from start on, until one is empty: step(last level, all levels so far, or the last `back` ones). Levels
    so far are written together from time to time, so that a step reads few tables."""
    out = [staged(start, name)]
    seen = [out[0]]
    for _ in range(most):
        new = staged(step(out[-1], union(out[-back:] if back else seen)), name)
        if new.isEmpty():
            drop(new)
            break
        out.append(new)
        seen.append(new)
        if not back and len(seen) > APART:
            seen = [staged(union(seen), name)]
    return out


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
