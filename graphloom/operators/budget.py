"""Token budgets and response shaping."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens per profile, shares per slot, and the limits of depth, items, keys and characters.
BUDGETS = {"compact": 300, "balanced": 1200, "debug": math.inf}
ALLOCATION = {"coreCode": 0.4, "dependencies": 0.25, "decisions": 0.2, "plan": 0.1, "episodeHistory": 0.05}
LIMITS = {"compact": (6, 10, 20, 1200), "balanced": (6, 30, 50, 4000), "debug": (20, math.inf, math.inf, math.inf)}


def fill(rows: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """(group, selected, used): items taken in order while they fit; those that don't are skipped.

    An ordered fold per group, so groups are lists of candidates for one answer, not data of a size.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["c"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["c"]).otherwise(acc["used"]).alias("used"), F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

    return rows.groupBy(group).agg(items.alias("items")).select(group, F.aggregate("items", start, step).alias("r")).select(group, F.col("r.n").alias("selected"), F.col("r.used").alias("used"))


def estimate(value: Any) -> int:
    """Tokens of a value as JSON, a quarter of its characters."""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)
    return -(-len(text) // 4)


def shape(value: Any, profile: str = "compact", depth: int = 0) -> Any:
    """A value cut to the profile's limits, with a mark where something was left out."""
    max_depth, items, keys, chars = LIMITS[profile]
    if depth > max_depth:
        return "[…depth limit]"
    if isinstance(value, str):
        return value if len(value) <= chars else value[: int(chars)] + "…"
    if isinstance(value, (list, tuple)):
        cut = list(value) if items == math.inf else list(value)[: int(items)]
        out = [shape(v, profile, depth + 1) for v in cut]
        return out + [f"…{len(value) - len(cut)} more items"] if len(value) > len(cut) else out
    if isinstance(value, dict):
        names = list(value) if keys == math.inf else list(value)[: int(keys)]
        out = {k: shape(value[k], profile, depth + 1) for k in names}
        if len(value) > len(names):
            out["…omitted"] = f"{len(value) - len(names)} more keys"
        return out
    return value


def prune(data: dict[str, Any], priorities: dict[str, str], budget: float) -> dict[str, Any]:
    """Drop low, then medium, then high fields until the data fits; required ones always stay."""
    out = dict(data)
    for level in ("low", "medium", "high"):
        for name in reversed([k for k in out if priorities.get(k, "medium") == level]):
            if estimate(out) <= budget:
                return out
            del out[name]
    return out


def allot(slots: dict[str, list[Any]], budget: float, shares: dict[str, float] = ALLOCATION) -> dict[str, list[Any]]:
    """Of each slot the items that fit its share of the budget, in order; those that don't fit are skipped."""
    out: dict[str, list[Any]] = {}
    for name, items in slots.items():
        left = budget * shares.get(name, 0.05)
        out[name] = []
        for item in items:
            if (cost := estimate(item)) <= left:
                out[name].append(item)
                left -= cost
    return out


def envelope(summary: str, data: Any, profile: str = "compact", priorities: dict[str, str] | None = None, hint: str | None = None) -> dict[str, Any]:
    """The answer of a call: shaped, pruned to its budget, with its estimated tokens."""
    shaped = shape(data, profile)
    if isinstance(shaped, dict) and priorities and profile != "debug":
        shaped = prune(shaped, priorities, BUDGETS[profile])
    out = {"ok": True, "profile": profile, "summary": summary, "data": shaped, "_tokenEstimate": estimate(shaped)}
    return out | ({"hint": hint} if hint else {})


def error(code: str, reason: str, recoverable: bool = True, profile: str = "compact") -> dict[str, Any]:
    return {"ok": False, "profile": profile, "summary": reason, "errorCode": code, "recoverable": recoverable, "data": None, "_tokenEstimate": estimate(reason)}
