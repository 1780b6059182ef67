"""Reviews of one question that share their trials: the best-conducted of those that overlap, combined by precision."""

from __future__ import annotations

from math import exp, log, sqrt

import pandas as pd
from pyspark.sql import DataFrame

# The least methodology score, the share of trials that makes two reviews one source, and how many are combined.
FLOOR, SAME, COMBINED = 4, 0.5, 3


def overlap(a: set, b: set) -> float:
    """The larger of the corrected covered area and of the share of the smaller set in the other; 0 for an empty one."""
    shared, less = len(a & b), min(len(a), len(b))
    return max(shared / len(a | b), shared / less) if less else 0.0


def independent(sources: list[dict]) -> tuple[list[dict], list[tuple[str, str, float]]]:
    """The sources that stay, and (id, kept id, overlap) of the others; the best-conducted are looked at first.

    Of two that overlap the better stays: by methodology, then by trials, then the newer.
    """
    kept: list[dict] = []
    dropped = []
    for s in sorted(sources, key=lambda s: -s["quality"]):
        clash = next((k for k in kept if overlap(k["trials"], s["trials"]) > SAME), None)
        if clash is None:
            kept.append(s)
            continue
        rank = [(x["quality"], x["trial_count"], x["year"]) for x in (clash, s)]
        win, lose = (clash, s) if rank[0] >= rank[1] else (s, clash)
        kept[kept.index(clash)] = win
        dropped.append((lose["id"], win["id"], round(overlap(clash["trials"], s["trials"]), 2)))
    return kept, dropped


def combine(sources: list[dict]) -> dict:
    """One estimate of the sources on the first one's metric, ratios on the scale of logarithms.

    Where two intervals don't meet, the combined one is widened until it holds every estimate.
    """
    metric = sources[0]["metric"]
    same = [s for s in sources if s["metric"] == metric]
    pool = [s for s in same if s["quality"] >= FLOOR] or [max(same, key=lambda s: s["quality"])]
    kept, dropped = independent(pool)
    used = sorted(kept, key=lambda s: -s["quality"])[:COMBINED]
    to, back = (log, exp) if metric == "rr" else (float, float)
    errors = [(to(s["ci_high"]) - to(s["ci_low"])) / 3.92 for s in used]
    weights = [1 / e**2 if e > 0 else 1.0 for e in errors]
    points = [to(s["estimate"]) for s in used]
    mean, narrow = sum(w * x for w, x in zip(weights, points, strict=True)) / sum(weights), sqrt(1 / sum(weights))
    apart = any(a["ci_high"] < b["ci_low"] or b["ci_high"] < a["ci_low"] for i, a in enumerate(used) for b in used[i + 1 :])
    wide = max(narrow, max(abs(x - mean) for x in points) / 1.96) if apart else narrow
    ends = {f"{n}{tail}": round(back(mean + way * 1.96 * se), 4) for tail, se in (("", wide), ("_narrow", narrow)) for n, way in (("ci_low", -1), ("ci_high", 1))}
    excluded = [s["id"] for s in same if s["quality"] < FLOOR]
    return {"metric": metric, "estimate": round(back(mean), 4), **ends, "used": [s["id"] for s in used], "dropped": [f"{a}<{b}" for a, b, _ in dropped], "excluded": excluded, "disagreement": apart}


_RESULT = "metric string, estimate double, ci_low double, ci_high double, ci_low_narrow double, ci_high_narrow double, used array<string>, dropped array<string>, excluded array<string>, disagreement boolean"


def combined_effects(sources: DataFrame, outcome: str) -> DataFrame:
    """One row an outcome by :func:`combine`; ``sources`` has id, metric, estimate, ci_low, ci_high, year, quality,
    trial_count, trials (array), one row a review, taken in order of id.

    Which source overlaps which depends on those before it, so an outcome is one group; it has a few dozen reviews.
    """

    def of_group(group: pd.DataFrame) -> pd.DataFrame:
        rows = [{**r, "trials": set(r["trials"])} for r in group.sort_values("id").to_dict("records")]
        return pd.DataFrame([{outcome: group[outcome].iloc[0], **combine(rows)}])

    kind = sources.schema[outcome].dataType.simpleString()
    return sources.groupBy(outcome).applyInPandas(of_group, f"{outcome} {kind}, {_RESULT}")
