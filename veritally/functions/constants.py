"""The scoring policy: every number that a score depends on, in one value that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Policy:
    """Fixed values; results equal the published policy only with these.

    A re-score under other values passes another Policy: nothing here is ever changed in place.
    """

    # Weight by design rank (4 randomised trial ... 14 none), and factors of a study's weight.
    design: dict = field(default_factory=lambda: {4: 1.00, 5: 0.55, 6: 0.30, 7: 0.18, 8: 0.12, 9: 0.07, 10: 0.03, 11: 0.015, 12: 0.004, 13: 0.0015, 14: 0.00})
    rob: dict = field(default_factory=lambda: {"low": 1.00, "some_concerns": 0.60, "high": 0.25})
    funding: dict = field(default_factory=lambda: {"independent": 1.00, "industry_other": 0.90, "undisclosed": 0.80, "brand_funded": 0.60})
    funding_other: float = 0.8
    access: dict = field(default_factory=lambda: {"full_text": 1.00, "sr_table": 0.85, "abstract_only": 0.55})
    access_other: float = 0.55
    inherited: float = 0.85
    # What a finding counts.
    benefit_meaningful: float = 1.0
    benefit_trivial: float = 0.3
    null_effect: float = -0.35
    harm: float = -1.0
    # Where a measured effect counts zero, and where it counts one.
    mid_smd: float = 0.20
    full_smd: float = 0.80
    mid_percent: float = 2.0
    full_percent: float = 8.0
    # Confidence, synthesis lift, disagreement, and the gate of human evidence.
    saturation: float = 1.5
    synthesis: float = 0.3
    disagreement: float = 0.4
    disagreement_full: float = 1.5
    gate: float = 0.5
    last_human_rank: int = 11
    # Dose credit under half the low end, at twice the high end, and for no dose range.
    dose_floor: float = 0.10
    dose_above: float = 0.60
    # The ladder of evidence in a product's own form.
    ladder: dict = field(default_factory=lambda: {1: 1.00, 2: 0.95, 3: 0.90, 4: 0.80, 5: 0.55, 6: 0.45, 7: 0.35, 8: 0.25, 9: 0.20, 10: 0.18, 11: 0.15, 12: 0.10, 13: 0.05, 14: 0.00})
    ladder_top: int = 3


POLICY = Policy()
