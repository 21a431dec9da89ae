"""Tier lists and the feature-table builders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

import tickloom.plans.tiers.a20  # noqa: F401  (registers the columns)
import tickloom.plans.tiers.a50  # noqa: F401
import tickloom.plans.tiers.a100  # noqa: F401
import tickloom.plans.tiers.a200  # noqa: F401
import tickloom.plans.tiers.a500_candles  # noqa: F401
import tickloom.plans.tiers.a500_prices  # noqa: F401
import tickloom.plans.tiers.a500_regimes  # noqa: F401
from tickloom.operators.align import fill_gaps
from tickloom.plans.registry import FEATURES, GROUPS, build


def _span(first: int, last: int) -> list[str]:
    return [n for g in range(first, last + 1) for n in GROUPS.get(f"F{g:03d}", [])]


VIX_TIER = _span(13, 13)
A20 = _span(2, 6) + ["obv"]
A50 = A20 + _span(14, 25)
A100 = A50 + _span(27, 39)
A200 = A100 + _span(41, 64)
A500 = A200 + _span(66, 136)
TIERS = {"a20": A20, "a50": A50, "a100": A100, "a200": A200, "a500": A500, "vix": VIX_TIER}


def tier_columns(tier: str, lookahead: bool = False) -> list[str]:
    """Columns of a tier; the ones that read the future only on request."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}; known: {sorted(TIERS)}")
    return [n for n in TIERS[tier] if lookahead or not FEATURES[n].lookahead]


def feature_table(bars: DataFrame, tier: str | Iterable[str], vix: DataFrame | None = None, *,
                  lookahead: bool = False, warm_up: str = "drop", chunk_rows: int | None = None) -> DataFrame:
    """Feature table of a tier or of a list of columns.

    ``warm_up``: ``drop`` removes rows with any null, ``keep`` leaves them,
    ``fill`` carries values forward, ``fill_both`` then fills the head backward
    (which puts later values into earlier rows).  ``chunk_rows``: see ``registry.build``."""
    names = tier_columns(tier, lookahead) if isinstance(tier, str) else list(tier)
    out = build(bars, names, vix, chunk_rows)
    if tier == "vix":
        return out.filter("vix_percentile_60d is not null") if warm_up == "drop" else out
    if warm_up == "drop":
        return out.dropna(subset=names)
    if warm_up in ("fill", "fill_both"):
        return fill_gaps(out, names, back=warm_up == "fill_both")
    return out


__all__ = ["A20", "A50", "A100", "A200", "A500", "TIERS", "VIX_TIER", "feature_table",
           "tier_columns"]
