"""Event studies: the monthly cross-section (closes only) and the hourly bars (open/high/low/close)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.operators.events import cooldown, labels, moves, study, target_labels, target_moves
from crosstide.operators.outcomes import by_tier, close_only, on_bars
from crosstide.operators.signals import (
    DAILY_PARTS,
    DAILY_SIGNALS,
    HOURLY_SIGNALS,
    Thresholds,
    Windows,
    blocked_adv,
    composite_top,
    features,
    fires,
    liquid_tier,
    mark_of,
    warmup,
    with_adv,
)
from crosstide.plans.views import hourly, monthly
from crosstide.session import settle


@dataclass(frozen=True)
class Spec:
    windows: Windows
    thresholds: Thresholds
    signals: list[str]
    benchmark: object
    thresh: float
    horizon: int
    hold: int
    cool: int
    before: int
    after: int
    tail: int
    tier_top: int
    tier_step: int


MONTHLY = Spec(Windows(2, 6, 1, 12, 1, 1, 6, 6, 6), Thresholds(), DAILY_SIGNALS, 0, 0.50, 3, 3, 3, 2, 1, 3, 30, 1)
HOURLY = Spec(
    Windows(), Thresholds(z=1.0, mult=2.0), [s for s in HOURLY_SIGNALS if s != "S0_prod"], None, 0.50, 48, 48, 24, 168, 72, 360, 1, 24
)
# with the composite of all but a benchmark, the way the monthly study has it
HOURLY_S0 = replace(HOURLY, signals=HOURLY_SIGNALS, benchmark="0")


# target: rise within a horizon; fires are tested as far as the longest horizon reaches
MONTHLY_TARGETS = {"T1_50pct_3m": (0.50, 3), "T2_30pct_6m": (0.30, 6)}
HOURLY_TARGETS = {"T1_50pct_48h": (0.50, 48), "T2_30pct_96h": (0.30, 96)}


@dataclass
class Study:
    """Inputs of a study, written once: several outcomes read the same fires and labels."""

    spec: Spec
    panel: DataFrame
    axis: DataFrame
    n: int
    feats: DataFrame
    fires: DataFrame
    lo: int
    hi: int
    cache: dict = field(default_factory=dict)

    @property
    def tested(self) -> DataFrame:
        """The panel without the benchmark."""
        mark = self.spec.benchmark
        return self.panel if mark is None else self.panel.where(F.col("entity") != F.lit(mark))

    @property
    def labels(self) -> DataFrame:
        if "labels" not in self.cache:
            self.cache["labels"] = settle(labels(self.tested, self.n, self.spec.thresh, self.spec.horizon), "labels")
        return self.cache["labels"]

    @property
    def moves(self) -> DataFrame:
        if "moves" not in self.cache:
            self.cache["moves"] = settle(moves(self.labels, self.n, self.lo, self.hi, self.spec.tail), "moves")
        return self.cache["moves"]

    @property
    def cooled(self) -> DataFrame:
        if "cooled" not in self.cache:
            self.cache["cooled"] = settle(cooldown(self.fires, self.spec.cool), "cooled")
        return self.cache["cooled"]


def valid_range(n: int, w: Windows, horizon: int) -> tuple[int, int]:
    return warmup(w), n - 1 - horizon


def monthly_study(spark: SparkSession, sf: str, spec: Spec = MONTHLY) -> Study:
    panel, axis, n = monthly(spark, sf)
    lo, hi = valid_range(n, spec.windows, spec.horizon)
    feats = settle(features(panel, spec.windows, DAILY_PARTS), "features")
    top = composite_top(feats, panel, spec.benchmark, spec.windows.s0_w)
    tested = feats.where(F.col("entity") != F.lit(spec.benchmark))
    fired = settle(fires(tested, top, spec.signals, spec.thresholds, lo, hi), "fires")
    return Study(spec, panel, axis, n, feats, fired, lo, hi)


def hourly_study(spark: SparkSession, sf: str, spec: Spec = HOURLY) -> Study:
    panel, axis, n = hourly(spark, sf)
    lo, hi = valid_range(n, spec.windows, spec.horizon)
    feats = settle(features(panel, spec.windows), "features")
    top, tested = None, feats
    if spec.benchmark is not None:
        top = composite_top(feats, panel, spec.benchmark, spec.windows.s0_w)
        tested = feats.where(F.col("entity") != F.lit(spec.benchmark))
    fired = settle(fires(tested, top, spec.signals, spec.thresholds, lo, hi), "fires")
    return Study(spec, panel, axis, n, feats, fired, lo, hi)


def monthly_adv(study: Study) -> DataFrame:
    return with_adv(study.tested, look=6)


def hourly_adv(study: Study) -> DataFrame:
    return blocked_adv(study.tested)


def tiered(study: Study, trades: DataFrame, panel: DataFrame) -> DataFrame:
    s = study.spec
    tiers = liquid_tier(panel, "adv", s.tier_top, study.lo, study.hi, s.tier_step)
    return by_tier(trades, tiers, mark_of(F.col("t"), study.lo, s.tier_step))


def monthly_trades(study: Study) -> DataFrame:
    panel = settle(monthly_adv(study), "adv")
    return tiered(study, close_only(study.cooled, panel, study.n, study.spec.hold), panel)


def hourly_trades(study: Study) -> DataFrame:
    panel = settle(hourly_adv(study), "adv")
    return tiered(study, on_bars(study.cooled, panel, study.n, study.spec.hold), panel)


def with_targets(spec: Spec, targets: dict[str, tuple[float, int]]) -> Spec:
    """The spec with a horizon that all targets fit in."""
    return replace(spec, horizon=max(h for _, h in targets.values()))


def targets_study(study_: Study, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """The event study of several targets over the same fires: labels and moves of all of them from one pass each."""
    s = study_.spec
    labelled = settle(target_labels(study_.tested, study_.n, targets), "labels")
    moved = settle(target_moves(labelled, study_.n, study_.lo, study_.hi, s.tail), "moves")
    return study(labelled, moved, study_.fires, s.signals, s.cool, study_.lo, study_.hi, s.before, s.after, list(targets))
