"""Distribution objects over the Column functions: parameters are held, methods give expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinkline.functions import evt
from brinkline.functions.special import INF, NAN, col


def uniform_of(*keys, seed: int = 0) -> Column:
    """A number in (0, 1) that follows from the row's keys and the seed."""
    if not isinstance(seed, int) or isinstance(seed, bool):
        raise TypeError("a seed is an integer")
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


@dataclass(frozen=True)
class GeneralizedExtremeValue:
    loc: Column | float = 0.0
    scale: Column | float = 1.0
    concentration: Column | float = 0.0

    @property
    def _p(self):
        return self.loc, self.scale, self.concentration

    def log_prob(self, x) -> Column:
        return evt.gev_log_prob(x, *self._p)

    def prob(self, x) -> Column:
        return F.exp(self.log_prob(x))

    def cdf(self, x) -> Column:
        return evt.gev_cdf(x, *self._p)

    def icdf(self, q) -> Column:
        return evt.gev_icdf(q, *self._p)

    def survival(self, x) -> Column:
        return evt.gev_survival(x, *self._p)

    def hazard(self, x) -> Column:
        return evt.gev_hazard(x, *self._p)

    def cumulative_hazard(self, x) -> Column:
        return evt.gev_cumulative_hazard(x, *self._p)

    def mean(self) -> Column:
        return evt.gev_mean(*self._p)

    def variance(self) -> Column:
        return evt.gev_variance(*self._p)

    def stddev(self) -> Column:
        return F.sqrt(self.variance())

    def skewness(self) -> Column:
        return evt.gev_skewness(*self._p)

    def mode(self) -> Column:
        return evt.gev_mode(*self._p)

    def median(self) -> Column:
        return evt.gev_median(*self._p)

    def entropy(self) -> Column:
        return evt.gev_entropy(*self._p)

    def return_level(self, period) -> Column:
        return evt.gev_return_level(period, *self._p)

    def return_period(self, x) -> Column:
        return evt.gev_return_period(x, *self._p)

    def kurtosis(self) -> Column:
        return evt.gev_kurtosis(*self._p)

    def log_survival(self, x) -> Column:
        return evt.gev_log_survival(x, *self._p)

    def tail_index(self) -> Column:
        return evt.gev_tail_index(*self._p)

    def conditional_excess_mean(self, u) -> Column:
        return evt.gev_mean_excess(u, *self._p)

    def percentile_residual_life(self, t, share) -> Column:
        return evt.gev_percentile_residual_life(t, share, *self._p)

    def lower_bound(self) -> Column:
        return self.support()[0]

    def upper_bound(self) -> Column:
        return self.support()[1]

    def in_support(self, x) -> Column:
        low, high = self.support()
        return (col(x) >= low) & (col(x) <= high)

    def sample_by(self, *keys, seed: int = 0) -> Column:
        """A draw a row that follows from the row's keys alone, whatever the partitions."""
        return self.icdf(uniform_of(*keys, seed=seed))

    # the names that the families of reliability and risk use for the same quantities
    survival_function = reliability_function = exceedance_probability = survival
    log_survival_function = log_survival
    hazard_rate, cumulative_hazard_rate = hazard, cumulative_hazard
    mean_residual_life = conditional_excess_mean
    skew = skewness

    def support(self) -> tuple[Column, Column]:
        """(least, greatest) value."""
        loc, scale, xi = map(col, self._p)
        end = loc - scale / F.when(F.abs(xi) < evt.CUTOFF, F.lit(1.0)).otherwise(xi)
        return F.when(xi >= evt.CUTOFF, end).otherwise(-INF), F.when(xi <= -evt.CUTOFF, end).otherwise(INF)

    def sample(self, seed: int) -> Column:
        """A draw a row; reproducible for a fixed partitioning."""
        return self.icdf(F.rand(seed))


@dataclass(frozen=True)
class Frechet(GeneralizedExtremeValue):
    """Heavy upper tail: the concentration must be positive."""

    def __post_init__(self):
        if not isinstance(self.concentration, Column) and self.concentration <= 0:
            raise ValueError("the concentration must be positive")

    def hill_estimator_threshold(self, quantile: float = 0.95) -> Column:
        return self.icdf(quantile)

    def pareto_tail_approx(self, u) -> Column:
        """(scale, concentration) of the generalised Pareto tail beyond ``u``."""
        loc, scale, xi = map(col, self._p)
        return F.struct((scale + xi * (col(u) - loc)).alias("scale"), xi.alias("concentration"))

    def value_at_risk(self, alpha) -> Column:
        return self.icdf(alpha)

    def expected_shortfall(self, alpha) -> Column:
        level = self.value_at_risk(alpha)
        return level + self.conditional_excess_mean(level)

    def power_law_scaling(self, factor) -> Column:
        """By what the tail probability changes where values are multiplied by ``factor``."""
        return F.pow(col(factor), -1.0 / col(self.concentration))


@dataclass(frozen=True)
class Weibull(GeneralizedExtremeValue):
    """Bounded upper tail: the concentration must be negative."""

    def __post_init__(self):
        if not isinstance(self.concentration, Column) and self.concentration >= 0:
            raise ValueError("the concentration must be negative")

    def tail_index(self) -> Column:
        return F.lit(NAN)


class Gumbel(GeneralizedExtremeValue):
    def __init__(self, loc: Column | float = 0.0, scale: Column | float = 1.0):
        super().__init__(loc, scale, 0.0)

    def tail_index(self) -> Column:
        return F.lit(NAN)

    def interquartile_range(self) -> Column:
        return self.icdf(0.75) - self.icdf(0.25)

    def coefficient_of_variation(self) -> Column:
        return self.stddev() / F.abs(self.mean())

    def moment_generating_function(self, t) -> Column:
        return evt.gumbel_moment_generating(t, self.loc, self.scale)

    def characteristic_function(self, t) -> Column:
        return evt.gumbel_characteristic(t, self.loc, self.scale)

    def probability_paper(self, x) -> Column:
        return evt.gumbel_paper(x, self.loc, self.scale)


@dataclass(frozen=True)
class GeneralizedPareto:
    scale: Column | float = 1.0
    concentration: Column | float = 0.0

    @property
    def _p(self):
        return self.scale, self.concentration

    def log_prob(self, x) -> Column:
        return evt.gpd_log_prob(x, *self._p)

    def prob(self, x) -> Column:
        return F.exp(self.log_prob(x))

    def cdf(self, x) -> Column:
        return evt.gpd_cdf(x, *self._p)

    def icdf(self, q) -> Column:
        return evt.gpd_icdf(q, *self._p)

    def survival(self, x) -> Column:
        return evt.gpd_survival(x, *self._p)

    def hazard(self, x) -> Column:
        return evt.gpd_hazard(x, *self._p)

    def cumulative_hazard(self, x) -> Column:
        return evt.gpd_cumulative_hazard(x, *self._p)

    def mean(self) -> Column:
        return evt.gpd_mean(*self._p)

    def variance(self) -> Column:
        return evt.gpd_variance(*self._p)

    def mean_excess(self, u) -> Column:
        return evt.gpd_mean_excess(u, *self._p)

    def entropy(self) -> Column:
        return evt.gpd_entropy(*self._p)

    def mode(self) -> Column:
        return F.lit(0.0)

    def skewness(self) -> Column:
        return evt.gpd_skewness(*self._p)

    def kurtosis(self) -> Column:
        return evt.gpd_kurtosis(*self._p)

    def tail_index(self) -> Column:
        return evt.gpd_tail_index(*self._p)

    def lower_bound(self) -> Column:
        return F.lit(0.0)

    def upper_bound(self) -> Column:
        scale, xi = map(col, self._p)
        bounded = xi <= -evt.CUTOFF
        return F.when(bounded, -scale / F.when(bounded, xi).otherwise(-1.0)).otherwise(INF)

    def support(self) -> tuple[Column, Column]:
        return self.lower_bound(), self.upper_bound()

    def in_support(self, x) -> Column:
        return (col(x) >= 0) & (col(x) <= self.upper_bound())

    survival_function = exceedance_probability = survival
    hazard_rate, cumulative_hazard_rate, conditional_excess_mean = hazard, cumulative_hazard, mean_excess
    skew = skewness

    def sample_by(self, *keys, seed: int = 0) -> Column:
        return self.icdf(uniform_of(*keys, seed=seed))

    def return_level(self, period) -> Column:
        return evt.gpd_return_level(period, *self._p)

    def sample(self, seed: int) -> Column:
        return self.icdf(F.rand(seed))
