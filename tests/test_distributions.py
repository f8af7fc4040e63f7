"""Tail functions against textbook quantiles."""

import pytest

from lodestat.functions import dist


@pytest.mark.parametrize("value, expected", [
    (dist.norm_ppf(0.975), 1.959963985), (dist.t_ppf(0.975, 10), 2.228138852), (dist.t_two_sided(2.228138852, 10), 0.05),
    (dist.f_sf(4.102821, 2, 10), 0.05), (dist.chi2_sf(5.991465, 2), 0.05), (dist.chi2_sf(18.30704, 10), 0.05),
    (dist.studentized_range_sf(3.877676, 3, 10), 0.05), (dist.studentized_range_sf(3.633, 4, 1e6), 0.05),
    (dist.t_sf(0.0, 5), 0.5), (dist.fisher_exact_2x2(3, 1, 1, 3), 0.485714), (dist.fisher_exact_2x2(8, 2, 1, 5), 0.034965),
])
def test_known_points(value, expected):
    assert value == pytest.approx(expected, rel=2e-3)


def test_noncentral_t_reduces_to_central():
    assert dist.nct_cdf(1.5, 12, 0.0) == pytest.approx(1 - dist.t_sf(1.5, 12), abs=1e-6)


def test_against_commons_math(spark):
    jvm = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    assert dist.t_sf(1.7, 7.5) == pytest.approx(1 - jvm.TDistribution(7.5).cumulativeProbability(1.7), abs=1e-9)
    assert dist.f_sf(2.2, 3.0, 17.0) == pytest.approx(1 - jvm.FDistribution(3.0, 17.0).cumulativeProbability(2.2), abs=1e-9)
    assert dist.chi2_sf(3.3, 4.0) == pytest.approx(1 - jvm.ChiSquaredDistribution(4.0).cumulativeProbability(3.3), abs=1e-9)
