"""Hand-checked numbers of the column functions."""

import pytest
from pyspark.sql import functions as F

from perilframe import assumptions as A
from perilframe.functions import curves, interim, interruption, profile, text

L = F.lit


def test_registry_values():
    assert A.WARMING["ssp245_2080"] == 2.1 and A.WARMING["ssp585_2080"] == 4.0
    assert A.SEA_LEVEL["gulf"]["ssp585_2080"] == 0.74 and A.SEA_LEVEL["global_mean"]["ssp126_2050"] == 0.22
    assert len(A.SOURCES) == 10 and len(A.SCENARIOS) == 10
    assert curves.annuity(25, 0.03) == pytest.approx(17.4131, abs=1e-4)


def test_damage_curves(value):
    assert value(curves.wind_damage(L(74.7))) == pytest.approx(0.5)
    assert value(curves.wind_damage(L(10.0))) == 0.0
    assert value(curves.flood_damage(L(50.0), L(0.0))) == 0.75
    assert value(curves.flood_damage(L(0.6), L(0.6))) == 0.0
    assert value(curves.flame_damage(L(4.0))) == 0.10


def test_profile_factors(value):
    s = lambda x: L(x).cast("string")
    n = L(None).cast("double")
    got = value(profile.wind_multiplier(s("masonry"), L(2015.0), s("metal"), L(2020.0), s("impact")))
    assert got == pytest.approx(0.85 * 0.9 * 0.85)
    assert value(profile.wind_multiplier(s("frame"), n, s("shingle"), L(2000.0), s("none"))) == 1.6
    assert value(profile.wind_multiplier(s("frame"), L(1990.0), s(None), n, s(None))) == pytest.approx(1.3 * 1.15)


def test_text(value):
    assert value(text.money_of(L("(1,200)"))) == -1200.0
    assert value(text.sov_money_of(L("(5)"))) is None
    assert str(value(text.date_of(L("3/4/21")))) == "2021-03-04"
    assert str(value(text.date_of(L("2020-1-9")))) == "2020-01-09"
    assert value(text.normal_name(L("The Palm Resort & Club"))) == "palm"
    assert value(text.storm_key(L("Hurricane Zeta roof"), L(2020))) == "storm:zeta:2020"
    assert value(text.coverage_class(L("Flood - Zone A"))) == "flood"


def test_interruption(value):
    assert value(interruption.downtime_days(L(0.10), L(365.0))) == 120.0
    assert value(interruption.downtime_days(L(0.40), L(365.0))) == pytest.approx(0.75 * 365)
    assert value(interruption.downtime_days(L(1.0), L(365.0))) == 365.0
    econ = {"value": L(10e6), "daily": L(1000.0), "anchor_days": L(365.0), "limit": L(100000.0), "region": L("global_mean")}
    s = value(interruption.split_expected(L(10e6), econ, A.BI_FLAT_MONTHS))
    assert (s.gross, s.waiting, s.overage) == pytest.approx((365000.0, 3000.0, 262000.0), rel=1e-9)


def test_season_walk_matches_loop(value):
    shape = A.BI_SEASON["caribbean"]
    for month, days in ((0, 10.0), (7, 120.0), (10, 365.0), (3, 900.0)):
        left, m, acc = days, month, 0.0
        while left > 0:
            take = min(left, 30.44)
            acc += shape[m % 12] * take
            left -= take
            m += 1
        assert value(interruption.season_days(L("caribbean"), L(month), L(days))) == pytest.approx(acc, rel=1e-9)


def test_humid_threshold_inverts_heat_index(value):
    for rh in (0.45, 0.6, 0.8):
        assert value(interim.heat_index_c(interim.dry_bulb_for(35.0, L(rh)), L(rh))) == pytest.approx(35.0, abs=1e-6)


def test_ladder(value):
    lad = F.array(*[L(float(x)) for x in (20e3, 40e3, 60e3, 80e3, 100e3, 150e3, 180e3, 200e3)])
    gross = value(curves.ladder_integral(lad))
    kept = value(curves.ladder_integral(lad, curves.capped(100e3)))
    assert kept < gross
    assert value(curves.ladder_freq_at(lad, 1.0)) == 0.5
