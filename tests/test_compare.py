import math

import numpy as np
import pytest

from granary.errors import ValidationError
from granary.functions.tails import chi2_sf, f_sf, normal_sf, t_two_sided
from granary.operators import compare as c


def groups(frame, *means, n=100, spread=5.0, seed=0):
    rng = np.random.default_rng(seed)
    names = [chr(97 + i) for i in range(len(means)) for _ in range(n)]
    values = np.concatenate([rng.normal(m, spread, n) for m in means])
    return frame("g string, v double", g=names, v=values)


def test_tails_match_published_tables():
    assert normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert t_two_sided(12.7062047, 1) == pytest.approx(0.05, abs=1e-8)
    assert f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_sf(3.238872, 3, 16) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(18.30703805, 10) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(124.342113, 100) == pytest.approx(0.05, abs=1e-6)
    assert t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert t_two_sided(40.0, 1e6) < 1e-200


def test_real_gap_between_two_groups(frame):
    found = c.compare_segments(groups(frame, 50, 60), "g", "v").facts
    assert found["name"] == "Welch t-test"
    assert found["significant"] and found["agrees"]
    assert abs(found["effect_size"]) > 1
    assert (found["best"], found["worst"]) == ("b", "a")


def test_three_alike_and_three_apart(frame):
    same = c.compare_segments(groups(frame, 50, 50, 50, seed=1), "g", "v").facts
    apart = c.compare_segments(groups(frame, 30, 50, 70), "g", "v").facts
    assert not same["significant"]
    assert apart["significant"] and apart["effect_size"] > 0.5
    assert apart["rank_name"] == "Kruskal-Wallis" and apart["rank_p_value"] < 1e-10


def test_ranks_are_the_same_however_they_are_bucketed(frame, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.where(rng.random(3000) < 0.4, 3.0, np.round(rng.normal(3, 2, 3000), 1))
    df = frame("g string, v double", g=rng.choice(["a", "b", "c"], 3000), v=x)
    plain = {tuple(r) for r in c.rank_sums(df, "g", "v").collect()}
    monkeypatch.setattr(c, "RANK_ROWS_PER_BUCKET", 100)
    assert {tuple(r) for r in c.rank_sums(df, "g", "v").collect()} == plain
    assert sum(r[2] for r in plain) == 3000 * 3001 / 2


def test_small_rank_tests_by_hand(frame):
    df = frame("g string, v double", g=["a"] * 3 + ["b"] * 3, v=[1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    found = c.compare_segments(df, "g", "v").facts
    assert found["rank_statistic"] == 0.0
    z = (9 - 4.5 - 0.5) / math.sqrt(9 / 12 * 7)
    assert found["rank_p_value"] == pytest.approx(2 * normal_sf(z))


def test_counts_against_equal_shares(frame):
    df = frame("g string", g=["a"] * 90 + ["b"] * 10)
    found = c.compare_segments(df, "g").facts
    assert found["statistic"] == pytest.approx(64.0)
    assert found["significant"] and found["expected_per_group"] == 50


def test_independence_uses_yates_for_two_by_two(frame):
    df = frame("a string, b string", a=["x"] * 50 + ["y"] * 50, b=["p"] * 30 + ["q"] * 20 + ["p"] * 20 + ["q"] * 30)
    found = c.compare_segments(df, "a", "b").facts
    assert found["dof"] == 1
    assert found["statistic"] == pytest.approx(4 * (5 - 0.5) ** 2 / 25)


def test_rejections(frame, sales):
    with pytest.raises(ValidationError, match="one group or none"):
        c.compare_segments(frame("g string, v double", g=["a"] * 5, v=[1.0] * 5), "g", "v")
    with pytest.raises(ValidationError, match="more than 30"):
        c.compare_segments(sales, "order_date", "revenue")
    with pytest.raises(ValidationError, match="No column"):
        c.compare_segments(sales, "region", "nope")


def test_information_ranks_signal_above_noise(frame):
    rng = np.random.default_rng(8)
    n = 400
    sex = rng.choice(["m", "f"], n)
    y = np.where(rng.random(n) < np.where(sex == "f", 0.8, 0.2), 1, 0)
    df = frame(
        "y long, sex string, measure double, noise double",
        y=y, sex=sex, measure=y + rng.normal(0, 0.5, n), noise=rng.random(n),
    )
    found = c.mutual_information(df, ["sex", "measure", "noise"], "y", "classification").collect()
    score = {r["column"]: r["mutual_information"] for r in found}
    assert score["sex"] > 0.1 and score["measure"] > 0.1
    assert score["noise"] < 0.01


def test_leaks_and_skewness(frame):
    x = np.arange(50.0)
    df = frame("x double, twice double, wave double", x=x, twice=2 * x + 1, wave=np.sin(x))
    assert c.is_leaky(df, "twice", "x") and not c.is_leaky(df, "wave", "x")
    assert c.skewness(df, ["x"]).first()["skewness"] == pytest.approx(0, abs=1e-12)
