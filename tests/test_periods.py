"""Shares of errors by period, on the smallest tables."""

import pytest

from tessera.plans import registry


def test_shares_of_the_net_and_of_the_positive_excess_have_their_own_denominators(spark, sf):
    rows = {r.day: r for r in registry.queries()["excess_error_share"](spark, sf).collect()}
    total = rows.pop(None)
    assert (total.net_share, total.positive_share, total.net_min, total.net_max) == (100.0,) * 4
    assert total.n_slots == sum(r.n_slots for r in rows.values()) and total.excess == pytest.approx(sum(r.excess for r in rows.values()), abs=1e-2)
    assert sum(r.net_share for r in rows.values()) == pytest.approx(100, abs=1e-2)
    # days of both signs: the positive excess is larger than the net one, so its shares are smaller
    assert any(r.excess < 0 for r in rows.values()) == any(abs(r.net_share - r.positive_share) > 1e-3 for r in rows.values())
    assert all(r.net_min <= r.net_share <= r.net_max for r in rows.values())


def test_the_pooled_share_is_the_penalty_on_the_zoom_days(spark, sf):
    rows = {r.period: r for r in registry.queries()["calendar_penalty"](spark, sf).collect()}
    week, zoom = rows["whole week"], rows["zoom"]
    days = [r for k, r in rows.items() if k.startswith("day ")]
    assert week.share == 100 and sum(r.total for r in days) == pytest.approx(week.total, abs=1e-2)
    assert zoom.total == pytest.approx(rows["day 22"].total + rows["day 23"].total, abs=1e-3) and zoom.share == pytest.approx(100 * zoom.total / week.total, abs=0.05)
    seeds = [r for k, r in rows.items() if k.startswith("seed ")]
    # the pooled penalty is the seeds' mean; their shares have denominators of their own
    assert len(seeds) == 3 and sum(r.total for r in seeds) / 3 == pytest.approx(zoom.total, abs=1e-3)
    assert zoom.per_slot == pytest.approx(zoom.total / zoom.n_slots, abs=1e-5)


def test_what_needs_no_fit_runs_once(spark, sf):
    rows = registry.queries()["run_grid"](spark, sf).collect()
    seeds = {}
    for r in rows:
        seeds.setdefault(r.model, set()).add(r.seed)
    assert seeds == {"naive": {0}, "seasonal": {0}, "tod": {0}, "ar1": {0, 1, 2}, "cal": {0, 1, 2}}
    one = {r.seed: r.mae for r in rows if (r.series_id, r.model, r.split) == ("view", "ar1", "eval")}
    assert len(set(one.values())) == 3
