"""Queries of learners and tuning run at the published settings."""

import pytest

from punctua.operators import learners, tune
from punctua.plans import QUERIES, learned


class Asked(Exception):
    pass


@pytest.fixture
def asked(monkeypatch):
    """What a query asks of the learners, as (positional, named) arguments."""
    def stop(*args, **named):
        raise Asked(args, named)

    monkeypatch.setattr(learned, "train_test", lambda spark, sf: (None, None))
    monkeypatch.setattr(learned.split, "stratified_folds", lambda *args: args[1])
    monkeypatch.setattr(learned.u, "stage", lambda rows, name: rows)
    monkeypatch.setattr(learned.u, "work_path", lambda spark, name: name)
    for module, name in [(learners, "fit"), (learners, "early_stopped"), (learners, "out_of_fold"),
                         (tune, "nested_cv"), (tune, "final_tuning"), (tune, "cross_validate")]:
        monkeypatch.setattr(module, name, stop)

    def run(name, spark=None):
        with pytest.raises(Asked) as found:
            QUERIES[name](spark, "")
        return found.value.args

    return run


@pytest.mark.parametrize("query", [
    "m1_random_forest", "m2_extra_trees", "m3_boosting_depthwise", "m4_boosting_leafwise",
    "m5_boosting_symmetric", "m8_mlp", "m10_calibrated_svm"])
def test_learners_at_full_settings(asked, query):
    (name, _, params, _), _ = asked(query)
    assert params == learners.defaults(name)


def test_stack_and_early_stop(asked):
    bases = {n: {"params": learners.defaults(n), "iterations": 300} for n in learners.BOOSTING}
    (_, _, params, _), named = asked("m11_stacking")
    assert params["folds"] == 5 and named["specs"] == bases
    assert asked("m13_early_stopped_boosting")[0][-2:] == (2000, 50)
    assert asked("m14_refit_selected")[0][5] == 300
    assert asked("m11_stack_oof_rows")[0][1:3] == (bases, 2)  # the folds of its SQL
    assert asked("h8_meta_search")[0][:3] == (5, bases, 5)


def test_protocol_is_whole(asked, spark):
    assert asked("h7_nested_cv")[0][1] == tune.Protocol()
    assert asked("h9_final_tuning_frozen_test")[0][1] == tune.Protocol()
    _, folds, params, protocol, _ = asked("h3_inner_cv_boosting", spark)[0]
    assert folds == 3 and len(params) == 20 and protocol == tune.Protocol()
