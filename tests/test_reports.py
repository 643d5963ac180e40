import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandmill.operators import reports as R

ARMS = ["arm_0", "arm_p"]


def report(**changes):
    row = {"signal": "fever", "null_to_true": {"mean_rate": 0.25}, "decisive": {"accuracy": {"mean": 0.5}}, "per_class_recall": {"true": {"mean": 0.75}}, "distribution": {"true": 3}}
    arm = {"name": "roberta@x@arm_p", "holdout": {"overall": {"accuracy": {"mean": 0.8}}, "by_signal": [{"signal": "other"}, row]}, "pooled": {"ruled": {"null_to_true": {"rate": 0.1}}}}
    return {"header": {"signal": "fever"}, "models": [{"name": "arm_0"}, arm, {"name": None}], "holdout_comparisons": [{"left": "m@arm_p", "right": "arm_0", "p": 0.04}, {"left": "arm_0", "right": "arm_p", "p": 1}]} | changes


def frame(spark, *given):
    return spark.createDataFrame([(f"r{i}", g if isinstance(g, str) else json.dumps(g)) for i, g in enumerate(given)], "path string, report string")


def test_reports_of_differing_shape_give_one_row_an_arm(spark):
    null = report(models=[{"name": "a@arm_0", "holdout": None}, {"name": "arm_p", "pooled": None}])
    text = report(models=[{"name": "arm_0"}, {"name": "arm_p", "pooled": {"ruled": {"null_to_true": {"rate": "n/a"}}}}])
    rows = {(r.path, r.arm): r for r in R.signal_scores(frame(spark, report(), null, text), ARMS).collect()}
    assert len(rows) == 6
    full = rows["r0", "arm_p"]
    assert (full.signal, full.scored, full.null_to_true, full.decisive, full.recall_true, full.recall_null, full.accuracy, full.synthetic_null_to_true, full.n_true) == ("fever", True, 0.25, 0.5, 0.75, None, 0.8, 0.1, 3)
    for key in (("r0", "arm_0"), ("r1", "arm_0"), ("r1", "arm_p"), ("r2", "arm_p")):
        assert not rows[key].scored and rows[key].accuracy is None and rows[key].synthetic_null_to_true is None


@pytest.mark.parametrize("broken, said", [("{", "readable"), (report(header={}), "no signal"), (report(models=None), "0 arms"), (report(models=[{"name": "arm_0"}, {"name": "x@arm_0"}, {"name": "arm_p"}]), "2 arms"), (report(header={"signal": "cough"}), "has no row for cough")])
def test_faults_raise_with_the_reports_path(spark, broken, said):
    with pytest.raises(PySparkException, match=said):
        R.signal_scores(frame(spark, broken), ARMS).collect()


def test_comparisons_are_found_in_either_order(spark):
    rows = R.paired_rows(frame(spark, report(), report(holdout_comparisons=[{"left": "arm_0", "right": "arm_c"}]), report(holdout_comparisons=None)), *ARMS).orderBy("path").collect()
    assert [(r.found, r.left, r.right, r.p) for r in rows] == [(True, "m@arm_p", "arm_0", 0.04), (False, None, None, None), (False, None, None, None)]
    assert R.paired_rows(frame(spark, report()), "arm_p", "arm_0").select(F.col("found")).first().found
