
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tallyframe.operators import actuarial as act
from tallyframe.operators import checks
from tallyframe.plans.registry import _life, ledger


def test_star_transactions_balance_at_cost(spark):
    L = ledger(spark, SF_SMALL)
    assert checks.unbalanced_transactions(L.postings, txn=("txn_id", "line_no")).count() == 0


def test_survival_in_unit_interval_and_non_increasing(spark):
    lt = _life(spark)
    male = lt.where("table_id = 'male'")
    sp = act.survival_probs(male, 60).orderBy("t").collect()
    probs = [r.surv_prob for r in sp]
    assert all(0.0 <= p <= 1.0 for p in probs)
    assert all(a >= b for a, b in zip(probs, probs[1:]))
    table = act.life_table(lt).groupBy("table_id").agg(F.min("lx").alias("lo"), F.max("lx").alias("hi")).collect()
    assert all(0 <= r.lo <= r.hi == 100000.0 for r in table)


def test_joint_survival_years_bounded(spark):
    lt = _life(spark)
    hh = spark.createDataFrame([(1, 50, 35), (2, 90, 90), (3, 0, 0)], "household_id long, age_1 int, age_2 int")
    res = {r.household_id: r.years for r in act.joint_life_percentile(
        hh, lt.where("table_id = 'male'"), lt.where("table_id = 'female'")).collect()}
    assert all(y is not None and 0 <= y <= 149 for y in res.values())
    assert res[2] <= res[1] <= res[3]      # older couples have fewer years left
