import math

import pytest
from pyspark.sql import functions as F

from propspark.functions import formulas
from propspark.functions.hashing import keyed_fold, keyed_gauss, keyed_uniform

COLS = "mw double, logp double, hbd double, hba double, cx double, ch double, rb double, tpsa double"
NAN = float("nan")


def one(spark, row, build):
    c = F.col
    return spark.createDataFrame([row], COLS).select(build(c).alias("v")).first()["v"]


@pytest.mark.parametrize("row, want", [
    ((None, None, None, None, None, None, None, None), 0),
    ((501.0, 5.1, 7.0, 6.0, 501.0, 2.0, None, None), 3),
    ((501.0, 5.1, 7.0, 6.0, None, None, None, None), 2),
    ((500.0, 3.1, 6.0, 6.0, 500.0, 1.0, None, None), 0),
    ((500.1, 3.1, 0.0, 0.0, None, -2.0, None, None), 1),
    ((NAN, NAN, NAN, NAN, NAN, NAN, NAN, NAN), 0),
])
def test_toxicity(spark, row, want):
    assert one(spark, row, lambda c: formulas.toxicity_category(c("mw"), c("logp"), c("hbd"), c("hba"), c("cx"), c("ch"))) == want


@pytest.mark.parametrize("row, want", [
    ((None,) * 8, 200.0), ((0.0,) + (None,) * 7, 200.0), ((100.0, 2.0, 1.0, 2.0, None, None, 3.0, None), 140.0),
    ((5000.0, 9.0, 0.0, 0.0, None, None, 0.0, None), 800.0), ((10.0, -9.0, 9.0, 9.0, None, None, 0.0, None), -100.0),
    ((100.0, NAN, 1.0, 2.0, None, None, 3.0, None), 120.0),
])
def test_boiling_point(spark, row, want):
    assert one(spark, row, lambda c: formulas.boiling_point(c("mw"), c("logp"), c("hba"), c("hbd"), c("rb"), noise_sd=0.0)) == want


@pytest.mark.parametrize("row", [(None,) * 8, (100.0, 2.0, 1.0, 2.0, None, None, 3.0, 50.0), (900.0, 9.0, 0.0, 0.0, None, None, 0.0, 300.0), (50.0, -9.0, 5.0, 5.0, None, None, 0.0, 0.0)])
def test_solubility(spark, row):
    mw, logp, hbd, hba, _, _, _, tpsa = row
    m = mw or 200
    lp = 0.1 * math.sqrt(m) - 1 if logp is None else logp
    log_s = 0.8 - 0.01 * (m - 100) - 0.5 * lp - 0.01 * (tpsa or 0) + 0.3 * ((hba or 0) + (hbd or 0))
    want = round(max(1e-10, min(100, 10 ** log_s)), 6)
    got = one(spark, row, lambda c: formulas.solubility_mol_per_l(c("mw"), c("logp"), c("hba"), c("hbd"), c("tpsa"), noise_sd=0.0))
    assert got == pytest.approx(want, abs=1e-9)


def test_noise_needs_key():
    with pytest.raises(ValueError):
        formulas.boiling_point(F.lit(1), F.lit(1), F.lit(1), F.lit(1), F.lit(1))


def test_keyed_noise(spark):
    df = spark.range(20_000)
    row = df.agg(F.avg(keyed_gauss(F.col("id"), 1, 2.0)).alias("m"), F.stddev_pop(keyed_gauss(F.col("id"), 1, 2.0)).alias("s")).first()
    assert abs(row["m"]) < 0.06 and abs(row["s"] - 2.0) < 0.05
    a = {r["id"]: r["u"] for r in df.select("id", keyed_uniform(F.col("id")).alias("u")).collect()}
    b = {r["id"]: r["u"] for r in df.repartition(11).select("id", keyed_uniform(F.col("id")).alias("u")).collect()}
    assert a == b and 0 <= min(a.values()) and max(a.values()) < 1
    folds = [r["count"] for r in df.groupBy(keyed_fold(F.col("id"), 5)).count().collect()]
    assert len(folds) == 5 and min(folds) > 3_700
