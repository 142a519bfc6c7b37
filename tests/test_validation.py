import pytest
from pyspark.sql import functions as F

from propspark.functions import smiles as sm
from propspark.operators import validation

CASES = [
    ("CCO", None), ("c1ccccc1", None), ("", "non-empty"), (None, "non-empty"), ("XYZ123!!!", "Invalid SMILES"),
    ("CCO@#$", "Invalid SMILES"), ("[Na]", "2 atoms"), ("invalid", "Invalid"), ("invalid_smiles", "Invalid"),
    ("C CO", "Invalid characters"), ("CC(C", "Invalid SMILES"), ("C1CC", "Invalid SMILES"), ("C%12CCCCC%12", None),
    ("[NH4+].[Cl-]", None), ("[2H]O[2H]", "2 atoms"), ("N[C@@H](C)C(=O)O", None),
]


def test_smiles_cases(spark):
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "i int, s string")
    got = {r["i"]: r["c"] for r in rows.select("i", sm.check(F.col("s")).alias("c")).collect()}
    for i, (text, part) in enumerate(CASES):
        assert got[i]["valid"] == (part is None), text
        assert part is None or part in got[i]["error"], text


@pytest.mark.parametrize("mass, ok", [(5000.0, True), (5000.1, False), (0.0, False), (-1.0, False), (None, True), (float("nan"), False)])
def test_mass_limits(spark, mass, ok):
    row = spark.createDataFrame([("CCO", mass)], "s string, m double").select(sm.check(F.col("s"), F.col("m")).alias("c")).first()
    assert row["c"]["valid"] == ok


@pytest.mark.parametrize("value, low, high, part", [
    ("5.0", 0, 10, None), ("-1.0", 0, None, ">= 0.0, got -1.0"), ("15.0", None, 10, "<= 10.0, got 15.0"),
    ("abc", 0, 10, "numeric"), (None, 0, 10, "numeric"), ("0", 0, 10, None), ("10", 0, 10, None),
])
def test_range(spark, value, low, high, part):
    row = spark.createDataFrame([(value,)], "v string").select(validation.range_error(F.col("v"), "x", low, high).alias("e")).first()
    assert (row["e"] is None) if part is None else (part in row["e"])


def test_record_collects_all_errors(spark):
    rows = [(1, "CCO", 46.0), (None, "C1CC", 0.5), (2, "", 10.0), (3, None, None)]
    out = validation.validate_records(spark.createDataFrame(rows, "cid long, smiles string, molecular_weight double")).collect()
    assert out[0]["errors"] == []
    assert len(out[1]["errors"]) == 3 and out[1]["errors"][0] == "Missing required field: cid"
    assert out[2]["errors"] == []  # an empty text is present and skips the text rules
    assert out[3]["errors"] == ["Missing required field: smiles", "Missing required field: molecular_weight"]


def test_quarantine_splits_all_rows(spark):
    df = spark.createDataFrame([(1, "CCO", 46.0), (2, "xx", 46.0), (3, "CC", 30.0)], "cid long, smiles string, molecular_weight double")
    checked = validation.validate_records(df)
    good, bad = validation.quarantine(checked)
    assert {r["cid"] for r in good.collect()} == {1, 3} and [r["cid"] for r in bad.collect()] == [2]
    assert validation.quarantine_summary(checked).first().asDict() == {"total": 3, "successful": 2, "failed": 1}


@pytest.mark.parametrize("name, safe", [("test.csv", "test.csv"), ("test<file>.csv", "test_file_.csv"), ("my file name.csv", "my_file_name.csv"),
                                        ("a" * 300, "a" * 255), ('q"a\\b|c?d*e:f/g', "q_a_b_c_d_e_f_g"), ("a \t\n b", "a_b")])
def test_filenames(spark, name, safe):
    assert spark.createDataFrame([(name,)], "n string").select(validation.safe_filename(F.col("n")).alias("s")).first()["s"] == safe
