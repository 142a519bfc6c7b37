import pytest
from pyspark.sql import functions as F

from propspark.errors import DataError
from propspark.plans.compounds import assemble_compounds
from propspark.session import new_path
from propspark.sources import tables


def land(spark, lines, name="json"):
    path = new_path(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    return path


def test_csv_missing(spark):
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, new_path(spark, "nothing"), "a int")


def test_csv_round_trip_quotes_and_nulls(spark):
    df = spark.createDataFrame([(1, 'a,"b"', 1.5), (2, None, None), (3, "C%12=[O-]", -0.25)], "a int, s string, v double")
    back = tables.read_csv(spark, tables.write_csv(df, new_path(spark, "csv")), "a int, s string, v double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_csv_by_name(spark):
    path = tables.write_csv(spark.createDataFrame([("1.5", "CCO", "q"), ("x", "CC", None)], "target string, smiles string, more string"), new_path(spark, "csv"))
    out = tables.read_csv(spark, path, "smiles string, target double", unreadable="bad").orderBy("smiles").collect()
    assert [tuple(r) for r in out] == [("CC", None, ["target"]), ("CCO", 1.5, [])]
    with pytest.raises(DataError, match="mass"):
        tables.read_csv(spark, path, "smiles string, mass double")


def test_odd_property_json(spark):
    one = '{"PropertyTable":{"Properties":[{"CID":7,"MolecularWeight":"46.07","HBondDonorCount":"many","New":[1,2]}]}}'
    path = land(spark, [one, '{"PropertyTable":{"Properties":[{"CID"', '{"Fault":{}}', ""])
    (r,) = tables.read_property_json(spark, path, others="more", unreadable="bad").collect()
    assert (r.cid, r.molecular_weight, r.hbd, r.more, r.bad) == (7, 46.07, None, {"New": "[1,2]"}, ["hbd"])
    assert sorted(x.reason for x in tables.broken_envelopes(spark, path).collect()) == ["no PropertyTable.Properties", "not JSON"]
    pretty = new_path(spark, "pretty")
    spark.createDataFrame([(one.replace("{", "{\n"),)], "value string").coalesce(1).write.text(pretty)
    assert tables.read_property_json(spark, pretty, multi_line=True).first().molecular_weight == 46.07
    assert tables.read_property_json(spark, pretty).count() == 0 and tables.broken_envelopes(spark, pretty).count() > 0


def test_solubility_loader(spark):
    df = spark.createDataFrame([("CCO", 0.5, 9), ("bad smiles", 1.0, 9), (None, 2.0, 9), ("[Na]", 3.0, 9), ("CC", -1.0, 9)], "smiles string, target double, x int")
    path = tables.write_csv(df, new_path(spark, "sol"))
    out = tables.read_solubility_csv(spark, path, "smiles string, target double, x int")
    assert out.columns == ["smiles", "solubility"] and {r["smiles"] for r in out.collect()} == {"CCO", "[Na]", "CC"}
    first = tables.read_solubility_csv(spark, path, "smiles string, target double, x int", 2, ("solubility",)).collect()
    assert [r["smiles"] for r in first] == ["CC", "CCO"]
    with pytest.raises(DataError):
        tables.read_solubility_csv(spark, path, "smiles string, other double, x int")


def test_property_json(spark):
    path = land(spark, ['{"PropertyTable":{"Properties":[{"CID":1,"MolecularWeight":46.1,"XLogP":-0.1,"Odd":"q"},{"CID":2,"CanonicalSMILES":"CC"}]}}', '{"Fault":{}}'])
    out = tables.read_property_json(spark, path, "Odd string").orderBy("cid").collect()
    assert len(out) == 2 and out[0]["molecular_weight"] == 46.1 and out[0]["Odd"] == "q" and out[1]["smiles"] == "CC" and out[1]["xlogp"] is None
    assert len(tables.read_property_json(spark, path).columns) == 21


def test_synonym_json(spark):
    path = land(spark, ['{"InformationList":{"Information":[{"CID":1,"Synonym":["a","b","c","d","e","f"]},{"CID":2,"Synonym":"solo"},{"CID":3}]}}'])
    got = {r["cid"]: r["synonyms"] for r in tables.read_synonym_json(spark, path).collect()}
    assert got == {1: ["a", "b", "c", "d", "e"], 2: ["solo"], 3: []}


def test_id_json(spark):
    path = land(spark, ['{"term":"x","IdentifierList":{"CID":[9,8,7]}}', '{"term":"y","IdentifierList":{"CID":[]}}'])
    assert [(r["pos"], r["cid"]) for r in tables.read_id_json(spark, path, 2).orderBy("pos").collect()] == [(0, 9), (1, 8)]


def batch(spark, rows):
    schema = "batch int, pos int, cid long, molecular_weight double, xlogp double, hbd int, hba int, rotatable_bonds int, tpsa double, complexity double, charge int, smiles string"
    return spark.createDataFrame([(b, p, c, mw, 1.0, 1, 1, 1, 20.0, 10.0, 0, s) for b, p, c, mw, s in rows], schema)


def test_assembly(spark):
    one = batch(spark, [(0, 0, 1, 46.0, "CCO"), (0, 1, 2, 50.0, "CC"), (0, 2, 3, 1000.0, "CCC"), (0, 3, 4, 1000.1, "CCC"), (0, 4, 5, None, "CC")])
    two = batch(spark, [(1, 0, 2, 60.0, "CCCC"), (1, 1, 6, 70.0, "C1CC"), (1, 2, 7, 70.0, None), (1, 3, 8, 80.0, "c1ccccc1")])
    names = spark.createDataFrame([(2, ["ethane", "e2"]), (2, ["ethane", "e2"]), (3, [])], "cid long, synonyms array<string>")
    out = {r["cid"]: r for r in assemble_compounds([one, two], names).collect()}
    assert set(out) == {2, 3, 8} and out[2]["smiles"] == "CC"  # bounds inclusive, first batch wins
    assert out[2]["common_name"] == "ethane" and out[3]["common_name"] is None and out[8]["synonyms"] == []
    assert out[8]["ring_closures"] == 1 and -100 <= out[8]["boiling_point"] <= 800 and out[8]["solubility"] > 0
    again = {r["cid"]: r["boiling_point"] for r in assemble_compounds([two, one], names).collect()}
    assert again == {c: r["boiling_point"] for c, r in out.items()}  # noise follows the key
    with pytest.raises(DataError):
        assemble_compounds([one.where("false")])
    path = new_path(spark, "compounds")
    assemble_compounds([one, two], names, output_path=path)
    assert spark.read.option("header", True).csv(path).count() == 3


def test_slim(spark):
    df = spark.range(2).withColumn("Morgan_1", F.lit(0)).withColumn("MACCS_2", F.lit(0)).withColumn("MolWt", F.lit(1.0))
    assert tables.slim(df).columns == ["id", "MolWt"]


def test_broken_id_lists(spark):
    """Numbers as text, ids that are none, and envelopes that cannot be read."""
    path = land(spark, ['{"term":"x","IdentifierList":{"CID":["5",6,"seven"]}}', '{"Fault":{}}', '{"IdentifierList":{"CID":[1'])
    assert [(r.pos, r.cid) for r in tables.read_id_json(spark, path, 9).orderBy("pos").collect()] == [(0, 5), (1, 6), (2, None)]
    bad = tables.broken_envelopes(spark, path, tables.IDENTIFIERS).collect()
    assert sorted(r.reason for r in bad) == ["no IdentifierList.CID", "not JSON"]
