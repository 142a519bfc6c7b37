import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from propspark.errors import DataError
from propspark.functions import smiles as sm
from propspark.operators import descriptors
from tests.fixtures import BONDS, GRAPHS, HEAVY, MOLECULE_SCHEMA, MOLECULES, RINGS


def molecules(spark):
    return spark.createDataFrame(MOLECULES, MOLECULE_SCHEMA)


def test_counts(spark):
    out = descriptors.compute_descriptors(molecules(spark), "mol_id").orderBy("mol_id").collect()
    assert [r["heavy_atoms"] for r in out] == HEAVY
    assert [r["ring_closures"] for r in out] == RINGS
    assert [r["heavy_bonds"] for r in out] == BONDS
    assert [r["heteroatoms"] for r in out] == [1, 0, 0, 1, 2, 0, 1, 1, 2, 0]
    assert all(r["error"] is None for r in out)


@pytest.mark.parametrize("text, name, value", [
    ("[NH4+].[Cl-]", "formal_charge", 0), ("[NH4+].[Cl-]", "components", 2), ("[Ca+2]", "formal_charge", 2), ("[Cu++]O", "formal_charge", 2),
    ("[O-]C(=O)C#N", "formal_charge", -1), ("[O-]C(=O)C#N", "triple_bonds", 1), ("C%12CCCCC%12Br", "ring_closures", 1),
    ("N[C@@H](C)C(=O)O", "stereocenters", 1), ("F[C@](Cl)(Br)[C@H](O)C", "stereocenters", 2), ("[H]OC", "heavy_atoms", 2),
    ("[nH]1cccc1", "aromatic_atoms", 5), ("[13CH4]C", "heteroatoms", 0), ("ClCCl", "heteroatoms", 2), ("[Co]C", "heteroatoms", 1),
    ("CC(C)(C)C", "branches", 2), ("[Hg]C", "heavy_atoms", 2), ("[O-:3]C", "formal_charge", -1),
])
def test_single_counts(spark, text, name, value):
    row = spark.createDataFrame([(text,)], "s string").select(sm.counts(F.col("s"))[name].alias("v")).first()
    assert row["v"] == value


def test_batch_with_invalid_row(spark):
    df = spark.createDataFrame([(0, "CCO"), (1, "invalid"), (2, "c1ccccc1")], "mol_id long, smiles string")
    out = descriptors.compute_descriptors(df, "mol_id").collect()
    assert len(out) == 3 and sum(r["error"] is None for r in out) == 2
    assert descriptors.describe_dataframe(df, "mol_id", merge=False).count() == 2
    merged = descriptors.describe_dataframe(df.withColumn("target", F.lit(1.0)), "mol_id").orderBy("mol_id").collect()
    assert [r["target"] for r in merged] == [1.0] * 3 and [r["heavy_atoms"] for r in merged] == [3, None, 6]


def test_missing_column(spark):
    with pytest.raises(DataError):
        descriptors.compute_descriptors(spark.createDataFrame([(1, "CCO")], "mol_id long, other string"), "mol_id")


def test_names_match_schema(spark):
    for spec in (descriptors.DescriptorSet(), descriptors.DescriptorSet(patterns=["C", "O"]), descriptors.DescriptorSet(counts=False, patterns=["C"])):
        out = descriptors.compute_descriptors(molecules(spark), "mol_id", spec=spec)
        assert out.columns == ["mol_id", *spec.names(), "error"]


def test_custom_function_isolates_failures(spark):
    def risky(pdf):
        if (pdf["smiles"] == "CCO").any():
            raise ValueError("no ethanol")
        return pd.DataFrame({"n": pdf["smiles"].str.len().astype("int64")}, index=pdf.index)

    spec = descriptors.DescriptorSet(descriptor_fn=risky, descriptor_schema="n long")
    out = {r["mol_id"]: r for r in descriptors.compute_descriptors(molecules(spark), "mol_id", spec=spec).collect()}
    assert "no ethanol" in out[0]["error"] and out[0]["n"] is None
    assert out[1]["n"] == 8 and out[1]["error"] is None and len(out) == 10


def bonds(spark):
    return spark.createDataFrame([(m, a, b) for m, (e, _, _) in GRAPHS.items() for a, b in e], "mol_id long, src long, dst long")


def test_graph_indices(spark):
    for sources in (64, 256):
        got = {r["mol_id"]: r["wiener"] for r in descriptors.wiener_index(bonds(spark), sources=sources).collect()}
        assert got == {m: w for m, (_, _, w) in GRAPHS.items()}
    got = {r["mol_id"]: r["zagreb"] for r in descriptors.zagreb_index(bonds(spark)).collect()}
    assert got == {m: z for m, (_, z, _) in GRAPHS.items()}


def test_long_path_and_lonely_atom(spark):
    """A path long enough for several chunks, an atom without bonds, two components."""
    n = 1500
    rows = [(1, i, i + 1) for i in range(n - 1)] + [(2, 0, 1), (2, 5, 6)]
    atoms = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "mol_id long, atom_id long")
    got = {r["mol_id"]: r["wiener"] for r in descriptors.wiener_index(spark.createDataFrame(rows, "mol_id long, src long, dst long"), atoms).collect()}
    assert got == {1: n * (n * n - 1) // 6, 2: 2, 3: 0}


def plain_distance_sum(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    total = 0
    for start in near:
        seen, front, depth = {start}, {start}, 0
        while front:
            depth += 1
            front = {v for x in front for v in near[x]} - seen
            seen |= front
            total += depth * len(front)
    return total // 2


def test_distance_sums_of_random_graphs(spark):
    """Trees, rings, rings with chains, several components, repeated bonds and loops, many molecules in a batch."""
    rng, rows, want = random.Random(9), [], {}
    for m in range(60):
        n = rng.choice([2, 3, 5, 12, 40, 90])
        edges = [(i, rng.randrange(i)) for i in range(1, n) if rng.random() < 0.95]
        edges += [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([0, 0, 1, 3, n // 4]))]
        edges += edges[:1]
        rows += [(m, 1000 * a + 7, 1000 * b + 7) for a, b in edges]
        if any(a != b for a, b in edges):
            want[m] = plain_distance_sum(edges)
    ring = [(i, (i + 1) % 700) for i in range(700)]  # more starting atoms than a task row searches from
    rows += [(99, a, b) for a, b in ring]
    want[99] = 700 * 350 * 350 // 2
    df = spark.createDataFrame(rows, "mol_id int, src long, dst long")
    for sources in (64, 256):
        assert {r["mol_id"]: r["wiener"] for r in descriptors.wiener_index(df, sources=sources).collect()} == want
    assert descriptors.wiener_index(df.limit(0)).count() == 0


def graph_tables(spark, rename=None, shuffle=None):
    atoms, edges = [], []
    for m, (e, _, _) in GRAPHS.items():
        ids = sorted({x for pair in e for x in pair})
        name = {i: (rename[m][i] if rename else i) for i in ids}
        atoms += [(m, name[i], "N" if i == 1 else "C") for i in ids]
        edges += [(m, name[a], name[b], 2 if a == 0 else 1) for a, b in e]
    if shuffle:
        shuffle.shuffle(edges)
        edges = [(m, b, a, o) if shuffle.random() < 0.5 else (m, a, b, o) for m, a, b, o in edges]
    return (spark.createDataFrame(atoms, "mol_id long, atom_id long, symbol string"),
            spark.createDataFrame(edges, "mol_id long, src long, dst long, order long"))


def test_circular_fingerprint_invariance(spark):
    base = {r["mol_id"]: r["bits"] for r in descriptors.circular_fingerprint(*graph_tables(spark), nbits=128).collect()}
    rng = random.Random(4)
    rename = {m: dict(zip(range(20), rng.sample(range(100, 200), 20))) for m in GRAPHS}
    again = {r["mol_id"]: r["bits"] for r in descriptors.circular_fingerprint(*graph_tables(spark, rename, rng), nbits=128).collect()}
    assert base == again and len(base) == 5
    assert all(0 <= b < 128 for bits in base.values() for b in bits)
    wider = {r["mol_id"]: len(r["bits"]) for r in descriptors.circular_fingerprint(*graph_tables(spark), radius=0).collect()}
    assert wider == {m: 2 for m in GRAPHS}


def test_key_bits(spark):
    df = spark.createDataFrame([("CCO",), ("c1ccccc1",)], "s string")
    got = [r["b"] for r in df.select(descriptors.key_bits(F.col("s"), ["C", "O", "c1", "N"]).alias("b")).collect()]
    assert got == [[0, 1], [2]]
    with pytest.raises(ValueError):
        descriptors.key_bits(F.col("s"), ["C"] * 168)
