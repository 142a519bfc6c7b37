"""Feature construction: text counts, graph indices, fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from propspark.columns import require_columns
from propspark.functions import formulas, smiles as sm
from propspark.operators.graph_distances import SOURCES, distance_sums
from propspark.session import materialize

# fixed values: fingerprint sizes, feature-name groups
CIRCULAR_BITS = 2048
KEY_BITS = 167
FINGERPRINT_PREFIXES = ("Morgan_", "MACCS_")
PHYSICOCHEMICAL = (
    "MolWt", "ExactMolWt", "MolLogP", "MolMR", "TPSA", "NumHDonors", "NumHAcceptors",
    "NumRotatableBonds", "NumRings", "NumAromaticRings",
)


def key_bits(text: Column, patterns: Sequence[str], slots: int = KEY_BITS) -> Column:
    """Positions (from 0) of the patterns that occur in the text, as an array."""
    if len(patterns) > slots:
        raise ValueError(f"{len(patterns)} patterns for {slots} slots")
    hits = [F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(patterns)]
    return F.array_compact(F.array(*hits))


def bit_density(bits: Column, total: int) -> tuple[Column, Column]:
    """``(bits set, sparsity in percent)`` of a set-bit array."""
    n = F.size(bits)
    return n, F.round(F.lit(100.0) * (F.lit(1.0) - n / F.lit(float(total))), 2)


def feature_group(name: Column) -> Column:
    fingerprint = name.startswith(FINGERPRINT_PREFIXES[0]) | name.startswith(FINGERPRINT_PREFIXES[1])
    return (F.when(fingerprint, "fingerprint").when(name.isin(*PHYSICOCHEMICAL), "physicochemical")
            .otherwise("topological"))


def feature_groups(long: DataFrame, key: str) -> DataFrame:
    """Feature and set-bit counts per row and group of a long table."""
    return long.groupBy(key, feature_group(F.col("feature")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 0).alias("bits_set"))


class DescriptorSet:
    """Which descriptors to compute; the output schema is the list of names."""

    def __init__(self, counts: bool = True, patterns: Sequence[str] = (), include_keys: bool = True,
                 descriptor_fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
                 descriptor_schema: str | None = None):
        if descriptor_fn is not None and not descriptor_schema:
            raise ValueError("descriptor_fn needs a descriptor_schema")
        self.counts, self.patterns = counts, tuple(patterns)
        self.include_keys = include_keys and bool(patterns)
        self.descriptor_fn, self.descriptor_schema = descriptor_fn, descriptor_schema

    def columns(self, smiles: Column, outer: Column | None = None) -> dict[str, Column]:
        out = dict(sm.counts(smiles, outer)) if self.counts else {}
        if self.include_keys:
            out["key_bits"] = key_bits(smiles, self.patterns)
        return out

    def names(self) -> list[str]:
        extra = T._parse_datatype_string(self.descriptor_schema).names if self.descriptor_schema else []
        return list(self.columns(F.lit(""))) + list(extra)


def compute_descriptors(df: DataFrame, key: str, smiles: str = "smiles", spec: DescriptorSet | None = None,
                        keep: Sequence[str] = ()) -> DataFrame:
    """``key, keep..., descriptors..., error``: bad rows carry an error and null descriptors.

    Descriptors are functions of the row, so columns to keep stay beside them and no
    join is needed.
    """
    require_columns(df, [key, smiles])
    spec = spec or DescriptorSet()
    source = list(dict.fromkeys([key, *keep]))
    names = list(spec.columns(F.lit("")))
    clash = [c for c in source if c in names]
    if clash:
        raise ValueError(f"columns already present: {clash}")
    # the bracket-free text and the error are used many times, so they are columns of their own
    text, outer = F.col("_smiles"), F.col("_outer")
    parts = df.select(*source, F.col(smiles).alias("_smiles")).withColumn("_outer", sm.outside(text)).withColumn(
        "error", sm.error(text, outer=outer))
    exprs = [F.when(F.col("error").isNull(), c).alias(n) for n, c in spec.columns(text, outer).items()]
    out = parts.select(*source, "_smiles", *exprs, "error")
    return (out if spec.descriptor_fn is None else _apply_custom(out, smiles, spec)).drop("_smiles")


def _apply_custom(df: DataFrame, smiles: str, spec: DescriptorSet) -> DataFrame:
    """Run the user's function batch by batch; a failing batch is retried row by row."""
    extra = T._parse_datatype_string(spec.descriptor_schema)
    fn, names = spec.descriptor_fn, extra.names
    schema = T.StructType([f for f in df.schema.fields if f.name != "error"] + extra.fields
                          + [T.StructField("error", T.StringType())])
    order = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = pdf["error"].isna()
            given = pdf.drop(columns=[c for c in (smiles,) if c != "_smiles" and c in pdf]).rename(columns={"_smiles": smiles})
            result = pd.DataFrame(index=pdf.index, columns=names, dtype="object")
            errors = pdf["error"].copy()
            try:
                if good.any():
                    result.loc[good, names] = fn(given[good])[names].to_numpy()
            except Exception:
                for i in pdf.index[good]:
                    try:
                        result.loc[[i], names] = fn(given.loc[[i]])[names].to_numpy()
                    except Exception as exc:
                        errors.loc[i] = f"descriptor failed: {exc}"
            out = pdf.drop(columns=["error"]).join(result.infer_objects())
            out["error"] = errors
            yield out[order]

    return df.mapInPandas(run, schema)


def describe_dataframe(df: DataFrame, key: str, smiles: str = "smiles", spec: DescriptorSet | None = None,
                       merge: bool = True) -> DataFrame:
    """Descriptors beside the source columns (null for failed rows), or of the valid rows alone."""
    if merge:
        return compute_descriptors(df, key, smiles, spec, df.columns).drop("error")
    return compute_descriptors(df, key, smiles, spec).where("error is null").drop("error")


def attach_heuristic_targets(df: DataFrame, key: str, mw: str = "molecular_weight", logp: str = "xlogp",
                             hbd: str = "hbd", hba: str = "hba", rotatable_bonds: str = "rotatable_bonds",
                             noise_sd: float = 20.0, seed: int = 42) -> DataFrame:
    """Boiling point and toxicity category from supplied row descriptors."""
    return df.withColumns({
        "boiling_point": formulas.boiling_point(F.col(mw), F.col(logp), F.col(hba), F.col(hbd),
                                                F.col(rotatable_bonds), F.col(key), noise_sd, seed),
        "toxicity_category": formulas.toxicity_category(F.col(mw), F.col(logp), F.col(hbd), F.col(hba)),
    })


# --- graph indices: bonds(mol_id, src, dst), one row per bond -------------------------------


def _both_ways(bonds: DataFrame, *extra: str) -> DataFrame:
    """Each bond in both directions in one pass over the table."""
    pair = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
                   F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return bonds.select("mol_id", *extra, F.explode(pair).alias("e")).select("mol_id", "e.a", "e.b", *extra)


def zagreb_index(bonds: DataFrame, atoms: DataFrame | None = None) -> DataFrame:
    """Sum of squared degrees per molecule; with an atoms table, bond-free molecules give 0."""
    degree = _both_ways(bonds).groupBy("mol_id", "a").count()
    out = degree.groupBy("mol_id").agg(F.sum(F.col("count") * F.col("count")).alias("zagreb"))
    if atoms is None:
        return out
    return (atoms.groupBy("mol_id").agg(F.lit(0).cast("long").alias("_z")).join(out, "mol_id", "left")
            .select("mol_id", F.coalesce("zagreb", "_z").alias("zagreb")))


def wiener_index(bonds: DataFrame, atoms: DataFrame | None = None, sources: int = SOURCES) -> DataFrame:
    """Sum of shortest path lengths over unordered atom pairs, per molecule; with an atoms table, bond-free molecules give 0.

    All molecules go one way (see ``graph_distances``); ``sources`` is the number of starting atoms that one task row searches from.
    """
    out = distance_sums(bonds.select("mol_id", "src", "dst"), sources)
    if atoms is None:
        return out
    return (atoms.groupBy("mol_id").agg(F.lit(0).cast("long").alias("_z")).join(out, "mol_id", "left")
            .select("mol_id", F.coalesce("wiener", "_z").alias("wiener")))


def _h32(*parts: Column) -> Column:
    """32-bit hash of the parts as a non-negative long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def circular_identifiers(atoms: DataFrame, bonds: DataFrame, radius: int = 2) -> DataFrame:
    """Environment hash of every atom at each radius: ``mol_id, atom_id, r, h``.

    An atom's neighbours enter as count, sum and sum of squares of their (bond
    order, hash) numbers. These do not depend on the order of the neighbours and add up in
    partial aggregates, so no neighbour list is gathered.
    """
    edges = _both_ways(bonds, "order")
    level = atoms.select("mol_id", "atom_id", _h32(F.lit("atom"), F.col("symbol")).alias("h"))
    rounds = [level.withColumn("r", F.lit(0))]
    for r in range(1, radius + 1):
        seen = edges.join(level.select("mol_id", F.col("atom_id").alias("b"), F.col("h").alias("nh")), ["mol_id", "b"])
        x = _h32(F.col("order"), F.col("nh"))
        env = seen.groupBy("mol_id", F.col("a").alias("atom_id")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(x).alias("s1"), F.sum(F.pmod(x, F.lit(65521)) * F.pmod(x, F.lit(65521))).alias("s2"))
        zero = F.lit(0).cast("long")
        level = (
            level.join(env, ["mol_id", "atom_id"], "left")
            .select("mol_id", "atom_id", _h32(
                F.lit(str(r)), F.col("h"), F.coalesce("n", zero), F.coalesce("s1", zero), F.coalesce("s2", zero)).alias("h"))
        )
        level = materialize(level, f"round{r}")
        rounds.append(level.withColumn("r", F.lit(r)))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def circular_fingerprint(atoms: DataFrame, bonds: DataFrame, radius: int = 2, nbits: int = CIRCULAR_BITS) -> DataFrame:
    """Set-bit array per molecule (at most ``nbits`` entries)."""
    bits = circular_identifiers(atoms, bonds, radius).select("mol_id", F.pmod("h", F.lit(nbits)).cast("int").alias("bit")).distinct()
    return bits.groupBy("mol_id").agg(F.sort_array(F.collect_list("bit")).alias("bits"))
