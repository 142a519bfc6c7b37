"""What the text of a SMILES string determines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: token grammar, atoms, allowed characters
ALLOWED = r"^[ABCDEFGHIKLMNOPRSTUVWXYZabcdefgijklmnoprstuvwxyz0123456789=@#\-$^.()\[\]/\\%+*:!?|]*$"
GRAMMAR = r"^(?:\[[^\[\]]+\]|Br|Cl|[BCNOPSFI]|[bcnops]|%[0-9]{2}|[0-9]|[-=#$:/\\.()*])+$"
PLAIN_ATOM = r"Br|Cl|[BCNOPSFI]|[bcnops]"
BRACKET = r"\[[^\[\]]*\]"
BRACKET_ATOM = r"\[[^\[\]]+\]"
ATOM = BRACKET_ATOM + "|" + PLAIN_ATOM
RING_LABEL = r"%[0-9]{2}|[0-9]"
BRACKET_HYDROGEN = r"\[[0-9]*H[0-9+\-:@]*\]"
BRACKET_CARBON = r"\[[0-9]*[Cc](?:[^a-z\[\]][^\[\]]*)?\]"
BRACKET_AROMATIC = r"\[[0-9]*(?:b|c|n|o|p|s|se|as)(?:[^a-z\[\]][^\[\]]*)?\]"
PLAIN_CARBON = r"C(?!l)|c"
PLAIN_AROMATIC = r"[bcnops]"
CENTER = r"\[[^\[\]]*@[^\[\]]*\]"
CHARGED = r"\[[^\[\]]*[+-][^\[\]]*\]"
CHARGE = r"([+-]+)([0-9]*)(?::[0-9]+)?\]$"
# fixed values: limits of a plausible molecule
MAX_MASS = 5000.0
MIN_ATOMS = 2

COUNT_NAMES = (
    "heavy_atoms", "heteroatoms", "aromatic_atoms", "ring_closures", "components", "branches",
    "double_bonds", "triple_bonds", "heavy_bonds", "formal_charge", "stereocenters",
)


def outside(smiles: Column) -> Column:
    """The text with every bracket atom blanked out."""
    return F.regexp_replace(smiles, BRACKET, " ")


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _chars(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char)))


def heavy_atoms(smiles: Column, outer: Column | None = None) -> Column:
    outer = outside(smiles) if outer is None else outer
    return _n(outer, PLAIN_ATOM) + _n(smiles, BRACKET_ATOM) - _n(smiles, BRACKET_HYDROGEN)


def _token_charge(t: Column) -> Column:
    signs = F.regexp_extract(t, CHARGE, 1)
    digits = F.regexp_extract(t, CHARGE, 2)
    size = F.coalesce(digits.try_cast("int"), F.length(signs))
    return F.when(signs.startswith("-"), -size).when(signs.startswith("+"), size).otherwise(F.lit(0))


def counts(smiles: Column, outer: Column | None = None) -> dict[str, Column]:
    """Structural counts by name; heavy atoms only. ``outer`` is ``outside(smiles)`` if already computed."""
    outer = outside(smiles) if outer is None else outer
    heavy = heavy_atoms(smiles, outer)
    rings = F.floor(_n(outer, RING_LABEL) / 2).cast("int")
    components = _chars(outer, ".") + 1
    charges = F.transform(F.regexp_extract_all(smiles, F.lit(CHARGED), F.lit(0)), _token_charge)
    out = {
        "heavy_atoms": heavy,
        "heteroatoms": heavy - _n(outer, PLAIN_CARBON) - _n(smiles, BRACKET_CARBON),
        "aromatic_atoms": _n(outer, PLAIN_AROMATIC) + _n(smiles, BRACKET_AROMATIC),
        "ring_closures": rings,
        "components": components,
        "branches": _chars(outer, "("),
        "double_bonds": _chars(outer, "="),
        "triple_bonds": _chars(outer, "#"),
        "heavy_bonds": heavy - components + rings,
        "formal_charge": F.aggregate(charges, F.lit(0), lambda a, b: a + b),
        "stereocenters": _n(smiles, CENTER),
    }
    return {name: out[name] for name in COUNT_NAMES}


def parse_error(smiles: Column, outer: Column | None = None) -> Column:
    """Message of the first failing text rule, null when the string parses."""
    outer = outside(smiles) if outer is None else outer
    broken = ~smiles.rlike(GRAMMAR) | (_chars(outer, "(") != _chars(outer, ")")) | (_n(outer, RING_LABEL) % 2 != 0)
    return (
        F.when(smiles.isNull() | (smiles == ""), F.lit("SMILES must be a non-empty string"))
        .when(~smiles.rlike(ALLOWED), F.lit("Invalid characters in SMILES"))
        .when(broken, F.lit("Invalid SMILES: could not parse molecular structure"))
    )


def error(smiles: Column, mass: Column | None = None, outer: Column | None = None) -> Column:
    """The message of the first failing rule, null for a valid molecule."""
    rules = [parse_error(smiles, outer)]
    if mass is not None:
        m = mass.cast("double")
        rules.append(F.when((m <= 0) | (m > MAX_MASS) | F.isnan(m), F.lit("Unreasonable molecular weight")))
    rules.append(F.when(heavy_atoms(smiles, outer) < MIN_ATOMS, F.lit("Molecule must have at least 2 atoms")))
    return F.coalesce(*rules)


def check(smiles: Column, mass: Column | None = None) -> Column:
    """``struct(valid, error)``."""
    err = error(smiles, mass)
    return F.struct(err.isNull().alias("valid"), err.alias("error"))
