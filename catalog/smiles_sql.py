"""The SMILES text rules in DuckDB SQL, token by token."""

from propspark.functions import smiles as sm

HYDROGEN_TOKEN = r"^\[[0-9]*H[0-9+\-:@]*\]$"
CARBON_TOKEN = r"^(?:[Cc]|\[[0-9]*[Cc](?:[^a-z].*)?\])$"
AROMATIC_TOKEN = r"^(?:[bcnops]|\[[0-9]*(?:b|c|n|o|p|s|se|as)(?:[^a-z].*)?\])$"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def tokens(s: str) -> str:
    return f"regexp_extract_all({s}, '{sm.ATOM}')"


def _matching(s: str, pattern: str) -> str:
    return f"len(list_filter({tokens(s)}, lambda t: regexp_matches(t, '{pattern}')))"


def _outside(s: str) -> str:
    return f"regexp_replace({s}, '{sm.BRACKET}', ' ', 'g')"


def heavy(s: str) -> str:
    return f"({_count(s, sm.ATOM)} - {_matching(s, HYDROGEN_TOKEN)})"


def parse_error(s: str) -> str:
    o = _outside(s)
    return (
        f"CASE WHEN {s} IS NULL OR {s} = '' THEN 'SMILES must be a non-empty string' "
        f"WHEN NOT regexp_matches({s}, '{sm.ALLOWED}') THEN 'Invalid characters in SMILES' "
        f"WHEN NOT regexp_matches({s}, '{sm.GRAMMAR}') "
        f"OR length({o}) - length(replace({o}, '(', '')) <> length({o}) - length(replace({o}, ')', '')) "
        f"OR {_count(o, sm.RING_LABEL)} % 2 <> 0 THEN 'Invalid SMILES: could not parse molecular structure' END"
    )


def error(s: str, mass: str | None = None) -> str:
    rules = [parse_error(s)]
    if mass:
        rules.append(f"CASE WHEN {mass} <= 0 OR {mass} > 5000 THEN 'Unreasonable molecular weight' END")
    rules.append(f"CASE WHEN {heavy(s)} < 2 THEN 'Molecule must have at least 2 atoms' END")
    return f"coalesce({', '.join(rules)})"


def counts(s: str) -> dict[str, str]:
    o = _outside(s)
    rings = f"({_count(o, sm.RING_LABEL)} // 2)"
    parts = f"(length({o}) - length(replace({o}, '.', '')) + 1)"
    sign = f"regexp_extract(t, '{sm.CHARGE}', 1)"
    digits = f"regexp_extract(t, '{sm.CHARGE}', 2)"
    one = (
        f"(CASE WHEN {sign} LIKE '-%' THEN -1 WHEN {sign} LIKE '+%' THEN 1 ELSE 0 END) * "
        f"coalesce(try_cast({digits} AS INT), length({sign}))"
    )
    out = {
        "heavy_atoms": heavy(s),
        "heteroatoms": f"{heavy(s)} - {_matching(s, CARBON_TOKEN)}",
        "aromatic_atoms": _matching(s, AROMATIC_TOKEN),
        "ring_closures": rings,
        "components": parts,
        "branches": f"length({o}) - length(replace({o}, '(', ''))",
        "double_bonds": f"length({o}) - length(replace({o}, '=', ''))",
        "triple_bonds": f"length({o}) - length(replace({o}, '#', ''))",
        "heavy_bonds": f"{heavy(s)} - {parts} + {rings}",
        "formal_charge": f"coalesce(list_sum(list_transform({tokens(s)}, lambda t: {one})), 0)",
        "stereocenters": _matching(s, "@"),
    }
    return {k: f"CAST({v} AS BIGINT)" for k, v in out.items()}
