"""Small inputs with known answers."""

# fixed acceptance values: molecules with measured properties, and counts of their texts
MOLECULES = [
    (0, "CCO", 1.0, 78.4, 0), (1, "c1ccccc1", 0.02, 80.1, 2), (2, "CC(C)C", 0.005, -11.7, 1),
    (3, "CCN(CC)CC", 0.1, 89.0, 2), (4, "CC(=O)O", 0.8, 118.1, 1), (5, "CCCCCCCCCC", 0.001, 174.1, 0),
    (6, "c1ccc(cc1)O", 0.3, 181.7, 2), (7, "CC(C)CO", 0.5, 107.9, 1), (8, "CCCC(=O)O", 0.6, 163.5, 1),
    (9, "CC(C)(C)C", 0.002, 9.5, 0),
]
MOLECULE_SCHEMA = "mol_id long, smiles string, solubility double, boiling_point double, toxicity_category int"
HEAVY = [3, 6, 4, 7, 4, 10, 7, 5, 6, 5]
RINGS = [0, 1, 0, 0, 0, 0, 1, 0, 0, 0]
BONDS = [2, 6, 3, 6, 3, 9, 7, 4, 5, 4]

# heavy-atom graphs: edges, Zagreb index, Wiener index
GRAPHS = {
    1: ([(0, 1), (1, 2)], 6, 4),
    2: ([(i, (i + 1) % 6) for i in range(6)], 24, 27),
    3: ([(0, 1), (0, 2), (0, 3)], 12, 9),
    4: ([(i, i + 1) for i in range(9)], 34, 165),
    5: ([(0, i) for i in range(1, 5)], 20, 16),
}
