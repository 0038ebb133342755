"""Fingerprints and scaffold keys of bond tables against brute force on small graphs."""

import random
from hashlib import md5
from itertools import combinations, permutations

from compscope.operators import molecules

BONDS = "m string, a string, b string, t string"
ATOMS = "m string, atom string, label string"


def tables(spark, graphs):
    """Graphs as {name: (labels by atom, bonds as (atom, atom, kind))}."""
    bonds = [(g, x, y, t) for g, (_, lines) in graphs.items() for x, y, t in lines]
    atoms = [(g, x, label) for g, (labels, _) in graphs.items() for x, label in labels.items()]
    return spark.createDataFrame(bonds, BONDS), spark.createDataFrame(atoms, ATOMS)


def random_graph(rng, n, kinds="12", labels="CN"):
    names = [f"x{i}" for i in range(n)]
    lines = [(names[i], names[rng.randrange(i)], rng.choice(kinds)) for i in range(1, n)]
    lines += [(x, y, rng.choice(kinds)) for x, y in combinations(names, 2) if rng.random() < 0.15]
    once = {tuple(sorted(l[:2])): l for l in reversed(lines)}
    return {x: rng.choice(labels) for x in names}, list(once.values())


def h(text, first=0, digits=8):
    return int(md5(text.encode()).hexdigest()[first : first + digits], 16)


def neighbours(labels, lines):
    near = {x: [] for x in labels}
    for x, y, t in lines:
        near[x].append((t, y))
        near[y].append((t, x))
    return near


def brute_circular(labels, lines, radius):
    near = neighbours(labels, lines)
    ids = {x: h(f"0|{labels[x]}|{len(near[x])}") for x in labels if near[x]}
    seen = {x: frozenset() for x in ids}
    out, found = set(ids.values()), {}
    for r in range(1, radius + 1):
        ids = {x: h(f"{r}|{ids[x]}|{sum(h(f'{t}|{ids[y]}', 0, 10) for t, y in near[x])}") for x in ids}
        seen = {x: frozenset().union(*[seen[y] | {frozenset((x, y))} for _, y in near[x]], seen[x]) for x in ids}
        for x in ids:
            found.setdefault(seen[x], []).append((r, ids[x]))
    return out | {min(v)[1] for v in found.values()}


def brute_paths(labels, lines, most):
    near, out = neighbours(labels, lines), set()

    def walk(path, kinds):
        if len(path) > 1:
            there = labels[path[0]] + "".join(f"-{t}-{labels[x]}" for t, x in zip(kinds, path[1:]))
            back = labels[path[-1]] + "".join(f"-{t}-{labels[x]}" for t, x in zip(kinds[::-1], path[-2::-1]))
            out.add(min(there, back))
        if len(path) <= most:
            for t, y in near[path[-1]]:
                if y not in path:
                    walk([*path, y], [*kinds, t])

    for x in labels:
        walk([x], [])
    return out


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(1)
    graphs = {f"g{i}": random_graph(rng, rng.randint(2, 9)) for i in range(25)}
    graphs["ring"] = ({f"r{i}": "C" for i in range(6)}, [(f"r{i}", f"r{(i + 1) % 6}", "1") for i in range(6)])
    bonds, atoms = tables(spark, graphs)
    bonds = bonds.unionAll(spark.createDataFrame([("ring", "r0", "r0", "1"), (None, "a", "b", "1"), ("ring", "r1", "r0", "1"), ("ring", None, "r0", "1")], BONDS))
    got = {r.m: r.bits for r in molecules.circular_fingerprint(bonds, atoms, "m", "a", "b", "t", "atom", "label", 2, 512).collect()}
    assert got == {g: sorted({f % 512 for f in brute_circular(*v, 2)}) for g, v in graphs.items()}
    got = {r.m: r.bits for r in molecules.path_fingerprint(bonds, atoms, "m", "a", "b", "t", "atom", "label", 4, 512).collect()}
    assert got == {g: sorted({h(p, k) % 512 for p in brute_paths(*v, 4) for k in (0, 8)}) for g, v in graphs.items()}
    assert molecules.circular_fingerprint(bonds.limit(0), atoms, "m", "a", "b", "t", "atom", "label").count() == 0


def test_bonds_that_stand_alone_skip_the_rounds(spark, monkeypatch):
    rng = random.Random(4)
    graphs = {f"p{i}": ({"x": "C", "y": "CN"[i % 2], "z": "O"}, [("y", "x", "12"[i % 3 % 2])]) for i in range(6)}
    labels, lines = random_graph(rng, 5)
    graphs["both"] = (labels | {"u": "N", "v": "C", "w": "C", "q": "N"}, [*lines, ("u", "v", "2"), ("q", "w", "2")])
    bonds, atoms = tables(spark, graphs)
    written = []
    write = molecules.materialise
    monkeypatch.setattr(molecules, "materialise", lambda df, name="step", **kw: written.append((name, write(df, name, **kw))) or written[-1][1])
    for radius in (0, 1, 3):
        found = molecules.circular_features(bonds, atoms, "m", "a", "b", "t", "atom", "label", radius).collect()
        assert {g: {r.feature for r in found if r.g == g} for g in graphs} == {g: brute_circular(*v, radius) for g, v in graphs.items()}
        assert len(found) == len(set(found))
    for most in (1, 3):
        got = {r.m: r.bits for r in molecules.path_fingerprint(bonds, atoms, "m", "a", "b", "t", "atom", "label", most, 512).collect()}
        assert got == {g: sorted({h(p, k) % 512 for p in brute_paths(*v, most) for k in (0, 8)}) for g, v in graphs.items()}
    rounds = [df for name, df in written if name != "ends"]
    assert all(df.where("g <> 'both' OR x IN ('u', 'v', 'w', 'q')" if "x" in df.columns else "g <> 'both'").isEmpty() for df in rounds)


def form(labels, lines):
    """The smallest description over all numberings."""
    return min(
        (tuple(labels[x] for x in order), tuple(sorted((min(at[x], at[y]), max(at[x], at[y]), t) for x, y, t in lines)))
        for order in permutations(labels) for at in [{x: i for i, x in enumerate(order)}]
    )


def shuffled(rng, graph):
    names = list(graph[0])
    new = dict(zip(names, rng.sample([f"y{i}" for i in range(len(names))], len(names))))
    return {new[x]: l for x, l in graph[0].items()}, [(new[y], new[x], t) for x, y, t in rng.sample(graph[1], len(graph[1]))]


def keys(spark, graphs):
    bonds, atoms = tables(spark, graphs)
    rows = molecules.scaffold_key(bonds, atoms, "m", "a", "b", "t", "atom", "label").collect()
    return {r.m: (r.n_atoms, r.n_bonds, r.key) for r in rows}


def plain(n, lines):
    return {f"x{i}": "C" for i in range(n)}, [(f"x{i}", f"x{j}", "1") for i, j in lines]


def test_keys_tell_graphs_apart_and_nothing_else(spark):
    rng = random.Random(2)
    graphs = {f"g{i}": random_graph(rng, rng.randint(3, 6), "1", "C") for i in range(60)}
    graphs |= {f"k{i}": random_graph(rng, 5) for i in range(30)}
    graphs |= {f"{g}'": shuffled(rng, v) for g, v in list(graphs.items())[::3]}
    got = keys(spark, graphs)
    want = {g: form(*v) for g, v in graphs.items()}
    assert all((got[g][2] == got[o][2]) == (want[g] == want[o]) for g, o in combinations(graphs, 2))


def test_keys_of_regular_graphs_that_refinement_cannot_tell_apart(spark):
    rng = random.Random(3)
    ring = [(i, (i + 1) % 6) for i in range(6)]
    prism = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)]
    bipartite = [(i, j) for i in range(3) for j in range(3, 6)]
    cubes = [(i, i ^ (1 << k)) for i in range(8) for k in range(3) if i < i ^ (1 << k)]
    moebius = [(i, (i + 1) % 8) for i in range(8)] + [(i, i + 4) for i in range(4)]
    petersen = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
    rings = [(5 * k + i, 5 * k + (i + 1) % 5) for k in range(8) for i in range(5)] + [(5 * k, 5 * k + 5) for k in range(7)]
    graphs = {"ring": plain(6, ring), "triangles": plain(6, prism[:6]), "prism": plain(6, prism), "k33": plain(6, bipartite),
              "cube": plain(8, cubes), "moebius": plain(8, moebius), "petersen": plain(10, petersen), "chain of rings": plain(40, rings)}
    again = {f"{g}'": shuffled(rng, v) for g, v in graphs.items()}
    got = keys(spark, graphs | again)
    assert all(got[g] == got[f"{g}'"] for g in graphs) and len({got[g][2] for g in graphs}) == len(graphs)
    # A key does not depend on the other molecules of the table.
    alone = keys(spark, {"petersen": graphs["petersen"]})
    assert alone["petersen"] == got["petersen"]
