"""Fingerprints and scaffold keys of molecules given as bond tables.

A bond table has a row per bond: the molecule, two atoms and the kind of the bond; an atom table gives
each atom of a molecule a label (its element, or its functional class). All molecules advance
together, round by round, as joins and grouped sums; nothing is gathered per molecule.
"""

from __future__ import annotations

import json
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

# Hexadecimal digits of a digest that are added up: 40 bits, so that 8 million terms fit 64 bits.
SUM_DIGITS = 10


def digest_number(text: Column, first: int = 1, digits: int = 8) -> Column:
    """Some hexadecimal digits of the MD5 of a text as a number."""
    return F.conv(F.substring(F.md5(text), first, digits), 16, 10).cast("bigint")


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _once(bonds: DataFrame, graph: str, a: str, b: str, kind: str) -> DataFrame:
    """``g, x, y, t``: every bond once, x being the smaller name. Repeated bonds count once (the smallest
    kind); bonds of an atom with itself, and those with a null, are left out."""
    pair = bonds.where(F.col(a) != F.col(b)).select(
        F.col(graph).alias("g"), F.least(F.col(a).cast("string"), F.col(b).cast("string")).alias("x"),
        F.greatest(F.col(a).cast("string"), F.col(b).cast("string")).alias("y"), F.col(kind).cast("string").alias("t"),
    ).where("g IS NOT NULL")
    return pair.groupBy("g", "x", "y").agg(F.coalesce(F.min("t"), F.lit("")).alias("t"))


def both_ways(bonds: DataFrame, graph: str, a: str, b: str, kind: str) -> DataFrame:
    """``g, x, y, t, bond``: every bond of ``_once`` from both of its atoms."""
    once = _once(bonds, graph, a, b, kind).withColumn("bond", F.concat_ws("-", "x", "y"))
    turned = once.select("g", F.col("y").alias("x"), F.col("x").alias("y"), "t", "bond")
    return materialise(once.unionAll(turned), "bonds")


def _names(atoms: DataFrame, graph: str, atom: str, label: str) -> DataFrame:
    named = atoms.select(F.col(graph).alias("g"), F.col(atom).cast("string").alias("x"), F.col(label).cast("string").alias("label"))
    return named.groupBy("g", "x").agg(F.min("label").alias("label"))


def lone_and_joined(
    bonds: DataFrame, atoms: DataFrame, graph: str, a: str, b: str, kind: str, atom: str, label: str
) -> tuple[DataFrame, DataFrame]:
    """The bonds that touch no other bond, once each: ``g, x, y, t, lx, ly``; and the others from both of their
    atoms: ``g, x, y, t, bond, label, d, to`` with the labels of x and y and the degree of x.

    What follows from a bond that stands alone needs neither a join nor a shuffle, so only the others
    go through the rounds.
    """
    once = _once(bonds, graph, a, b, kind)
    ends = F.array(F.struct("x", F.lit(True).alias("low")), F.struct(F.col("y").alias("x"), F.lit(False).alias("low")))
    halves = once.select("g", F.explode(ends).alias("_e"), "t", F.col("x").alias("x0"), F.col("y").alias("y0")).select(
        "g", "_e.x", "_e.low", "t", F.when(F.col("_e.low"), F.col("y0")).otherwise(F.col("x0")).alias("other")
    )
    # Degrees and names meet the halves in the tasks that hold the atom; then halves meet again.
    told = halves.withColumn("d", F.count("*").over(Window.partitionBy("g", "x"))).join(
        _names(atoms, graph, atom, label), ["g", "x"], "left"
    ).withColumn("label", F.coalesce("label", F.lit("")))
    low = F.col("low")
    whole = told.select(
        "g", F.when(low, F.col("x")).otherwise(F.col("other")).alias("a"),
        F.when(low, F.col("other")).otherwise(F.col("x")).alias("b"), "t", "low", "label", "d",
    ).groupBy("g", "a", "b").agg(
        F.max("t").alias("t"),
        F.max(F.when(low, F.col("label"))).alias("lx"), F.max(F.when(~low, F.col("label"))).alias("ly"),
        F.max(F.when(low, F.col("d"))).alias("dx"), F.max(F.when(~low, F.col("d"))).alias("dy"),
    ).withColumnsRenamed({"a": "x", "b": "y"})
    whole = materialise(whole, "ends")
    alone = (F.col("dx") == 1) & (F.col("dy") == 1)
    bond = F.concat_ws("-", "x", "y").alias("bond")
    rest = whole.where(~alone)
    turned = rest.select("g", F.col("y").alias("x"), F.col("x").alias("y"), "t", bond, F.col("ly").alias("label"), F.col("dy").alias("d"), F.col("lx").alias("to"))
    joined = rest.select("g", "x", "y", "t", bond, F.col("lx").alias("label"), F.col("dx").alias("d"), F.col("ly").alias("to"))
    return whole.where(alone).select("g", "x", "y", "t", "lx", "ly"), materialise(joined.unionAll(turned), "bonds")


def labelled_atoms(arcs: DataFrame, atoms: DataFrame, graph: str, atom: str, label: str) -> DataFrame:
    """``g, x, label, d``: the atoms of a bond table with their labels (empty if unknown) and degrees."""
    degree = arcs.groupBy("g", "x").agg(F.count("*").alias("d"))
    return degree.join(_names(atoms, graph, atom, label), ["g", "x"], "left").select("g", "x", F.coalesce("label", F.lit("")).alias("label"), "d")


def circular_features(
    bonds: DataFrame, atoms: DataFrame, graph: str, a: str, b: str, kind: str, atom: str, label: str, radius: int = 2
) -> DataFrame:
    """``g, feature``: the distinct circular features of every molecule, see ``_circular_rows``."""
    return _circular_rows(bonds, atoms, graph, a, b, kind, atom, label, radius).distinct()


def _circular_rows(
    bonds: DataFrame, atoms: DataFrame, graph: str, a: str, b: str, kind: str, atom: str, label: str, radius: int
) -> DataFrame:
    """``g, feature``: the circular features of every molecule, also repeated (the extended-connectivity scheme
    of Rogers and Hahn 2010; with functional classes as labels, its functional-class variant).

    Round 0 gives an atom a number from its label and degree. In every further round its number follows
    from its own and the sum over its bonds of a number for (kind, neighbour's number), so an atom of any
    degree is a grouped sum. The bonds that a number has seen are kept as rows; of numbers that saw the same
    set of bonds of a molecule only the one of the earliest round stays (the smallest of a round). The two atoms of
    a bond that stands alone see that bond in every round, so their part ends with round 1.
    """
    lone, arcs = lone_and_joined(bonds, atoms, graph, a, b, kind, atom, label)
    one, other = (digest_number(_joined("0", F.col(l), F.lit(1))) for l in ("lx", "ly"))
    single = lone.select("g", "t", one.alias("i"), other.alias("j"))

    def next_id(own: str, far: str) -> Column:
        return digest_number(_joined("1", F.col(own), digest_number(_joined(F.col("t"), F.col(far)), digits=SUM_DIGITS)))

    numbers = [F.col("i"), F.col("j"), *([F.least(next_id("i", "j"), next_id("j", "i"))] if radius > 0 else [])]
    single = single.select("g", F.explode(F.array(*numbers)).alias("id"))
    known = arcs.select("g", "x", "label", "d").distinct()
    now = materialise(known.select("g", "x", digest_number(_joined("0", F.col("label"), F.col("d"))).alias("id")), "round")
    features = single.unionAll(now.select("g", "id"))
    seen = arcs.select("g", "x", "bond")
    rounds = []
    for r in range(1, radius + 1):
        near = arcs.join(now.select("g", F.col("x").alias("y"), F.col("id").alias("other")), ["g", "y"])
        part = digest_number(_joined(F.col("t"), F.col("other")), digits=SUM_DIGITS)
        sums = near.groupBy("g", "x").agg(F.sum(part).alias("s"))
        now = materialise(
            now.join(sums, ["g", "x"]).select("g", "x", digest_number(_joined(str(r), F.col("id"), F.col("s"))).alias("id")), "round"
        )
        if r > 1:
            further = arcs.select("g", "x", "y").join(seen.select("g", F.col("x").alias("y"), "bond"), ["g", "y"])
            seen = materialise(seen.unionAll(further.select("g", "x", "bond")).distinct(), "seen")
        # A set of bonds is known by its size and two sums over its members.
        sets = seen.groupBy("g", "x").agg(
            F.count("*").alias("n"), F.sum(digest_number(F.col("bond"), 1, SUM_DIGITS)).alias("s1"),
            F.sum(digest_number(F.col("bond"), 11, SUM_DIGITS)).alias("s2"),
        )
        rounds.append(now.join(sets, ["g", "x"]).select("g", F.lit(r).alias("r"), "id", "n", "s1", "s2"))
    if rounds:
        whole = rounds[0]
        for more in rounds[1:]:
            whole = whole.unionAll(more)
        first = whole.groupBy("g", "n", "s1", "s2").agg(F.min(F.struct("r", "id")).alias("_f"))
        features = features.unionAll(first.select("g", F.col("_f.id").alias("id")))
    return features.select("g", F.col("id").alias("feature"))


def circular_fingerprint(
    bonds: DataFrame, atoms: DataFrame, graph: str, a: str, b: str, kind: str, atom: str, label: str, radius: int = 2, n_bits: int = 1024
) -> DataFrame:
    """``<graph>, bits``: the circular features of every molecule folded to ``n_bits``, sorted. A molecule
    without bonds has no row."""
    found = _circular_rows(bonds, atoms, graph, a, b, kind, atom, label, radius)
    return _folded(found.select("g", (F.col("feature") % n_bits).cast("int").alias("b")), graph)


def _folded(bits: DataFrame, graph: str) -> DataFrame:
    """At most ``n_bits`` distinct bits per molecule."""
    return bits.groupBy("g").agg(F.sort_array(F.collect_set("b")).alias("bits")).withColumnRenamed("g", graph)


def path_fingerprint(
    bonds: DataFrame, atoms: DataFrame, graph: str, a: str, b: str, kind: str, atom: str, label: str,
    max_bonds: int = 5, n_bits: int = 1024, hashes: int = 2,
) -> DataFrame:
    """``<graph>, bits``: all simple paths of 1 to ``max_bonds`` bonds, each by the labels and kinds along
    it read in the direction that comes first in order, set ``hashes`` bits each.

    Paths grow by one bond per round, by a join on their last atom; an atom is entered once. What was
    found is kept as distinct label strings per molecule, so copies of a path in a molecule cost a row
    only in the round that finds them. A bond that stands alone is its only path, and an atom with one
    bond ends every path that comes to it: neither is joined.
    """
    lone, arcs = lone_and_joined(bonds, atoms, graph, a, b, kind, atom, label)
    link = F.concat_ws("", F.lit("-"), "t", F.lit("-"))
    strings = lone.select("g", F.least(F.concat("lx", link, "ly"), F.concat("ly", link, "lx")).alias("path"))
    steps = arcs.where("d > 1").select("g", F.col("x").alias("last"), "y", link.alias("t"), "to")
    steps = materialise(steps, "steps")
    paths = arcs.select(
        "g", F.array("x", "y").alias("atoms"), F.col("y").alias("last"),
        F.concat("label", link, "to").alias("there"), F.concat("to", link, "label").alias("back"),
    )
    for n in range(1, max_bonds + 1):
        if n > 1:
            longer = paths.join(steps, ["g", "last"]).where(~F.array_contains("atoms", F.col("y")))
            paths = materialise(longer.select(
                "g", F.array_append("atoms", F.col("y")).alias("atoms"), F.col("y").alias("last"),
                F.concat("there", "t", "to").alias("there"), F.concat("to", "t", "back").alias("back"),
            ), "paths")
        # Every path was found from both ends.
        new = paths.where(F.element_at("atoms", 1) < F.col("last")).select("g", F.least("there", "back").alias("path")).distinct()
        strings = strings.unionAll(new)
    numbers = [(digest_number(F.col("path"), 1 + 8 * k) % n_bits).cast("int") for k in range(hashes)]
    return _folded(strings.select("g", F.explode(F.array(*numbers)).alias("b")), graph)


def scaffold_key(
    bonds: DataFrame, atoms: DataFrame, graph: str, a: str, b: str, kind: str, atom: str, label: str
) -> DataFrame:
    """``<graph>, n_atoms, n_bonds, key``: a key of every molecule's bond graph (such as the scaffold that
    ``two_core`` leaves) that is equal for two molecules exactly if their graphs are, but for the names of
    the atoms, the same, with labels and kinds of bonds.

    Colours of atoms are refined by the sums over their bonds, for all molecules together; a molecule is
    done in the round that splits none of its classes, so its key does not depend on others. Where every
    atom has a colour of its own, the key is a digest of sums over atoms and bonds. Molecules with
    ties left go on alone, see ``canonical_form``; the work of these grows with the molecule.
    """
    arcs = both_ways(bonds, graph, a, b, kind)
    known = labelled_atoms(arcs, atoms, graph, atom, label)
    sizes = known.groupBy("g").agg(F.count("*").alias("n_atoms"), (F.sum("d") / 2).cast("bigint").alias("n_bonds"))
    live = materialise(known.select("g", "x", digest_number(_joined("c", F.col("label"), F.col("d")), digits=15).alias("c")), "colours")
    settled = None
    while not live.isEmpty():
        near = arcs.join(live.select("g", F.col("x").alias("y"), F.col("c").alias("other")), ["g", "y"])
        sums = near.groupBy("g", "x").agg(F.sum(digest_number(_joined(F.col("t"), F.col("other")), digits=SUM_DIGITS)).alias("s"))
        both = live.join(sums, ["g", "x"]).select("g", "x", "c", digest_number(_joined(F.col("c"), F.col("s")), digits=15).alias("new"))
        both = materialise(both, "refined")
        split = both.groupBy("g").agg((F.countDistinct("new") > F.countDistinct("c")).alias("split"))
        both = both.join(split, "g")
        done = materialise(both.where("NOT split").select("g", "x", "c"), "settled")
        settled = done if settled is None else settled.unionAll(done)
        live = materialise(both.where("split").select("g", "x", F.col("new").alias("c")), "colours")
    if settled is None:
        return sizes.select(F.col("g").alias(graph), "n_atoms", "n_bonds", F.lit("").alias("key")).limit(0)
    classes = settled.groupBy("g").agg(
        (F.countDistinct("c") == F.count("*")).alias("whole"), F.sum(digest_number(F.col("c").cast("string"), 1, SUM_DIGITS)).alias("s0")
    )
    coloured = arcs.where("x < y").join(settled.withColumnRenamed("c", "cx"), ["g", "x"]).join(
        settled.select("g", F.col("x").alias("y"), F.col("c").alias("cy")), ["g", "y"]
    ).join(classes, "g")
    line = _joined(F.least("cx", "cy"), F.greatest("cx", "cy"), F.col("t"))
    plain = coloured.where("whole").groupBy("g", "s0").agg(
        F.sum(digest_number(line, 1, SUM_DIGITS)).alias("s1"), F.sum(digest_number(line, 11, SUM_DIGITS)).alias("s2")
    ).join(sizes, "g").select("g", F.md5(_joined("whole", F.col("n_atoms"), F.col("n_bonds"), F.col("s0"), F.col("s1"), F.col("s2"))).alias("key"))

    def form(rows: pd.DataFrame) -> pd.DataFrame:
        colour = dict(zip(rows["x"], rows["cx"])) | dict(zip(rows["y"], rows["cy"]))
        lines = list(zip(rows["x"], rows["y"], rows["t"]))
        text = json.dumps(canonical_form(colour, lines))
        return pd.DataFrame({"g": rows["g"].iloc[:1], "key": [md5(text.encode()).hexdigest()]})

    kind_of_graph = coloured.schema["g"].dataType.simpleString()
    tied = coloured.where("NOT whole").select("g", "x", "y", "t", "cx", "cy").groupBy("g").applyInPandas(form, f"g {kind_of_graph}, key string")
    return sizes.join(plain.unionAll(tied), "g").withColumnRenamed("g", graph)


def canonical_form(colour: dict, bonds: list[tuple]) -> list:
    """The smallest description of a small coloured graph that does not depend on its atoms' names:
    colours in order, and bonds as (colour, colour, kind) with a colour for each atom.

    Colours are refined; of a class that stays tied, every atom in turn is set apart and the rest refined
    again. Choices that look larger are dropped, and of choices that lead, whatever is chosen further
    on, to one and the same description, one is followed: they are images of each other.
    """
    names = sorted(colour)
    place = {x: i for i, x in enumerate(names)}
    near: list[list[tuple]] = [[] for _ in names]
    for x, y, t in bonds:
        near[place[x]].append((t, place[y]))
        near[place[y]].append((t, place[x]))

    def refine(c: list[int]) -> list[int]:
        while True:
            sign = [(c[i], sorted((t, c[j]) for t, j in near[i])) for i in range(len(c))]
            rank = {}
            for s in sorted(map(repr, sign)):
                rank.setdefault(s, len(rank))
            # Classes only split: order by the old colour first.
            order = sorted(rank, key=lambda s: (int(s[1 : s.index(",")]), s))
            rank = {s: k for k, s in enumerate(order)}
            new = [rank[repr(s)] for s in sign]
            if len(rank) == len(set(c)):
                return new
            c = new

    def described(c: list[int]) -> list:
        return sorted([min(c[place[x]], c[place[y]]), max(c[place[x]], c[place[y]]), t] for x, y, t in bonds)

    def target(c: list[int]) -> list[int]:
        """The atoms of the smallest tied class, the lowest colour first."""
        classes: dict[int, list[int]] = {}
        for i, k in enumerate(c):
            classes.setdefault(k, []).append(i)
        tied = [(len(v), k) for k, v in classes.items() if len(v) > 1]
        return classes[min(tied)[1]] if tied else []

    def apart(c: list[int], i: int) -> list[int]:
        return refine([2 * k + (j != i) for j, k in enumerate(c)])

    def some_leaf(c: list[int]) -> list:
        while tied := target(c):
            c = apart(c, tied[0])
        return described(c)

    def smallest(c: list[int]) -> list:
        tied = target(c)
        if not tied:
            return described(c)
        choices = [apart(c, i) for i in tied]
        looks = [described(k) for k in choices]
        least = min(looks)
        kinds: dict[str, list[int]] = {}
        for k, look in zip(choices, looks):
            if look == least:
                kinds.setdefault(repr(some_leaf(k)), k)
        return min(smallest(k) for k in kinds.values())

    first = {k: i for i, k in enumerate(sorted(set(colour.values())))}
    return [sorted(colour.values()), smallest(refine([first[colour[x]] for x in names]))]
