"""The most similar name of a dictionary of any size, by an index of letter signatures.

A node of the index holds the names whose letters, told apart by 1, 2, 4, ... or 64 classes, have the same counts; its key spells
them, and gives the node's bound: no name inside is more similar than shared letters allow. Finer nodes lie
inside coarser ones, so a search goes down level by level, each level an equi-join of (name, node) with the node's children. Classes only
double from level to level, so that a node has few children and most of what can't match is left out before names are told apart finely.

Best bounds are searched first, in rounds. A round goes down to all nodes whose bound is at least its floor, compares what the
leaves hold, and settles every name whose score has reached the floor, as nothing below can be better. The others go on to the next round, with
a lower floor, but never below their own score so far. Nothing is left out that could win, and few names ever meet much of the dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.text import DIVISIONS, letter_keys, ratio, ratio_bound
from paceline.session import materialise

KEYS = [f"k{c}" for c in DIVISIONS]
NAME = ["kind", "name"]
STEP = 0.1  # by how much the floor falls from round to round


def signatures(known: DataFrame) -> DataFrame:
    """``(kind, known, k1, k2, ...)``: each name with its keys in all divisions."""
    return known.select("kind", "known", letter_keys()("known").alias("keys")).select("kind", "known", "keys.*")


def tree(index: DataFrame) -> DataFrame:
    """``(level, kind, parent, key)`` of all nodes."""
    levels = []
    for level, key in enumerate(KEYS):
        parent = F.col(KEYS[level - 1]) if level else F.lit("")
        levels.append(index.select("kind", parent.alias("parent"), F.col(key).alias("key")).distinct().withColumn("level", F.lit(level)))
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _length_bound(ours: Column, theirs: Column) -> Column:
    """What two numbers of letters allow."""
    return F.when(ours + theirs > 0, 2.0 * F.least(ours, theirs) / (ours + theirs)).otherwise(1.0)


def candidates(names: DataFrame, index: DataFrame, nodes: DataFrame, floor: float, ceiling: float | None = None) -> DataFrame:
    """``(kind, name, known)`` of all names in leaves whose bound is at least the floor, above the name's ``score`` and below the
    ceiling, which earlier rounds have searched."""
    hopeful = (F.col("bound") >= floor) & (F.col("bound") > F.col("score"))
    # A kind has a node for each length of its names: one row a kind, however many names there are.
    lengths = nodes.filter("level = 0").groupBy("kind").agg(F.collect_list("key").alias("lengths"))
    spelt = names.select(*NAME, "score", letter_keys()("name").alias("keys")).select(*NAME, "score", F.col(f"keys.{KEYS[-1]}").alias("letters"))
    each = spelt.join(lengths, "kind").select(*NAME, "score", "letters", F.explode("lengths").alias("parent"))
    at = each.withColumn("bound", _length_bound(F.length("letters"), F.col("parent").cast("int"))).filter(hopeful).drop("bound")
    for level in range(1, len(KEYS)):
        below = at.join(nodes.filter(F.col("level") == level).select("kind", "parent", "key"), ["kind", "parent"])
        bounded = below.withColumn("bound", ratio_bound(DIVISIONS[level])("letters", "key")).filter(hopeful)
        at = bounded.select(*NAME, "score", "letters", "bound", F.col("key").alias("parent"))
    if ceiling is not None:
        at = at.filter(F.col("bound") < ceiling)
    leaves = index.select("kind", F.col(KEYS[-1]).alias("parent"), "known")
    return at.select(*NAME, "parent").join(leaves, ["kind", "parent"]).select(*NAME, "known")


def most_similar(unknown: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """``(kind, name, score, match)`` of every ``(kind, name)``: the highest ratio to a known name of the kind, 0 if there is none; and
    the least of the known names that reach it, if it is ``least`` or more.

    ``unknown`` has distinct ``(kind, name)``, ``known`` distinct ``(kind, known)``. The index is written, and the names with their scores
    after every round: they are joined to names that very many share.
    """
    index = materialise(signatures(known), "name-index")
    nodes = materialise(tree(index), "name-nodes")
    # Below any bound, so that the first round takes all that reach its floor.
    rest = materialise(unknown.select(*NAME, F.lit(-1.0).alias("score"), F.lit(None).cast("string").alias("match")), "open-names")
    settled, floor, ceiling = [], least, None
    while not rest.isEmpty():
        pairs = candidates(rest, index, nodes, floor, ceiling)
        compared = pairs.select(*NAME, ratio()("name", "known").alias("score"), F.col("known").alias("match"))
        both = rest.unionByName(compared)
        best = both.groupBy(*NAME).agg(F.min(F.struct((-F.col("score")).alias("less"), "match")).alias("best"))
        scored = materialise(best.select(*NAME, (-F.col("best.less")).alias("score"), F.col("best.match").alias("match")), "scored-names")
        if floor <= 0:
            settled.append(scored)
            break
        settled.append(scored.filter(F.col("score") >= floor))
        rest = scored.filter(F.col("score") < floor)
        floor, ceiling = max(0.0, round(floor - STEP, 6)), floor
    result = rest.limit(0) if not settled else settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    return result.select(*NAME, F.greatest("score", F.lit(0.0)).alias("score"), F.when(F.col("score") >= least, F.col("match")).alias("match"))
