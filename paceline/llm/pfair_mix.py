"""Interleaving sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents, in a fixed random order, are laid end to end and cut into blocks of ``block_chars`` characters; a document
belongs to the block in which it starts. A source has a number of ``parts`` as its target weight. A cycle has as many
slots as all parts together, and in a cycle of q slots the j-th block (from 0) of a source with p parts is released at
``floor(j * q / p)`` and due at ``ceil((j + 1) * q / p)``. Slots are filled earliest deadline first among the released blocks,
which meets every deadline as the weights add up to one; so after any number of slots a source has less than one
block more or less than its share.

A source that runs out takes part in its last cycle with the blocks it has left, and its weight then falls to the
others in proportion. Cycles with the same parts are filled alike, so at most two kinds of cycle for each source (and one)
are scheduled, whatever the size of the corpus; a block's slot follows from its number by arithmetic and a join. The
schedule costs (number of sources) x (slots of a cycle) steps a kind.

Defined cases: a null source is a source; null and empty texts have no characters and join the block at their place; rows with equal
``doc_id``, text and source share a slot and are all kept; a null ``doc_id`` is ordered like the empty text; an empty table gives
an empty table; other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import div, free_name
from paceline.session import materialise

BLOCK_CHARS, CYCLE, DIGITS = 20_000, 200, 3
KEY = ["doc_id", "source", "content"]


def content_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def laid_out(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """doc_id, source, content, chars_before: characters of the source before each distinct document.

    A running sum in two steps: over the first ``digits`` hexadecimal digits of the order, then among documents that share
    them, so that a source is worked on in 16**digits pieces.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        F.col("doc_id"), F.col("source"), content_hash().alias("content"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")
    )
    rows = rows.groupBy(*KEY).agg(F.sum("chars").alias("chars")).withColumn("place", order).withColumn("piece", F.substring("place", 1, digits))
    pieces = rows.groupBy("source", "piece").agg(F.sum("chars").alias("piece_chars"))
    upto = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("source").alias("of_source"), F.col("piece").alias("of_piece"), F.coalesce(F.sum("piece_chars").over(upto), F.lit(0)).alias("before"))
    joined = rows.join(pieces, rows["source"].eqNullSafe(pieces["of_source"]) & (rows["piece"] == pieces["of_piece"]))
    within = Window.partitionBy("source", "piece").orderBy("place", "doc_id", "content").rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*KEY, (F.col("before") + F.coalesce(F.sum("chars").over(within), F.lit(0))).alias("chars_before"))


def source_blocks(docs: DataFrame, parts: dict[str, int] | None, block_chars: int, cycle: int) -> DataFrame:
    """source, blocks, parts. Without given parts a source's weight is the square root of its characters."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    blocks = F.greatest(F.ceil(F.col("chars") / block_chars).cast("long"), F.lit(1)).alias("blocks")
    if parts is not None:
        weight = F.lit(1)
        for name, given in parts.items():
            weight = F.when(F.col("source") == name, F.lit(given)).otherwise(weight)
        return sizes.select("source", blocks, weight.cast("long").alias("parts"))
    root = F.floor(F.sqrt("chars")).cast("long").alias("root")
    total = F.greatest(F.sum("root").over(Window.partitionBy()), F.lit(1))
    return sizes.select("source", blocks, root).select("source", "blocks", F.greatest(F.lit(1).cast("long"), div(cycle * F.col("root"), total)).alias("parts"))


def earliest_deadline_first(parts: Column) -> Column:
    """The order in which a cycle takes blocks: an array of positions in ``parts``, one for each slot."""
    slots = F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a + b)

    def pick(done: Column, t: Column) -> Column:
        """The released block of earliest deadline, as (deadline, position)."""
        each = F.transform(
            F.arrays_zip(parts.alias("p"), done.alias("n")),
            lambda x, k: F.when(
                (x["n"] < x["p"]) & (div(x["n"] * slots, x["p"]) <= t), F.struct(div((x["n"] + 1) * slots + x["p"] - 1, x["p"]).alias("due"), k.alias("k"))
            ),
        )
        return F.array_min(F.array_compact(each))["k"]

    def fill(state: Column, t: Column) -> Column:
        order = F.array_append(state["order"], pick(state["done"], t))
        done = F.transform(state["done"], lambda n, k: n + (k == F.element_at(order, -1)).cast("long"))
        return F.struct(done.alias("done"), order.alias("order"))

    nothing = F.struct(F.transform(parts, lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("order"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), slots - 1), nothing, fill, lambda state: state["order"])


def first_cycles(listed: Column) -> Column:
    """The first cycle of every kind, in order, of sources given as an array of (blocks, parts)."""
    whole = F.transform(listed, lambda x: div(x["blocks"], x["parts"]))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), whole, F.transform(whole, lambda x: x + 1))))


def schedule(sources: DataFrame) -> DataFrame:
    """source, kind (first cycle of a kind), nth, slot, slots: the slot of a source's nth block in that cycle, and how
    many slots a cycle of the kind has."""
    listed = sources.select(F.sort_array(F.collect_list(F.struct("source", "blocks", "parts"))).alias("listed"))
    # Every kind is a row of its own, dealt out before it is scheduled, so that kinds are scheduled side by side. An outer explode has no
    # filter on the schedule that could be pushed below the exchange and be computed there once more.
    kinds = listed.withColumn("kind", F.explode(first_cycles(F.col("listed")))).repartition(F.col("kind"))
    used = lambda x: F.least(x["blocks"], F.col("kind") * x["parts"])  # noqa: E731  blocks taken before the cycle
    left = F.transform("listed", lambda x: F.struct(x["source"].alias("source"), F.least(x["blocks"] - used(x), x["parts"]).alias("n")))
    kinds = kinds.withColumn("base", F.aggregate("listed", F.lit(0).cast("long"), lambda a, x: a + used(x))).withColumn("left", F.filter(left, lambda x: x["n"] > 0))
    filled = kinds.filter(F.size("left") > 0).withColumn("order", earliest_deadline_first(F.transform("left", lambda x: x["n"])))
    slots = filled.select("kind", "base", "left", F.size("order").cast("long").alias("slots"), F.posexplode_outer("order").alias("at", "pick"))
    nth = F.row_number().over(Window.partitionBy("kind", "pick").orderBy("at")) - 1
    return slots.select(F.get("left", F.col("pick"))["source"].alias("source"), "kind", nth.cast("long").alias("nth"), (F.col("base") + F.col("at")).alias("slot"), "slots")


def positions(docs: DataFrame, parts: dict[str, int] | None, block_chars: int, cycle: int, digits: int) -> DataFrame:
    """doc_id, source, content, block_no, slot, block_offset of every distinct document."""
    sources = materialise(source_blocks(docs, parts, block_chars, cycle), "sources")  # a row a source, read three times
    starts = sources.select(first_cycles(F.collect_list(F.struct("blocks", "parts")))).scalar()
    of = sources.select(F.col("source").alias("of_source"), "blocks", "parts")
    plan = schedule(sources).withColumnsRenamed({"source": "plan_source", "kind": "plan_kind", "nth": "plan_nth"})
    placed = laid_out(docs, digits)
    numbered = placed.join(of, placed["source"].eqNullSafe(of["of_source"])).withColumn("block_no", F.least(div(F.col("chars_before"), block_chars), F.col("blocks") - 1))
    turn = div(F.col("block_no"), F.col("parts"))
    timed = numbered.withColumn("turn", turn).withColumn("starts", starts).withColumn("kind", F.array_max(F.filter("starts", lambda x: x <= F.col("turn"))))
    nth = F.col("block_no") - F.col("turn") * F.col("parts")
    found = timed.withColumn("nth", nth).join(plan, F.col("source").eqNullSafe(plan["plan_source"]) & (F.col("kind") == plan["plan_kind"]) & (F.col("nth") == plan["plan_nth"]))
    slot = F.col("slot") + (F.col("turn") - F.col("kind")) * F.col("slots")
    return found.select(*KEY, "block_no", slot.alias("slot"), (F.col("chars_before") - F.col("block_no") * block_chars).alias("block_offset"))


OUTPUTS = ("block_no", "slot", "block_offset")


def output_names(docs: DataFrame) -> list[str]:
    """The names of the columns that ``interleave`` adds: with underscores in front where documents have such a column."""
    return [free_name(docs, c) for c in OUTPUTS]


def interleave(
    docs: DataFrame, parts: dict[str, int] | None = None, block_chars: int = BLOCK_CHARS, cycle: int = CYCLE, digits: int = DIGITS
) -> DataFrame:
    """The documents with ``block_no`` (in their source), ``slot`` (of that block in the mix) and ``block_offset`` (characters of
    the block before the document); ordering by slot, then offset, gives the mix.

    ``parts`` are the sources' target weights, 1 for a source that is not listed; without them a source's weight is the
    square root of its characters, in ``cycle`` parts. Only hashes and lengths are laid out; documents are joined to the result once.
    """
    found = positions(docs.select("doc_id", "source", "text"), parts, block_chars, cycle, digits)
    at = {c: free_name(docs, f"_at_{c}") for c in KEY}
    found = found.select(*[F.col(c).alias(name) for c, name in at.items()], *[F.col(c).alias(name) for c, name in zip(OUTPUTS, output_names(docs), strict=True)])
    # A column of its own: who needs no text of the result then shuffles none.
    content = free_name(docs, "_content")
    hashed = docs.withColumn(content, content_hash())
    same = F.col(content) == F.col(at["content"])
    for key in ("doc_id", "source"):
        same = same & F.col(key).eqNullSafe(F.col(at[key]))
    return hashed.join(found, same).drop(content, *at.values())
