"""Jaccard join of documents on word shingles by chosen paths.

A document is the set of its ``shingle``-word shingles. Documents with equal sets are one class of copies, and only
classes are joined. Each run splits the classes into buckets by a shared token that is sampled with a minhash: two
sets of similarity s meet with probability s. A bucket of more than ``bucket`` classes is split again, on ``branches`` further
tokens at once, as long as that helps; if its largest part holds half of it, its members are alike, and it is
compared whole, in blocks. Runs are repeated until pairs at the threshold are missed with probability ``1 - recall`` at most.

In a bucket all pairs are compared exactly, on the shingles. A pair that meets in several buckets is counted in the least of
them, so that counts of links need no list of pairs; for the components each bucket passes on a star per component.

Words are cut at white space, lower-cased, and stripped of what is no letter, digit or underscore at both ends; a text
of fewer words than a shingle is one shingle.

Defined cases: a text without words (null, empty) is alone; rows with equal text are copies, repeated rows too; a class of
rows without ``doc_id`` has a null ``class_id``, while in a class with other rows it counts as a copy of those; an empty table
gives an empty table; other columns are ignored; texts of any length are read to the end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import HashedWords, batches_of, bitmap, given_back, passes, window_hashes
from paceline.llm.components import connected_components
from paceline.session import materialise

EDGES = re.compile(r"^\W+|\W+$")


@dataclass(frozen=True)
class PathSettings:
    shingle: int = 5
    similarity_permille: int = 800
    recall: float = 0.9999
    bucket: int = 250
    branches: int = 3
    levels: int = 3
    block_shingles: int = 1_000_000
    block_sets: int = 2000

    @property
    def runs(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.similarity_permille / 1000))

    @property
    def minhashes(self) -> int:
        return self.runs * (1 + (self.levels - 1) * self.branches)

    @property
    def least_equal(self) -> int:
        """How many of their minhashes two sets at the threshold have in common at least, but for one pair in a hundred thousand of those
        that the recall allows to miss."""
        m, p, below = self.minhashes, self.similarity_permille / 1000, 0.0
        for k in range(m + 1):
            below += math.comb(m, k) * p**k * (1 - p) ** (m - k)
            if below > (1 - self.recall) * 1e-5:
                return k
        return m

    def coordinate(self, run: int, level: int, branch: int) -> int:
        return self.runs + (run * (self.levels - 1) + level - 2) * self.branches + branch


def word_form(word: str) -> str:
    return EDGES.sub("", word).lower()


def shingles(text: str | None, words: HashedWords, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(window_hashes(words.of((text or "").split()), size))


def signatures(docs: DataFrame, s: PathSettings) -> DataFrame:
    """doc_id, set_id (digest of the shingle set, null without words), n (its size) and its minhashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, draw = HashedWords(word_form), np.random.default_rng(83)
        flips, factors = draw.integers(0, 1 << 63, s.minhashes, dtype=np.uint64), draw.integers(0, 1 << 63, s.minhashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in (piece for whole in batches for piece in batches_of(whole)):
            rows = []
            for text in batch["text"].to_pylist():
                found = shingles(text, words, s.shingle)
                if not len(found):
                    rows.append((None, 0, None))
                    continue
                least = [((found ^ flip) * factor).min() for flip, factor in zip(flips, factors, strict=True)]
                rows.append((xxhash.xxh3_128_digest(found.tobytes()), len(found), np.array(least, np.uint64).view(np.int64)))
            sets, sizes, mins = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(mins, pa.list_(pa.int64()))], ["doc_id", "set_id", "n", "mins"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(given_back(sign), "doc_id long, set_id binary, n long, mins array<long>")


def _sized(members: DataFrame) -> DataFrame:
    """Members of buckets of two and more, with the size of their bucket."""
    sizes = members.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # Written, so that both sides are dealt out for the join alone and a very large bucket can be split.
    return members.join(materialise(sizes, "sizes"), "path")


def buckets(classes: DataFrame, s: PathSettings) -> DataFrame:
    """path, set_id, blocks: the buckets in which pairs are to be compared, and into how many blocks of some
    ``block_shingles`` shingles and ``block_sets`` classes at most their members are cut for that.

    Members that share few minhashes with all others of their bucket meet there by chance, as by a line that many texts have, and leave
    it before any shingle is read. Buckets that mostly hold the members of another are united with it, which loses no pair: so the runs compare a group of near
    copies once, not once each. Runs a job for each level.
    """
    members = classes.select("set_id", F.posexplode(F.slice("mins", 1, s.runs)).alias("run", "value"))
    members = members.select("set_id", "run", F.xxhash64("run", "value").alias("path"))
    level = materialise(_sized(members), "paths")
    leaves = level.filter(F.col("size") <= s.bucket)
    for depth in range(2, s.levels + 1):
        large = materialise(level.filter(F.col("size") > s.bucket).withColumnRenamed("path", "parent"), "paths")
        tokens = large.join(classes.select("set_id", "mins"), "set_id")

        def part(branches: range, members: DataFrame, depth: int = depth) -> DataFrame:
            """Members by the next tokens; the run decides which minhashes those are."""
            chosen = F.array(*[F.array(*[F.element_at("mins", s.coordinate(r, depth, b) + 1) for b in branches]) for r in range(s.runs)])
            split = members.select("parent", "set_id", "run", "size", F.posexplode(F.get(chosen, F.col("run"))).alias("at", "value"))
            branch = F.col("at") + F.lit(branches.start)
            return split.select("parent", "set_id", "run", F.col("size").alias("parent_size"), F.xxhash64("parent", branch, "value").alias("path"))

        # One branch tells whether members are alike; the others are only taken if not.
        sizes = part(range(1), tokens).groupBy("path", "parent", "parent_size").agg(F.count(F.lit(1)).alias("size"))
        alike = materialise(sizes.groupBy("parent").agg((F.max("size") * 2 >= F.first("parent_size")).alias("alike")), "alike")
        leaves = leaves.unionByName(large.join(alike.filter("alike"), "parent", "left_semi").select(F.col("parent").alias("path"), "set_id", "run", "size"))
        parts = part(range(s.branches), tokens.join(alike.filter("not alike"), "parent", "left_semi"))
        level = materialise(_sized(parts.select("path", "set_id", "run")).select("path", "set_id", "run", "size"), "paths")
        leaves = leaves.unionByName(level.filter((F.col("size") <= s.bucket) | F.lit(depth == s.levels)))
    leaves = materialise(leaves.select("path", "set_id", "size").distinct(), "leaves")
    united = leaves.join(unions(leaves), "path", "left").select(F.coalesce("into", "path").alias("path"), "set_id").distinct()
    united = materialise(united, "united")
    blocks = united.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / s.block_sets).cast("int").alias("blocks"))
    united = hopeful(united.join(materialise(blocks, "blocks"), "path"), classes, s)
    chosen = materialise(united.join(classes.select("set_id", "n"), "set_id").select("path", "set_id", "n"), "buckets")
    needed = F.greatest(F.ceil(F.sum("n") / s.block_shingles), F.ceil(F.count(F.lit(1)) / s.block_sets))
    blocks = chosen.groupBy("path").agg(needed.cast("int").alias("blocks"))
    return chosen.drop("n").join(materialise(blocks, "blocks"), "path")


def unions(leaves: DataFrame) -> DataFrame:
    """path, into: the buckets to unite with a larger one (of equal ones, that of the least path) that has half of their members.

    Only buckets that stay themselves take others in, so that unions don't run on along chains. A set has a bounded number
    of buckets, so the pairs of buckets that share it are as many as the sets, times a constant.
    """
    other = leaves.select(F.col("path").alias("into"), "set_id", F.col("size").alias("into_size"))
    larger = (F.col("into_size") > F.col("size")) | (F.col("into_size") == F.col("size")) & (F.col("into") < F.col("path"))
    shared = leaves.join(other, "set_id").filter(larger).groupBy("path", "into", "size", "into_size").agg(F.count(F.lit(1)).alias("n"))
    shared = materialise(shared.filter("2 * n >= size"), "shared-buckets")
    roots = shared.join(shared.select(F.col("path").alias("into")).distinct(), "into", "left_anti")
    return roots.groupBy("path").agg(F.max_by("into", F.struct("n", "into_size", -F.col("into"))).alias("into"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, s: PathSettings) -> DataFrame:
    """set_id, shingles (uint64, little-endian) of the wanted classes (set_id, rep: a document of each)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = HashedWords(word_form)
        for batch in (piece for whole in batches for piece in batches_of(whole)):
            found = [shingles(text, words, s.shingle).tobytes() for text in batch["text"].to_pylist()]
            same = [xxhash.xxh3_128_digest(x) == y for x, y in zip(found, batch["set_id"].to_pylist(), strict=True)]
            kept = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["set_id"].filter(kept), pa.array(found, pa.binary()).filter(kept)], ["set_id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    texts = texts.filter(passes(F.coalesce("doc_id", F.lit(0)), bitmap(wanted.select(F.coalesce("rep", F.lit(0))))))
    return texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["rep"])).select("set_id", "text").mapInArrow(given_back(build), "set_id binary, shingles binary").dropDuplicates(["set_id"])


def shared_counts(sets: list[np.ndarray], split: int, most_columns: int = 1024) -> np.ndarray:
    """Sizes of the intersections of the first ``split`` sets with the others (of all with all if that is none)."""
    # Sorted by token with their owners, in place where it can be: a block's shingles are held few times over.
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable").astype(np.int32)
    flat = flat[order]
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])[order]
    del order
    starts = np.concatenate([flat[:1] == flat[:1], flat[1:] != flat[:-1]])
    del flat
    several = ~(starts & np.append(starts[1:], True)[: len(starts)])  # a token of one set adds to no intersection
    owner, column = owner[several], np.cumsum(starts[several], dtype=np.int32) - 1
    del starts, several
    cut = split if 0 < split < len(sets) else 0
    total = np.zeros((cut or len(sets), len(sets) - cut), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, most_columns):
        low, high = np.searchsorted(column, [at, at + most_columns])
        some = np.zeros((len(sets), most_columns), np.float32)
        some[owner[low:high], column[low:high] - at] = 1
        total += (some[:cut] if cut else some) @ some[cut:].T
    return total


def compare(sets: list[np.ndarray], paths: list[np.ndarray], path: int, split: int, permille: int) -> np.ndarray:
    """Which pairs are similar enough and meet in no bucket below ``path``; rows and columns as in ``shared_counts``."""
    both = shared_counts(sets, split)
    sizes = np.array([len(x) for x in sets], np.int64)
    cut = split if 0 < split < len(sets) else 0
    rows, columns = (sizes[:cut] if cut else sizes)[:, None], sizes[cut:][None, :]
    found = np.empty(both.shape, bool)
    for at in range(0, len(both), 128):  # some rows at a time, so that whole numbers don't take many times the room of the counts
        found[at : at + 128] = both[at : at + 128].astype(np.int64) * (1000 + permille) >= permille * (rows[at : at + 128] + columns)
    del both
    found &= shared_counts([x[x < path].view(np.uint64) for x in paths], split) == 0
    return found if cut else np.triu(found, 1)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of sorted batches, gathered by key."""
    held: list[dict] = []
    for batch in (piece for whole in batches for piece in batches_of(whole)):
        for row in batch.to_pylist():
            if held and any(held[0][k] != row[k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def block_pairs(leaves: DataFrame) -> DataFrame:
    """path, set_id, block, low, high: a row for every pair (low, high) of blocks of its bucket in which a member is compared."""
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    dealt = leaves.select("path", "set_id", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("path", "set_id", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def hopeful(leaves: DataFrame, classes: DataFrame, s: PathSettings) -> DataFrame:
    """path, set_id of the members of buckets that have enough minhashes in common with another one there."""
    keys = ["path", "low", "high"]
    rows = block_pairs(leaves).join(classes.select("set_id", "mins"), "set_id")
    least = s.least_equal

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            first = group[0]
            split = sum(x["block"] == first["low"] for x in group) if first["low"] < first["high"] else 0
            if len(group) < 2 or first["low"] < first["high"] and split in (0, len(group)):
                continue
            mins = np.array([x["mins"] for x in group], np.int64)
            a, b = (mins[:split], mins[split:]) if split else (mins, mins)
            equal = np.zeros((len(a), len(b)), np.int16)
            for x, y in zip(a.T, b.T, strict=True):
                equal += x[:, None] == y[None, :]
            near = equal >= least
            if not split:
                np.fill_diagonal(near, False)
            kept = np.concatenate([near.any(axis=1), near.any(axis=0)]) if split else near.any(axis=1)
            ids = [x["set_id"] for x, some in zip(group, kept.tolist(), strict=True) if some]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array([first["path"]] * len(ids), pa.int64()), pa.array(ids, pa.binary())], ["path", "set_id"])

    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys, "block").select(*keys, "block", "set_id", "mins")
    return dealt.mapInArrow(given_back(check), "path long, set_id binary").distinct()


def compared(leaves: DataFrame, sets: DataFrame, s: PathSettings) -> DataFrame:
    """set_id, root, links: a row for each member of a compared bucket (or pair of its blocks) that has a link there.

    ``links`` counts the links of the member, ``root`` is the least member of its component there.
    """
    keys = ["path", "low", "high"]
    known = leaves.groupBy("set_id").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    rows = block_pairs(leaves).join(sets.join(known, "set_id"), "set_id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            first = group[0]
            split = sum(x["block"] == first["low"] for x in group) if first["low"] < first["high"] else 0
            if len(group) < 2 or first["low"] < first["high"] and split in (0, len(group)):
                continue
            found = compare([np.frombuffer(x["shingles"], np.uint64) for x in group], [np.array(x["paths"], np.int64) for x in group], first["path"], split, s.similarity_permille)
            a, b = np.nonzero(found)
            if not len(a):
                continue
            b = b + split
            links = np.bincount(np.concatenate([a, b]), minlength=len(group))
            root = np.arange(len(group))
            while True:  # labels flow along the links of the bucket until none changes
                before = root.copy()
                np.minimum.at(root, a, root[b])
                np.minimum.at(root, b, root[a])
                root = root[root]
                if np.array_equal(before, root):
                    break
            linked = np.flatnonzero(links)
            ids = [x["set_id"] for x in group]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in linked], pa.binary()), pa.array([ids[root[k]] for k in linked], pa.binary()), pa.array(links[linked], pa.int64())],
                ["set_id", "root", "links"],
            )

    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, "block").select(*keys, "block", "set_id", "shingles", "paths").mapInArrow(given_back(check), "set_id binary, root binary, links long")


def near_duplicates(docs: DataFrame, settings: PathSettings = PathSettings()) -> DataFrame:  # noqa: B008
    """doc_id, class_id (least ``doc_id`` of all it is linked with, over any number of links), n_copies (rows with
    the same shingles) and n_links (other shingle sets within the similarity) of every row."""
    signed = materialise(signatures(docs, settings), "signatures")
    classes = signed.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    classes = materialise(classes, "classes")
    leaves = buckets(classes, settings)
    wanted = classes.join(leaves.select("set_id").distinct(), "set_id", "left_semi").select(F.col("set_id"), "rep")
    found = materialise(compared(leaves, shingle_sets(docs, wanted, settings), settings), "links")
    links = found.groupBy("set_id").agg(F.sum("links").alias("n_links"))
    labels = connected_components(found.filter("set_id <> root").select(F.col("set_id").alias("a"), F.col("root").alias("b")).distinct())
    labelled = classes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    names = materialise(labelled.groupBy("label").agg(F.min("rep").alias("class_id")), "names")
    settled = labelled.join(names, "label").join(links, "set_id", "left").select("set_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # Written, so that rows of a set that very many documents have can be split in the last join.
    settled = materialise(settled, "settled")
    alone = F.col("set_id").isNull()
    return signed.select("doc_id", "set_id").join(settled, "set_id", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, settings: PathSettings = PathSettings()) -> DataFrame:  # noqa: B008
    """The documents with one row of each group: the one of least ``doc_id``. Rows without ``doc_id`` all stay."""
    groups = near_duplicates(docs, settings)
    stays = groups.filter(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    kept = docs.filter(F.col("doc_id").isNotNull()).join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))
