"""Exact substring deduplication by lines, sentences and chosen windows: the earliest occurrence of a unit stays, all others go.

Lines are cut after sentence ends, and sentences of a line are joined until a unit has ``min_words`` words (what is left at
the end of a line goes to the unit before it). Whole lines of at least ``line_words`` words are units too. So that passages are found wherever
they stand, without regard to lines and sentences, windows of ``WINDOW`` words are units as well: of any ``REACH`` neighbouring windows the one
of least hash (winnowing). A passage of at least ``WINDOW + REACH - 1`` words thus has the same windows in every document, and they cover all
of it but fewer than ``REACH`` words at either end. A letter of a script written without spaces is a word. Windows are
compared with windows only, and overlap with sentences and each other. Units are compared by a 128-bit digest of their words in lower case.
Digests are grouped over all documents; the occurrence of least rank, then ``doc_id``, then position stays. Offsets are code points
of the original text, ``end`` exclusive.

Digests are sums over words (a word's hash: over letters) of powers of odd numbers, modulo 2**64, so that prefix sums give those of all windows
and units of a text at once.

Defined cases: null and empty texts have no units; a line of fewer words than ``line_words`` (by default ``min_words``) is only removed inside a
repeated window; a window that overlaps the earliest occurrence of itself stays, so that runs of one word do not eat themselves; rows with
one ``doc_id`` and rank are one document, so a repeated row repeats nothing; a null ``doc_id`` or rank comes first; an
empty table gives an empty table; other columns are ignored; texts of any length are read to the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import batches_of, free_name, mixed
from paceline.session import materialise

# A sentence ends after one of these before white space, and with its line.
IS_CLOSING, LINE_END = np.array([chr(k) in ".!?" for k in range(128)]), np.uint32(ord("\n"))
# Fixed values. Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
# Words of a window, and neighbouring windows of which one is chosen at least.
WINDOW, REACH = 24, 8
# Odd bases: of letters in words, and of words in units, for either half of a digest.
LETTERS, HALVES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
# What tells sentences and lines from windows.
SENTENCE, CHOSEN = 0, 1 << 40
# Chance repeats shorter sentences and lines across unrelated documents, and boilerplate stands in clean ones.
MIN_WORDS = 16
# Letters that are hashed at a time, whatever the length of a text.
PIECE = 1 << 20
# Bytes of texts that are cut together, and of units handed to Spark at a time.
IN_BYTES, OUT_BYTES = 1 << 18, 1 << 20
UNITS = ["high", "low", "rank", "doc_id", "start", "end", "n_words"]


@lru_cache(maxsize=1)
def letter_kinds() -> np.ndarray:
    """For every code point: 1 if it is part of a word, 2 if it is a word by itself, 3 if it is white space, else 0."""
    kinds = np.fromiter((chr(k).isalnum() or 3 * chr(k).isspace() for k in range(0x110000)), np.uint8, 0x110000)
    kinds[ord("_")] = 1
    for first, last in UNSPACED:
        kinds[first : last + 1] = 2
    return kinds


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as many as were asked for yet."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.known = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.known[0]) < n:
            size = max(n, 2 * len(self.known[0]))
            self.known = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in self.bases]
        return [x[:n] for x in self.known]


def run_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the runs ``values[first:last]``; equal runs hash alike wherever they stand."""
    power, inverse = powers.upto(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:-1], dtype=np.uint64)])
    return mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))


def lowered(text: str) -> str:
    """The text in lower case, letter for letter."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class UnitCutter:
    """Cuts texts; holds the powers that their hashes need."""

    def __init__(self, min_words: int, line_words: int | None = None):
        self.min_words, self.line_words = min_words, min_words if line_words is None else line_words
        self.letters, self.halves = Powers(LETTERS), [Powers(b) for b in HALVES]

    def words(self, letters: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the words of letters in lower case."""
        inside = np.concatenate([[False], kinds == 1, [False]])
        starts = np.flatnonzero((kinds == 2) | inside[1:-1] & ~inside[:-2])
        ends = np.flatnonzero((kinds == 2) | inside[1:-1] & ~inside[2:]) + 1
        hashes, done = [], 0
        while done < len(starts):
            upto = max(done + 1, int(np.searchsorted(starts, starts[done] + PIECE)))
            base = starts[done]
            values = letters[base : ends[upto - 1]].astype(np.uint64) + np.uint64(1)
            hashes.append(run_hashes(values, starts[done:upto] - base, ends[done:upto] - base, self.letters))
            done = upto
        return starts, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)

    def sentences(self, letters: np.ndarray, kinds: np.ndarray, text_ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (start, end, first word, last word) of sentences of at least ``min_words`` words, and of whole lines."""
        before_space = np.flatnonzero(kinds[1:] == 3)
        closing = (letters == LINE_END).astype(np.uint8)
        closing[text_ends] = 2
        closing[before_space[IS_CLOSING[np.minimum(letters[before_space], len(IS_CLOSING) - 1)]]] = 3
        tails = np.maximum(text_ends - 1, 0)
        closing[tails[closing[tails] == 3]] = 0  # the text ends there anyway
        bounds = np.flatnonzero(closing)
        kind = closing[bounds]
        bounds += kind != 2  # a text ends before the line break that parts it from the next
        found, held = [], None  # held: a unit that may still get the rest of its line
        start, first, line = 0, 0, True  # line: whether the unit began with its line
        for end, last, what in zip(bounds.tolist(), np.searchsorted(starts, bounds).tolist(), kind.tolist(), strict=True):
            if last - first >= self.min_words:
                if held:
                    found.append(held)
                held, start, first, line = (start, end, first, last), end, last, False
            if what != 3:
                if held:
                    found.append((held[0], end, held[2], last) if last > held[3] else held)
                elif line and last - first >= max(self.line_words, 1):
                    found.append((start, end, first, last))
                held, start, first, line = None, end + (what == 2), last, True
        return np.array(found, np.int64).reshape(-1, 4)

    def units(self, text: str) -> tuple[np.ndarray, ...]:
        """(high, low, start, end, n_words) of the units of a text."""
        return self.units_of([text])[1:]

    def units_of(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(number of its text, high, low, start, end, n_words) of the units of texts: sentences and lines, then windows, which end where the next word starts.

        The texts are read as one, with a line break after each; no unit crosses it.
        """
        joined = "\n".join([*map(lowered, texts), ""])
        letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = letter_kinds()[letters]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text_ends = np.cumsum(sizes + 1) - 1
        starts, hashes = self.words(letters, kinds)
        spans = self.sentences(letters, kinds, text_ends, starts)
        of = np.searchsorted(text_ends, starts)
        chosen, n = np.zeros(0, np.int64), len(starts) - WINDOW - REACH + 2
        if n > 0:
            at = np.arange(n + REACH - 1)
            least = np.lib.stride_tricks.sliding_window_view(run_hashes(hashes, at, at + WINDOW, self.halves[1]), REACH).argmin(axis=1) + at[:n]
            # Neighbours of one text only; of equal ones the first.
            least = least[of[:n] == of[len(of) - n :]]
            chosen = least[np.diff(least, prepend=-1) > 0]
        after = np.append(starts[1:], len(joined))
        first, last = np.concatenate([spans[:, 2], chosen]), np.concatenate([spans[:, 3], chosen + WINDOW])
        kind = np.repeat(np.array([SENTENCE, CHOSEN], np.uint64), [len(spans), len(chosen)])
        high, low = (mixed(run_hashes(hashes, first, last, p) + kind).view(np.int64) for p in self.halves)
        text, ends = of[first], np.concatenate([spans[:, 1], after[chosen + WINDOW - 1]])
        base = text_ends[text] - sizes[text]
        start = np.concatenate([spans[:, 0], starts[chosen]])
        order = np.argsort(text, kind="stable")
        return tuple(x[order] for x in (text, high, low, start - base, np.minimum(ends, text_ends[text]) - base, last - first))


def unit_batches(batches: Iterator[pa.RecordBatch], cutter: UnitCutter) -> Iterator[pa.RecordBatch]:
    """high, low, rank, doc_id, start, end, n_words of every unit of batches of (rank, doc_id, text).

    Units take many times the room of their texts, and Spark holds what comes at a time outside its heap, so they come in small batches.
    """
    for batch in (piece for whole in batches for piece in batches_of(whole, IN_BYTES)):
        rows, high, low, *places = map(pa.array, cutter.units_of([text or "" for text in batch["text"].to_pylist()]))
        columns = [high, low, batch["rank"].take(rows), batch["doc_id"].take(rows), *places]
        yield from batches_of(pa.RecordBatch.from_arrays(columns, UNITS), OUT_BYTES)


def units(docs: DataFrame, rank: Column, min_words: int, line_words: int | None = None) -> DataFrame:
    """high, low (the digest), rank, doc_id, start, end, n_words of every unit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return unit_batches(batches, UnitCutter(min_words, line_words))

    schema = ", ".join(f"{x} long" for x in UNITS)
    return docs.select(rank.cast("long").alias("rank"), F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def repeated_units(docs: DataFrame, rank: Column | None = None, min_words: int = MIN_WORDS, line_words: int | None = None) -> DataFrame:
    """doc_id, start, end, n_words of every unit to remove, and first_doc_id, first_start of the one that stays.

    The first occurrences are found by an aggregation that combines before its shuffle, and written: a digest has one row
    there, so the join back to the occurrences is linear, and as both its sides are dealt out for the join alone, adaptive
    execution can split the occurrences of a very common unit. Texts are cut twice: units take several times the room of the
    texts, so that cutting again costs less than writing them.
    """
    found = units(docs, F.lit(0) if rank is None else rank, min_words, line_words)
    place = F.struct("rank", "doc_id", "start")
    first = (
        found.groupBy("high", "low")
        .agg(F.min(F.struct(place.alias("place"), "end")).alias("first"), F.max(place).alias("last"))
        .filter(F.col("last") > F.col("first.place"))
        .select("high", "low", "first")
    )
    first = materialise(first.select("high", "low", "first.place", F.col("first.end").alias("first_end")), "first-units")
    same_document = F.col("rank").eqNullSafe(F.col("place.rank")) & F.col("doc_id").eqNullSafe(F.col("place.doc_id"))
    return (
        found.join(first, ["high", "low"])
        .filter((place > F.col("place")) & ~(same_document & (F.col("start") < F.col("first_end"))))
        .select(
            "doc_id", "start", "end", "n_words", F.col("place.doc_id").alias("first_doc_id"), F.col("place.start").alias("first_start")
        )
        .distinct()
    )


def without_units(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents without the removed spans, which may overlap; ``kept_spans`` holds the places of what stays in the original text."""
    kept = free_name(docs, "kept_spans")
    # Overlapping spans become one: a new one starts where no earlier span reaches.
    in_order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= reach, 0).otherwise(1)
    numbered = removed.select("doc_id", "start", "end").distinct().withColumn("opens", opens).withColumn("span", F.sum("opens").over(in_order))
    merged = numbered.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = merged.groupBy(F.col("doc_id").alias("_of_id")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_gone"))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["_of_id"]), "left")
    gone = F.coalesce(F.col("_gone"), F.array().cast("array<struct<start: bigint, end: bigint>>"))
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(gone, lambda x: x["end"]))
    ends = F.concat(F.transform(gone, lambda x: x["start"]), F.array(length))
    between = F.filter(F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), lambda x: x["end"] > x["start"])
    left = F.array_join(F.transform(F.col(kept), lambda x: F.substring(F.col("text"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))), "")
    with_spans = joined.withColumn(kept, between)
    return with_spans.withColumn("text", F.when(F.col("text").isNotNull(), left)).select(*docs.columns, kept)
