"""Alignment of two tokenizers by pointer jumping, and how often their tokens meet in a corpus.

A text is encoded by a byte-level BPE of the tokenizers library (A) and by a sentencepiece model (B); both cover the same bytes,
those of a space and the text. Tokens of A and B overlap if they share a byte. Every token points to the token that overlaps it and ends
farthest to the right (to A's if both end alike, which then points to itself). Replacing all pointers by the pointers of what
they point to, again and again, doubles the steps taken, and converges to the last token of each component: the label of its group. Two
neighbouring groups are parted where tokens of A and of B both end. This runs over all texts of a batch at once.

An id pair's count is the number of documents that hold it linked. Documents pass on their distinct pairs; pairs are counted with
partial sums, and each document looks the counts of its pairs up again. The pairs that make up most rows, those in at least one of
``HEAVY`` parts of all (document, pair) rows and so at most ``HEAVY`` pairs, are broadcast for that; the others are joined by shuffle.

Defined cases: null and empty texts have no tokens, nor has a text whose joined token bytes differ from it (one with U+2581, which B reads
as a space): all their numbers are 0 and their digest is empty; strings of special tokens are plain text; rows are documents, so that
repeated rows count as often as they occur; a null ``doc_id`` stays null; an empty table gives an empty table; other columns are
ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import batches_of, div
from paceline.llm.repair import gathered, public_vocabulary
from paceline.session import materialise

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
HEAVY = 1 << 16
#: A pair as one number: id of A * PAIR + id of B.
PAIR = 1 << 32
SPACE_MARK = "▁"  # fixed value: how sentencepiece writes a space
#: White space besides spaces and line breaks, and what some call so.
UNUSUAL = re.compile("[\t\x0b-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WHITE = " \t\n\x0b\x0c\r"
FIRST, CHUNK, MOST_WORDS = " a", 4096, 300_000
WRITTEN = 1 << 17


class Pool:
    """Byte strings by number, for gathering many at once."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        return gathered(self.bytes, self.starts[numbers], self.sizes[numbers])


@dataclass
class Tokens:
    """Ids of many texts, one after the other, and the number of each text's ids."""

    ids: np.ndarray
    per_text: np.ndarray

    @staticmethod
    def of(lists: list[list[int]]) -> Tokens:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return Tokens(np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes)

    def only(self, texts: np.ndarray) -> Tokens:
        return Tokens(self.ids[np.repeat(texts, self.per_text)], np.where(texts, self.per_text, 0))


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of values."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return np.diff(ends[at])


class TwoTokenizers:
    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        # The character that stands for each byte, as the library writes it.
        letters, byte_of = ByteLevel(add_prefix_space=False, use_regex=False), {}
        for char in map(chr, range(0x800)):
            byte_of |= dict(zip(letters.pre_tokenize_str(char)[0][0], char.encode(), strict=True))
        for byte in set(range(256)) - set(byte_of.values()):  # no character of up to two bytes holds it
            char = chr({0xE0: 0x800}.get(byte, (byte - 0xE0) << 12 if byte < 0xF0 else max(0x10000, (byte - 0xF0) << 18))) if 0xE0 <= byte <= 0xF4 else None
            if char is not None:
                byte_of[letters.pre_tokenize_str(char)[0][0][0]] = byte
        names = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        self.bytes_a = Pool([bytes(byte_of[c] for c in x) if all(c in byte_of for c in x) else b"" for x in names])
        self.bytes_b = Pool([self._piece(k) for k in range(self.b.get_piece_size())])
        self.forget()
        self.digits = Pool([f"{mark}{k}".encode() for mark in ",;|" for k in range(max(len(names), self.b.get_piece_size()))])

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        if self.b.is_byte(k):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(k) or self.b.is_unknown(k) else piece.replace(SPACE_MARK, " ").encode()

    def _whole(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """Tokens of both, by the libraries; texts that either does not cover byte for byte have none."""
        a = Tokens.of([x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        b = Tokens.of(self.b.encode([x[1:] for x in texts], num_threads=1))
        wanted = [x.encode() for x in texts]
        sizes = np.fromiter(map(len, wanted), np.int64, len(wanted))
        whole = np.fromiter((len(x) > 1 and SPACE_MARK not in x for x in texts), bool, len(texts))
        for tokens, pool in ((a, self.bytes_a), (b, self.bytes_b)):
            whole &= sums(pool.sizes[tokens.ids], tokens.per_text) == sizes
        a, b, sizes = a.only(whole), b.only(whole), np.where(whole, sizes, 0)
        expected = np.frombuffer(b"".join(x for x, ok in zip(wanted, whole, strict=True) if ok), np.uint8)
        for tokens, pool in ((a, self.bytes_a), (b, self.bytes_b)):
            whole &= sums(pool.joined(tokens.ids) != expected, sizes) == 0
        return a.only(whole), b.only(whole)

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        nothing = np.zeros(0, np.int64)
        self.kept = [(nothing, nothing, nothing), (nothing, nothing, nothing)]

    def learn(self, words: list[str]) -> None:
        """Adds words, encoded many at a time: each stands behind a first word, spaced as in a text, and is told apart by its bytes."""
        spelt = [x.replace("\0", "\n", 1) if x[0] == "\0" else x if x == "\n" else " " + x for x in words]
        chunks = [spelt[k : k + CHUNK] for k in range(0, len(spelt), CHUNK)]
        found = self._whole([FIRST + "".join(x) for x in chunks])
        sizes = np.array([len(x.encode()) for x in spelt])
        # Where words end in the chunks laid end to end; a line break that only sets a word apart counts to the word before.
        lead = np.array([x[0] == "\0" for x in words])
        at = np.arange(len(words)) // CHUNK
        ends = np.cumsum(sizes) + len(FIRST) * (at + 1)
        for k, (tokens, pool) in enumerate(zip(found, (self.bytes_a, self.bytes_b), strict=True)):
            borders = np.concatenate([[0], np.cumsum(pool.sizes[tokens.ids])])
            first, last = np.searchsorted(borders, ends - sizes + lead), np.searchsorted(borders, ends)
            if (tokens.per_text == 0).any() or (borders[first] != ends - sizes + lead).any() or (borders[last] != ends).any():
                raise ValueError("a tokenizer joins what stands on both sides of a space or line break")
            starts, counts, ids = self.kept[k]
            self.kept[k] = np.concatenate([starts, first + len(ids)]), np.concatenate([counts, last - first]), np.concatenate([ids, tokens.ids])
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))

    def encode(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """Tokens of both; texts that either does not cover byte for byte have none.

        Neither tokenizer joins what a single space or line break between visible characters parts, so that a text is the sequence
        of its words. Distinct words are encoded once; texts with other white space are encoded whole.
        """
        held = pa.array(texts, pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(held, "\n", " \n \0"), " ")
        offsets, words = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        distinct, which = words.dictionary.to_pylist(), words.indices.to_numpy()
        if len(self.index) > MOST_WORDS:
            self.forget()
        new = [x for x in distinct if x not in self.index]
        odd = {x for x in new if x != "\n" and (not x.strip("\0") or x[0] in WHITE or SPACE_MARK in x or UNUSUAL.search(x, 1))}
        self.learn([x for x in new if x not in odd])
        number = np.fromiter((self.index.get(x, -1) for x in distinct), np.int64, len(distinct))[which]
        strange = sums(number < 0, np.diff(offsets)) > 0
        strange |= pc.match_substring(held, "\0").to_numpy(zero_copy_only=False)
        per_text = np.where(strange, 0, np.diff(offsets))
        used = number[np.repeat(~strange, np.diff(offsets))]
        whole = self._whole([" " + texts[k] for k in np.flatnonzero(strange)])
        return tuple(self._merged(used, per_text, np.flatnonzero(strange), *x) for x in zip(self.kept, whole, strict=True))

    @staticmethod
    def _merged(words: np.ndarray, per_text: np.ndarray, strange: np.ndarray, kept: tuple, whole: Tokens) -> Tokens:
        """Tokens of texts in order: some from their words, the strange ones as encoded whole."""
        starts, counts, ids = kept
        sizes = sums(counts[words], per_text)
        flat = np.concatenate([gathered(ids, starts[words], counts[words]), whole.ids])
        if not len(strange):
            return Tokens(flat, sizes)
        from_words = np.cumsum(sizes) - sizes
        from_words[strange] = int(sizes.sum()) + np.cumsum(whole.per_text) - whole.per_text
        sizes[strange] = whole.per_text
        return Tokens(gathered(flat, from_words, sizes), sizes)


def group_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of A in the group of every token of A, and of B; tokens are given by where they end."""
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)  # the token of B that covers the last byte of each of A
    over_b = np.searchsorted(ends_a, ends_b)
    to = np.concatenate([np.where(ends_b[over_a] > ends_a, n + over_a, np.arange(n)), over_b])
    while True:
        further = to[to]
        if (further == to).all():
            return to[:n], to[n:]
        to = further


def first_of_run(labels: np.ndarray) -> np.ndarray:
    return np.diff(labels, prepend=-1) != 0


def group_digests(a: Tokens, b: Tokens, label_a: np.ndarray, label_b: np.ndarray, digits: Pool) -> list[str]:
    """The sha256 of each text's groups, written as ``a1,a2|b1;a3|b2,b3``."""
    n_ids = len(digits.sizes) // 3
    first_a, first_b = first_of_run(label_a), first_of_run(label_b)
    # Groups follow each other, so a token stands behind those of its own kind and those of the other in groups before (or of the group).
    before_a = np.searchsorted(label_b, label_a)
    before_b = np.searchsorted(label_a, label_b, side="right")
    written = np.empty(len(a.ids) + len(b.ids), np.int64)
    written[np.arange(len(a.ids)) + before_a] = a.ids + np.where(first_a, n_ids, 0)
    written[np.arange(len(b.ids)) + before_b] = b.ids + np.where(first_b, 2 * n_ids, 0)
    per_text = a.per_text + b.per_text
    ends = np.cumsum(per_text)
    found, text, hasher = [], 0, hashlib.sha256()
    for start in range(0, len(written), WRITTEN):  # so many tokens are spelt at a time, whatever the length of a text
        part = written[start : start + WRITTEN]
        spelt, at = digits.joined(part).tobytes(), np.concatenate([[0], np.cumsum(digits.sizes[part])])
        while text < len(ends):
            first, last = ends[text] - per_text[text] - start, min(ends[text] - start, len(part))
            hasher.update(spelt[at[max(first, 0)] + (0 <= first < last) : at[last]])
            if ends[text] > start + len(part):
                break
            found.append(hasher.hexdigest() if per_text[text] else "")
            text, hasher = text + 1, hashlib.sha256()
    return found


def align(texts: list[str], both: TwoTokenizers) -> tuple:
    """n_a, n_b, n_groups, n_links, digest, and the distinct linked pairs with how often each is linked, of every text."""
    a, b = both.encode(texts)
    ends_a, ends_b = np.cumsum(both.bytes_a.sizes[a.ids]), np.cumsum(both.bytes_b.sizes[b.ids])
    if not len(ends_a):
        nothing = np.zeros(len(texts), np.int64)
        return nothing, nothing, nothing, nothing, [""] * len(texts), np.zeros(len(texts) + 1, np.int32), nothing[:0], nothing[:0]
    label_a, label_b = group_labels(ends_a, ends_b)
    lowest = np.searchsorted(ends_b, np.concatenate([[0], ends_a[:-1]]), side="right")
    links = np.searchsorted(ends_b, ends_a) - lowest + 1
    text_of = np.repeat(np.repeat(np.arange(len(texts)), a.per_text), links)
    pair = np.repeat(a.ids, links) * PAIR + b.ids[gathered(np.arange(len(b.ids)), lowest, links)]
    order = np.lexsort((pair, text_of))
    text_of, pair = text_of[order], pair[order]
    new = np.flatnonzero((np.diff(text_of, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
    offsets = np.searchsorted(text_of[new], np.arange(len(texts) + 1))
    groups = sums(first_of_run(label_a), a.per_text)
    digests = group_digests(a, b, label_a, label_b, both.digits)
    return a.per_text, b.per_text, groups, sums(links, a.per_text), digests, offsets, pair[new], np.diff(new, append=len(pair))


@lru_cache(maxsize=2)
def _tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    return TwoTokenizers(path_a, path_b)


def aligned_documents(docs: DataFrame, vocabulary_a: str = "byte_bpe_50k.json", vocabulary_b: str = "piece_bpe_32k.model") -> DataFrame:
    """One row a document, with its numbers, the digest of its groups, and its distinct linked pairs with their times."""
    names = [x.split()[0] for x in ALIGNED.replace("array<long>", "list").split(", ")]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        paths = [x if "/" in x else public_vocabulary(x) for x in (vocabulary_a, vocabulary_b)]
        both = _tokenizers(*paths)
        for batch in (piece for whole in batches for piece in batches_of(whole, 1 << 20)):
            *numbers, digests, offsets, pairs, times = align([x or "" for x in batch["text"].to_pylist()], both)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (pa.array(pairs, pa.int64()), pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(x, pa.int64()) for x in numbers], pa.array(digests, pa.string()), *lists], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows_of, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best: whether no other pair of its id of A has a higher count."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = materialise(counts, "pair-counts")
    a = div(F.col("pair"), PAIR).alias("a")
    highest = counts.groupBy(a).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", a).join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_tokenizers(docs: DataFrame, vocabulary_a: str = "byte_bpe_50k.json", vocabulary_b: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    aligned = aligned_documents(docs, vocabulary_a, vocabulary_b).withColumn("row", F.monotonically_increasing_id())
    aligned = materialise(aligned, "aligned-documents")
    counts = materialise(pair_counts(aligned), "linked-pairs")
    heavy = counts.filter(F.col("count") * HEAVY >= counts.agg(F.sum("count")).scalar())
    light = counts.filter(F.col("count") * HEAVY < counts.agg(F.sum("count")).scalar())
    each = aligned.select("row", F.explode(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))).alias("x")).select("row", "x.*")
    heavy = F.broadcast(heavy)
    partial = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    common = each.join(heavy, "pair").groupBy("row").agg(*partial)
    others = each.join(heavy, "pair", "left_anti").join(light, "pair").groupBy("row").agg(*partial)
    totals = common.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(totals, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
