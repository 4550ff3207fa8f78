"""Token ids as grammar-compressed shards: Re-Pair with random access.

Documents are dealt out in ascending ``doc_id`` order, encoded, and their ids gathered in shards.
Within a shard frequent pairs of neighbouring symbols are replaced by new symbols (nonterminals), the most
frequent first, in rounds, until no pair stands there ``least`` times; a rule holds the pair and the number of ids it expands to. No
rule crosses the end of a document, so every document is a run of symbols and any range of its ids can be
decoded from the expansion lengths, without its neighbours.

A shard is one row of a Parquet table that Spark writes and commits: ``part``, ``shard`` (their order is the order of the
documents), ``n_docs``, ``n_ids``, ``n_symbols``, ``n_rules`` and ``blob``. A blob stands alone; integers are little-endian:

    4s magic "RPG1" | u32 n_docs, base, n_rules, n_symbols | u32 crc32 of all that follows
    u32 left[n_rules] | u32 right[n_rules] | u32 length[n_rules]
    u32 symbols_per_doc[n_docs] | u32 ids_per_doc[n_docs] | i64 doc_id[n_docs] | u8 doc_id_is_null[n_docs]
    u16 low[n_symbols] | u8 high[n_symbols]      symbol = low + 65536 * high; below base an id, else rule symbol - base

Defined cases: a null or empty text has the end id alone; a null ``doc_id`` sorts first; repeated rows are kept; an
empty table gives an empty table; other columns are ignored; a text of any length is one run inside one shard.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.common import batches_of, given_back, whole_text

MAGIC, HEADER = b"RPG1", struct.Struct("<4s5I")
SHARDS = "part long, shard long, n_docs long, n_ids long, n_symbols long, n_rules long, blob binary"
DECODED = "part long, shard long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


class TextEncoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    A byte-level BPE never merges across a space that stands before a visible character, a line break between
    visible characters, or between a word and the punctuation after it, so a text is the concatenation of such pieces. Each
    distinct piece is encoded by the library once and then looked up. A text that holds the string of a special token is
    encoded whole, as the library cuts it there first.
    """

    PUNCTUATION = ".,;:!?)"
    AT_ONCE = 16  # words that are encoded together
    UNUSUAL = re.compile("[\0\t\x0b-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str, most_pieces: int = 500_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.vocabulary = self.tokenizer.model, self.tokenizer.get_vocab_size()
        # The character that stands for each byte in the vocabulary, as the library has it.
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {b: letters.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        for char in map(chr, range(128, 0x800)):
            for byte, letter in zip(char.encode(), letters.pre_tokenize_str(char)[0][0], strict=True):
                self.letters[byte] = letter
        # Words of letters are merged together only if no merge crosses a space before a letter and a word is what its merges give.
        space, back = self.letters[32], {letter: byte for byte, letter in self.letters.items()}
        self.spaced = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        inner = []
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.spaced[k] = token[:1] == space
            if space in token.lstrip(space):
                inner.append(token)
        model = self.model
        odd = getattr(model, "ignore_merges", False) or model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix
        self.parted = not odd and all(bytes(back.get(c, ord(c)) for c in x).decode(errors="replace").isspace() for x in inner)
        self.most_pieces = most_pieces
        self.clear()

    def clear(self) -> None:
        """Drops all pieces."""
        self.index: dict[str, int] = {}
        self.starts, self.sizes, self.ids, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool)

    def forget(self) -> None:
        """Drops the pieces that no later batch has met again; all, if the others fill half of the room."""
        again = np.flatnonzero(self.met)
        if 2 * len(again) > self.most_pieces:
            again = again[:0]
        keys = list(self.index)  # in the order of their codes
        self.index = {keys[k]: code for code, k in enumerate(again.tolist())}
        sizes = self.sizes[again]
        self.ids = gathered(self.ids, self.starts[again], sizes)
        self.starts, self.sizes, self.met = np.cumsum(sizes) - sizes, sizes, np.zeros(len(again), bool)

    def _add(self, keys: list[str], starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.index.update(zip(keys, range(len(self.index), len(self.index) + len(keys)), strict=True))
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        self.met = np.concatenate([self.met, np.zeros(len(keys), bool)])

    def _encoded(self, key: str) -> list[int]:
        """Ids of a piece; one of letters alone goes to the library's BPE without its search for pieces."""
        text = key[1:] if key[0] == "\0" else key if key == "\n" else " " + key
        if key.isalpha() or text.isalpha():
            return [x.id for x in self.model.tokenize(self.spelt(text))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def spelt(self, text: str) -> str:
        """A text of letters and single spaces in the characters that stand for its bytes."""
        if text.isascii():
            return text.replace(" ", self.letters[32])
        return text.encode().decode("latin-1").translate(self.letters)

    def _one_by_one(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self._encoded(key) for key in keys]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _together(self, keys: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words that follow a space, some at a time: where a token begins with a space, so does a word."""
        found: list[int] = []
        for at in range(0, len(keys), self.AT_ONCE):
            some = keys[at : at + self.AT_ONCE]
            text = " " + " ".join(some)
            if letters and self.parted:
                found += [x.id for x in self.model.tokenize(self.spelt(text))]
            elif letters or any(x in text for x in self.special):
                found += chain.from_iterable(map(self._encoded, some))
            else:
                found += self.tokenizer.encode(text, add_special_tokens=False).ids
        ids = np.array(found, np.uint32)
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(keys):  # a word in which a special token follows its space
            return self._one_by_one(keys)
        return ids, np.diff(starts, append=len(ids))

    def learn(self, keys: list[str]) -> None:
        """Adds keys: a word with punctuation after it from its two parts, all others by the library.

        A key is a word that follows a space, a line break, or NUL and a piece as it stands.
        """
        index, others = self.index, [x for x in keys if not x.isalpha()]
        whole, compound, stems, tails = [], [], [], []
        for key in others:
            stem = key.rstrip(self.PUNCTUATION)
            if len(stem) < len(key) and stem[-1:].isalnum():
                compound.append(key)
                stems.append(stem)
                tails.append("\0" + key[len(stem) :])
            else:
                whole.append(key)
        whole += [x for x in dict.fromkeys(chain(stems, dict.fromkeys(tails))) if x not in index]
        words = list(dict.fromkeys(chain(filter(str.isalpha, keys), filter(str.isalpha, whole))))
        others = dict.fromkeys(x for x in whole if not x.isalpha())
        alone = [x for x in others if x[0] == "\0" or x == "\n"]
        mixed = [x for x in others if x[0] != "\0" and x != "\n"]
        found = [self._together(words, True), self._together(mixed, False), self._one_by_one(alone)]
        ids, sizes = (np.concatenate([x[k] for x in found]) for k in range(2))
        self._add([*words, *mixed, *alone], np.cumsum(sizes) - sizes, sizes, ids)
        if compound:
            parts = np.fromiter(map(index.__getitem__, chain(stems, tails)), np.int64, 2 * len(compound)).reshape(2, -1).T
            sizes = self.sizes[parts]
            ids = gathered(self.ids, self.starts[parts.ravel()], sizes.ravel())
            sizes = sizes.sum(axis=1)
            self._add(compound, np.cumsum(sizes) - sizes, sizes, ids)

    def codes(self, keys: list[str]) -> np.ndarray:
        if len(self.index) > self.most_pieces:
            self.forget()
        known = self.index
        self.learn([key for key in keys if key not in known])
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts, number of ids of each); a null is empty.

        Words are cut and told apart by Arrow. A text with white space other than single spaces and line breaks
        between visible characters shows pieces that no plain text has, and is cut before single spaces only.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        mark, nothing = pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string())
        marked = pc.binary_join_element_wise(mark, pc.replace_substring(texts, "\n", " \n \0"), nothing)
        cut = pc.split_pattern(marked, " ")
        offsets, words = cut.offsets.to_numpy() - cut.offsets[0].as_py(), cut.flatten().dictionary_encode()
        distinct, which = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        if len(self.index) > self.most_pieces:
            self.forget()
        known = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(known < 0)
        self.met[known[known >= 0]] = True
        new = [distinct[k] for k in fresh.tolist()]
        odd = {x for x in new if not x.strip("\0") or self.UNUSUAL.search(x, 1)}
        self.learn([x for x in new if x not in odd] if odd else new)
        known[fresh] = np.fromiter(map(self.index.get, new, repeat(-1)), np.int64, len(new))
        code = known[which]
        strange = np.add.reduceat(code < 0, offsets[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        for mark in ("\0", *self.special):
            strange |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if not strange.any():
            sizes = self.sizes[code]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            return gathered(self.ids, self.starts[code], sizes), np.diff(ends[offsets])
        if len(texts) > 1:
            found = [self.encode(texts.filter(pa.array(~strange))), *(self.encode(texts[int(k) : int(k) + 1]) for k in np.flatnonzero(strange))]
            sizes = np.zeros(len(texts), np.int64)
            sizes[~strange], sizes[strange] = found[0][1], [x[0] for _, x in found[1:]]
            order = np.concatenate([np.flatnonzero(~strange), np.flatnonzero(strange)])
            flat = np.concatenate([x for x, _ in found])
            starts = np.empty(len(texts), np.int64)
            starts[order] = np.cumsum(sizes[order]) - sizes[order]
            return gathered(flat, starts, sizes), sizes
        text = texts[0].as_py()
        if any(x in text for x in self.special):
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            return ids, np.array([len(ids)])
        code = self.codes_of(["\0" + x for x in re.split(r"(?= \S)", text) if x])
        return gathered(self.ids, self.starts[code], self.sizes[code]), np.array([self.sizes[code].sum()])

    def codes_of(self, keys: list[str]) -> np.ndarray:
        distinct = list(dict.fromkeys(keys))
        at = dict(zip(distinct, self.codes(distinct).tolist(), strict=True))
        return np.fromiter(map(at.__getitem__, keys), np.int64, len(keys))


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + length]``, one after the other; made some at a time, so that places stay in the processor's cache."""
    ends = np.cumsum(lengths)
    found = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    shifts, done = starts - (ends - lengths), 0
    for at in range(0, len(ends), 1 << 15):
        upto = int(ends[at : at + (1 << 15)][-1])
        places = np.repeat(shifts[at : at + (1 << 15)], lengths[at : at + (1 << 15)])
        places += np.arange(done, upto)
        found[done:upto] = values[places]
        done = upto
    return found


def grammar(ids: np.ndarray, doc_ends: np.ndarray, base: int, least: int, spread: int = 8):
    """(symbols, symbols per document, left, right) of the ids; ``doc_ends`` are the positions of last ids.

    A round replaces, from left to right, all pairs at least 1/``spread`` as frequent as the most frequent one
    and at least ``least`` times there.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[doc_ends] = True
    left, right = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    top = base
    while len(symbols) > 1:
        # A pair's bucket is never rarer than the pair: pairs of rare buckets need no exact count.
        bucket = (symbols[:-1] * np.uint32(0x9E3779B1) + symbols[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(14)
        often = np.bincount(bucket, minlength=1 << 18)
        wanted = max(least, int(often.max()) // spread)
        at = np.flatnonzero((often >= wanted)[bucket] & ~last[:-1])
        pairs, which, counts = np.unique(symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1], return_inverse=True, return_counts=True)
        if not len(pairs) or (most := int(counts.max())) < least:
            break
        frequent = np.flatnonzero(counts >= min(most, wanted))
        order = frequent[np.argsort(-counts[frequent], kind="stable")]
        number = np.zeros(len(pairs), np.uint32)
        number[order] = np.arange(top, top + len(order))
        new = number[which]
        at, new = at[new > 0], new[new > 0]
        # Of matches that overlap in a run, the first, third, ... stand.
        starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        offset = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
        at, new = at[offset % 2 == 0], new[offset % 2 == 0]
        symbols[at] = new
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        left.append((pairs[order] >> np.uint64(32)).astype(np.uint32))
        right.append(pairs[order].astype(np.uint32))
        top += len(order)
        if top >= 1 << 24:
            raise ValueError("symbols take more than three bytes; use smaller shards")
    return symbols, np.diff(np.flatnonzero(last), prepend=-1), *(np.concatenate(x).astype(np.int64) for x in (left, right))


def rule_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to; a rule names only ids and rules of earlier rounds."""
    lengths = np.zeros(len(left), np.int64)
    todo = np.arange(len(left))
    while len(todo):
        sides = [np.where(x < base, 1, lengths[np.maximum(x - base, 0)]) for x in (left[todo], right[todo])]
        known = (sides[0] > 0) & (sides[1] > 0)
        lengths[todo[known]] = (sides[0] + sides[1])[known]
        todo = todo[~known]
    return lengths


def write_shard(docs: list[tuple[int | None, np.ndarray]], base: int, least: int) -> tuple[bytes, int, int]:
    """(blob, number of symbols, number of rules) of documents given as (doc_id, ids with the end id)."""
    sizes = np.array([len(ids) for _, ids in docs], np.int64)
    symbols, per_doc, left, right = grammar(np.concatenate([ids for _, ids in docs]), np.cumsum(sizes) - 1, base, least)
    body = b"".join(
        [
            left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), rule_lengths(left, right, base).astype("<u4").tobytes(),
            per_doc.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(),
            np.array([x or 0 for x, _ in docs], "<i8").tobytes(), np.array([x is None for x, _ in docs], "u1").tobytes(),
            (symbols & 0xFFFF).astype("<u2").tobytes(), (symbols >> 16).astype("u1").tobytes(),
        ]
    )
    return HEADER.pack(MAGIC, len(docs), base, len(left), len(symbols), zlib.crc32(body)) + body, len(symbols), len(left)


class Shard:
    """A blob, opened for reading whole documents or ranges of their ids."""

    def __init__(self, blob: bytes):
        magic, n_docs, self.base, n_rules, n_symbols, crc = HEADER.unpack_from(blob)
        if magic != MAGIC or zlib.crc32(memoryview(blob)[HEADER.size :]) != crc:
            raise ValueError("not a whole shard")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(blob, kind, n, at)
            at += found.nbytes
            return found

        self.left, self.right, lengths = (take("<u4", n_rules).astype(np.int64) for _ in range(3))
        self.symbol_ends = np.cumsum(take("<u4", n_docs).astype(np.int64))
        self.sizes = take("<u4", n_docs).astype(np.int64)
        ids, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if null else int(x) for x, null in zip(ids, nulls, strict=True)]
        self.symbols = take("<u2", n_symbols).astype(np.int64) | take("u1", n_symbols).astype(np.int64) << 16
        self.lengths = lengths

    def spans(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.base, 1, self.lengths[np.maximum(symbols - self.base, 0)] if len(self.lengths) else 1)

    def unfolded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for: rules are replaced by their pairs until none is left."""
        while len(rules := np.flatnonzero(symbols >= self.base)):
            width = np.ones(len(symbols), np.int64)
            width[rules] = 2
            at = np.cumsum(width) - width
            wider = np.empty(int(width.sum()), np.int64)
            wider[at] = symbols
            wider[at[rules]], wider[at[rules] + 1] = self.left[symbols[rules] - self.base], self.right[symbols[rules] - self.base]
            symbols = wider
        return symbols

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for, each rule being unfolded once however often it occurs there."""
        used = np.zeros(self.base + len(self.left), bool)
        used[symbols] = True
        rules = self.base + np.flatnonzero(used[self.base :])
        spans = self.spans(rules)
        known = np.concatenate([np.arange(self.base), self.unfolded(rules)]).astype(np.uint32)
        # Of every symbol, the place and number of its ids in ``known``.
        starts, lengths = np.arange(len(used)), np.ones(len(used), np.int64)
        starts[rules], lengths[rules] = self.base + np.cumsum(spans) - spans, spans
        return gathered(known, starts[symbols], lengths[symbols])

    def document(self, n: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``start:end`` of the n-th document; only the symbols that cover them are expanded."""
        run = self.symbols[self.symbol_ends[n - 1] if n else 0 : self.symbol_ends[n]]
        end = int(self.sizes[n]) if end is None else min(end, int(self.sizes[n]))
        if start >= end:
            return np.zeros(0, np.uint32)
        ends = np.cumsum(self.spans(run))
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left")
        before = int(ends[first - 1]) if first else 0
        return self.expanded(run[first : last + 1])[start - before : end - before]

    def documents(self) -> Iterator[np.ndarray]:
        ids, ends = self.expanded(self.symbols), np.cumsum(self.sizes)
        return (ids[end - size : end] for end, size in zip(ends, self.sizes, strict=True))


@lru_cache(maxsize=2)
def _encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def public_vocabulary(name: str) -> str:
    """The path of a vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_shards(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", shard_ids: int = 1 << 18, least: int = 12, end_id: int = 0,
    order: list[str] | None = None,
) -> DataFrame:
    """Shards of the documents, in ascending ``doc_id`` order or that of the given columns.

    Texts are dealt out by ranges of the order, so that parts and shards count up with it; a task holds
    one shard (``shard_ids`` ids, or one longer document) at a time. Distinct pieces are known to their task alone, so that
    workers hold none of them when it is over.
    """
    keys = order or ["doc_id"]
    tied = F.xxhash64("text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        docs.select(*dict.fromkeys([*keys, "doc_id"]), whole_text().alias("text"))
        .repartitionByRange(parts, *keys, tied)
        .sortWithinPartitions(*keys, tied)
        .select("doc_id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(public_vocabulary(vocabulary) if "/" not in vocabulary else vocabulary)
        part, shard, held, n_held, base = TaskContext.get().partitionId(), 0, [], 0, encoder.vocabulary
        end = np.array([end_id], np.uint32)

        def closed() -> pa.RecordBatch:
            blob, n_symbols, n_rules = write_shard(held, base, least)
            row = [part, shard, len(held), n_held, n_symbols, n_rules, blob]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row], names)

        names = [x.split()[0] for x in SHARDS.split(", ")]
        for batch in (piece for whole in batches for piece in batches_of(whole, 2 << 20)):
            flat, sizes = encoder.encode(batch["text"])
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                if held and n_held + len(ids) + 1 > shard_ids:
                    yield closed()
                    shard, held, n_held = shard + 1, [], 0
                held.append((doc_id, np.concatenate([ids, end])))
                n_held += len(ids) + 1
        if held:
            yield closed()
        encoder.clear()

    return dealt.mapInArrow(given_back(encode), SHARDS)


def decode_shards(shards: DataFrame) -> DataFrame:
    """Per document: its place, the ids before it in its shard, its number of ids and their crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DECODED.split(", ")]
        for batch in batches:
            for part, number, blob in zip(batch["part"], batch["shard"], batch["blob"], strict=True):
                shard = Shard(blob.as_py())
                crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.documents()]
                n = len(crcs)
                columns = [
                    np.full(n, part.as_py()), np.full(n, number.as_py()), pa.array(shard.doc_ids, pa.int64()),
                    np.cumsum(shard.sizes) - shard.sizes, shard.sizes, np.array(crcs, np.int64),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    return shards.select("part", "shard", "blob").mapInArrow(given_back(decode), DECODED)


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """What the files at ``path`` hold: doc_id, start (ids before the document), n_tokens, ids_crc32, part, shard.

    Starts come from two running sums, over the shards of a part and over the parts.
    """
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    before = F.lit(0).cast("long")
    part_starts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), before).alias("part_start")
    )
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(within), before)).join(part_starts, "part")
    starts = starts.select("part", "shard", (F.col("in_part") + F.col("part_start")).alias("shard_start"))
    return decode_shards(shards).join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part", "shard"
    )
