"""Token shards: exact round trips against the tokenizer itself."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus_rows import prose, row
from hypothesis import given, settings
from hypothesis import strategies as st

from paceline.llm.repair import Shard, TextEncoder, document_index, encode_shards, public_vocabulary, write_shard

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = public_vocabulary("byte_bpe_50k.json")
ENCODER = TextEncoder(VOCABULARY)
PLAIN = tokenizers.Tokenizer.from_file(VOCABULARY)

ODD = [
    "a  b", " a", "a\n b  ", "  ", "x ", "a \nb", "it's 's can't. don't!'s ab.'s x.) y", "", "\x1c a \x1cb", "\0a b\0", "\na\nb", "a\tb c", "\n\n",
    "1.5 3,000. ①. ´a.", "日本 語.", "a b \0c", "ǅ ﬁ ß", "<|endoftext|> x", "end <|endoftext|> of", "a<|endoftext|><|endoftext|>b\n", "<|endoftext", "x \0 <|endoftext|>", "a.b.c..d ...", "é ​ x y", "x\n\0y",
]


def plain_ids(text: str) -> list[int]:
    return PLAIN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_encoding_of_odd_texts(text):
    ids, sizes = ENCODER.encode(pa.array([text]))
    assert ids.tolist() == plain_ids(text) and sizes.tolist() == [len(ids)]


def test_encoding_of_a_batch_with_nulls():
    ids, sizes = ENCODER.encode(pa.array([*ODD, None, "plain words. here"]))
    parts = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert parts == [*map(plain_ids, ODD), [], plain_ids("plain words. here")]


class Counted:
    """A tokenizer's model that counts its calls."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, text: str):
        self.calls += 1
        return self.model.tokenize(text)


def test_new_words_are_merged_some_at_a_time():
    words = [f"{a}{b}é{c}" if c == "x" else f"{a}{b}{c}" for a in ("ba", "co", "Dü", "elle") for b in ("tion", "ß", "men", "日本", "ov") for c in ("a", "x", "ing", "ſ", "que")]
    texts = [" ".join(words), "x " + " ".join(f"{w}, {w}7 {w}-{w}!" for w in words)]
    encoder = TextEncoder(VOCABULARY)
    encoder.model = Counted(encoder.model)
    ids, sizes = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [*map(plain_ids, texts)]
    assert encoder.model.calls <= len(words) // 8


def test_words_that_do_not_begin_with_their_space_are_encoded_alone():
    words = ["plain", "<|endoftext|>", "a1", "<|endoftext|>b2", "c<|endoftext|>", "it's", "d4"]
    ids, sizes = ENCODER._together(words, False)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain_ids(f" {x}") for x in words]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab c.'\n\t1é !"), max_size=30), min_size=1, max_size=4))
def test_encoding_equals_the_tokenizer(texts):
    ids, sizes = ENCODER.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain_ids(x) for x in texts]


def test_a_full_table_of_pieces_is_emptied():
    small = TextEncoder(VOCABULARY, most_pieces=3)
    for text in ("one two three four", "five six seven", "one two"):
        assert small.encode(pa.array([text]))[0].tolist() == plain_ids(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=60), min_size=1, max_size=5), st.integers(2, 5))
def test_grammar_round_trip_and_random_access(docs, least):
    docs = [(k, np.array([*ids, 0], np.uint32)) for k, ids in enumerate(docs)]
    shard = Shard(write_shard(docs, 10, least)[0])
    for (k, ids), found in zip(docs, shard.documents(), strict=True):
        assert found.tolist() == ids.tolist()
        for start, end in ((0, 1), (1, len(ids)), (len(ids) // 2, len(ids) // 2 + 2), (len(ids), None)):
            assert shard.document(k, start, end).tolist() == ids[start:end].tolist()


def test_grammar_shortens_repetition_and_keeps_rules_inside_documents():
    docs = [(k, np.array([1, 2, 3, 4] * 50 + [0], np.uint32)) for k in range(3)]
    blob, n_symbols, n_rules = write_shard(docs, 10, 4)
    assert n_symbols < 60 and n_rules >= 3
    shard = Shard(blob)
    assert shard.symbol_ends[-1] == n_symbols and shard.lengths.max() > 2
    assert all(shard.lengths[k] == len(shard.expanded(np.array([10 + k]))) for k in range(n_rules))


def test_no_frequent_pair_remains():
    """Pairs that overlap themselves count as often as they can be replaced side by side."""
    draw = np.random.default_rng(3)
    docs = [(k, np.append(draw.zipf(1.5, 300) % 50, 0).astype(np.uint32)) for k in range(20)]
    shard = Shard(write_shard(docs, 60, 12)[0])
    pairs, before = Counter(), np.concatenate([[0], shard.symbol_ends[:-1]])
    for start, end in zip(before, shard.symbol_ends, strict=True):
        run, k = shard.symbols[start:end].tolist(), 0
        for pair in set(zip(run, run[1:])):
            k, n = 0, 0
            while k < len(run) - 1:
                hit = (run[k], run[k + 1]) == pair
                n, k = n + hit, k + 1 + hit
            pairs[pair] += n
    assert max(pairs.values()) < 12


def test_a_broken_shard_is_refused():
    blob = write_shard([(1, np.array([1, 0], np.uint32))], 10, 4)[0]
    with pytest.raises(ValueError):
        Shard(blob[:-1] + b"\xff")


def brute_force(rows):
    ordered, start, found = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)), 0, []
    for r in ordered:
        ids = [*plain_ids(r["text"] or ""), 0]
        found.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


@pytest.mark.parametrize("shard_ids", [1 << 18, 500])
def test_documents_come_back_in_order(spark, awkward, awkward_rows, tmp_path, shard_ids):
    path = str(tmp_path / "shards")
    rows = [r for r in awkward_rows if r["doc_id"] is not None or r["text"] is not None]  # different texts of one id have no order
    encode_shards(awkward.filter("doc_id is not null or text is not null"), shard_ids=shard_ids).write.parquet(path)
    found = [tuple(r)[:4] for r in document_index(spark, path).collect()]
    # Rows of equal doc_id and text are alike, whichever comes first.
    assert sorted(found, key=lambda r: r[1]) == brute_force(rows)


def test_an_empty_table(spark, nothing, tmp_path):
    encode_shards(nothing).write.parquet(str(tmp_path / "none"))
    assert document_index(spark, str(tmp_path / "none")).count() == 0


def test_pieces_met_once_are_dropped():
    """The table of pieces stays small however many words pass; what comes again stays known, and ids stay right."""
    encoder, often = TextEncoder(VOCABULARY, most_pieces=400), "common words, met again. "
    known = []
    for k in range(12):
        text = often + " ".join(f"w{k}x{n}é abc{chr(97 + k)}{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(150))
        before = {"common", "words,", "met"} <= {x.strip("\0") for x in encoder.index}
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == plain_ids(text)
        known.append(before)
        assert len(encoder.index) < 400 + 400
    assert sum(known) >= 10


def test_workers_keep_no_pieces(spark, make_docs, tmp_path):
    """Python workers outlive their tasks: the encoder they keep holds nothing of the texts that it has read."""
    docs = make_docs([row(k, prose(k, 200)) for k in range(64)])
    encode_shards(docs).write.parquet(str(tmp_path / "shards"))

    def held(batches):
        from paceline.llm.repair import _encoder

        found = []
        for batch in batches:
            if _encoder.cache_info().currsize:
                found.append(len(_encoder(VOCABULARY).index))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["n"])

    counts = [r["n"] for r in spark.range(64, numPartitions=32).mapInArrow(held, "n long").collect()]
    assert counts and set(counts) == {0}
