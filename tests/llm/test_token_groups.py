"""Groups, links and counts against a token-by-token walk over whole texts."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpus_rows import prose, row
from tokenizers import Tokenizer

from paceline.llm import token_groups
from paceline.llm.token_groups import TwoTokenizers, align, align_tokenizers, group_labels

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_letters() -> dict[str, int]:
    """The published table of byte-level BPE: printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(others)}


def plain_tokens(text: str, a: Tokenizer, b) -> tuple[list, list] | None:
    """(id, bytes) of both tokenizers' tokens; None if either does not cover the text."""
    letters = byte_letters()
    found_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    found_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (found_a, found_b) if text and all(b"".join(x for _, x in f) == whole for f in (found_a, found_b)) else None


def plain_alignment(texts: list[tuple]) -> Counter:
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    docs, holders = [], defaultdict(set)
    for k, (doc_id, text) in enumerate(texts):
        tokens = plain_tokens(text or "", a, b)
        if tokens is None:
            docs.append((doc_id, 0, 0, [], ""))
            continue
        groups, links, i, j, at_a, at_b = [([], [])], [], 0, 0, 0, 0
        while i < len(tokens[0]):
            end_a, end_b = at_a + len(tokens[0][i][1]), at_b + len(tokens[1][j][1])
            links.append((tokens[0][i][0], tokens[1][j][0]))
            if end_a <= end_b:
                groups[-1][0].append(tokens[0][i][0])
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                groups[-1][1].append(tokens[1][j][0])
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(([], []))
        groups.pop()
        for pair in links:
            holders[pair].add(k)
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((doc_id, len(tokens[0]), len(tokens[1]), links, hashlib.sha256(written.encode()).hexdigest(), len(groups)))
    highest = defaultdict(int)
    for (x, _), held in holders.items():
        highest[x] = max(highest[x], len(held))
    found = Counter()
    for doc_id, n_a, n_b, links, digest, *groups in docs:
        counts = [len(holders[p]) for p in links]
        found[doc_id, n_a, n_b, sum(groups), len(links), sum(c == highest[p[0]] for c, p in zip(counts, links, strict=True)), sum(counts), digest] += 1
    return found


def found_alignment(docs) -> Counter:
    return Counter(map(tuple, align_tokenizers(docs).select(*COLUMNS).collect()))


ODD = [
    "a  b", " lead", "trail ", "  ", "\n", "x\n\n y", "tab\there", "\r\nline\r", "\0nul", "<|endoftext|> <s> </s> <0x41> <unk>", "日本語のテキスト、句読点。", "🙂👍🏽 emoji",
    "ﬁ ligature é é ａ", "　wide space", "▁mark", "mid▁dle", "naïve café straße", "1234567890 3.14", "a" * 500, "�﻿", "don't I'll we've",
]


def test_every_byte_has_its_letter():
    both = TwoTokenizers(*PATHS)
    letters, a = byte_letters(), both.a
    for k in range(a.get_vocab_size()):
        name = a.id_to_token(k)
        if all(c in letters for c in name):
            got = both.bytes_a.joined(np.array([k])).tobytes()
            assert got == bytes(letters[c] for c in name) or not got and any(letters[c] in (0xC0, 0xC1) or letters[c] > 0xF4 for c in name)


def test_labels_are_components():
    draw = random.Random(1)
    for _ in range(50):
        n = draw.randint(1, 60)
        ends = [np.array(sorted(draw.sample(range(1, n), draw.randrange(n)) + [n])) for _ in range(2)]
        shared = sorted(set(ends[0]) & set(ends[1]))
        for labels, own in zip(group_labels(*ends), ends, strict=True):
            assert [ends[0][k] for k in labels] == [min(s for s in shared if s >= e) for e in own]


def test_long_chains_take_few_doublings():
    n = 200_000
    a, b = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n - 1, 2), 2 * n)
    began = time.time()
    assert set(group_labels(a, b)[0]) == {len(a) - 1}
    assert time.time() - began < 5


@pytest.mark.parametrize("heavy", [1 << 16, 40, 1])
def test_equal_to_a_plain_walk(make_docs, monkeypatch, heavy):
    """Whatever part of the pairs is broadcast."""
    monkeypatch.setattr(token_groups, "HEAVY", heavy)
    rows = [row(k, prose(k, 5 + 7 * k, "de" if k % 2 else "en")) for k in range(30)] + [row(100 + k, x) for k, x in enumerate(ODD)]
    rows += [row(200, rows[3]["text"]), row(3, rows[3]["text"])]
    assert found_alignment(make_docs(rows, 3)) == plain_alignment([(r["doc_id"], r["text"]) for r in rows])


@pytest.mark.parametrize("written", [1, 7, 1 << 17])
def test_digests_in_pieces(monkeypatch, written):
    monkeypatch.setattr(token_groups, "WRITTEN", written)
    texts = ["", *ODD, prose(1, 200), "", "x", ""]
    expected = sorted((c[-1], c[1]) for c in plain_alignment([(k, x) for k, x in enumerate(texts)]))
    n_a, _, _, _, digests, *_ = align(texts, TwoTokenizers(*PATHS))
    assert sorted(zip(digests, n_a.tolist(), strict=True)) == expected


def test_words_and_whole_texts_give_the_same(monkeypatch):
    """Whatever the words that are kept, and however white space stands."""
    both, draw = TwoTokenizers(*PATHS), random.Random(9)
    parts = ["the", "Haus.", "x", "\n", " ", "  ", "\n\n", "\t", "don't", "日本", "é", "\u00a0", "7", "!?", "\r\n", "🙂", "a.b", "\u2003", "\x1c", "▁", "'s"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(4000)]
    whole = both._whole([" " + x for x in texts])
    monkeypatch.setattr(token_groups, "CHUNK", 5)
    for most in (600_000, 3):
        monkeypatch.setattr(token_groups, "MOST_WORDS", most)
        for k in range(0, 4000, 500):
            for got, expected in zip(both.encode(texts[k : k + 500]), whole, strict=True):
                at = np.concatenate([[0], np.cumsum(expected.per_text)])
                assert got.per_text.tolist() == expected.per_text[k : k + 500].tolist()
                assert got.ids.tolist() == expected.ids[at[k] : at[k + 500]].tolist()


def test_awkward(awkward, awkward_rows, nothing):
    assert found_alignment(awkward) == plain_alignment([(r["doc_id"], r["text"]) for r in awkward_rows])
    assert not found_alignment(nothing)
