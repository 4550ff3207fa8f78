"""Near-duplicate lines against a comparison of all pairs."""

from __future__ import annotations

import random
import re

import pytest
from corpus_rows import prose, row

from paceline.llm.line_neighbours import near_duplicate_lines, without_lines


def within(a: list[str], b: list[str]) -> bool:
    """Edit distance over words of one at most, by brute force."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain(rows):
    lines = set()
    for r in rows:
        for k, line in enumerate((r["text"] or "").split("\n")):
            words = re.findall(r"[^\W_]+", line.lower())
            if words:
                lines.add(((r["doc_id"] is not None, r["doc_id"] or 0, k), tuple(words)))
    found = set()
    for place, words in lines:
        near = [(p, w) for p, w in lines if p < place and (w == words or min(len(w), len(words)) >= 5 and within(list(w), list(words)))]
        if near:
            p, _ = min(near)
            first = min(q for q, w in lines if w == words)
            found.add((place[1] if place[0] else None, place[2], p[1] if p[0] else None, p[2], int(p < first)))
    return found


def edited(line: str, draw: random.Random) -> str:
    words = line.split()
    at, kind = draw.randrange(len(words)), draw.randrange(4)
    if kind == 0:
        words[at] = "changed"
    elif kind == 1:
        words.insert(at, "added")
    elif kind == 2:
        del words[at]
    return "  ".join(words).upper() if draw.random() < 0.3 else " ".join(words)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_comparison_of_all_pairs(spark, make_docs, seed):
    draw = random.Random(seed)
    lines = [prose(seed * 100 + k, draw.randint(3, 14)).replace("\n", " ") for k in range(25)]
    for _ in range(60):
        lines.append(edited(draw.choice(lines), draw))
    lines += ["one two three four five", "one two three four", "a a a a a a", "a a a a a", "x a a a a a", "the the of of the the of", "the of of the the of"]
    draw.shuffle(lines)
    rows = [row(k, "\n".join(lines[k * 4 : k * 4 + 4])) for k in range(len(lines) // 4 + 1)]
    assert {tuple(r) for r in near_duplicate_lines(make_docs(rows)).collect()} == plain(rows)


def test_a_family_that_shares_one_key(spark, make_docs):
    """Many lines that differ in one place: each goes but the earliest, over a linear number of links."""
    rows = [row(k, f"Page number {k} of the annual report") for k in range(300)]
    found = near_duplicate_lines(make_docs(rows)).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(1, 300)) and {r["kept_doc_id"] for r in found} == {0}


def test_only_dataframe_operations(spark, make_docs):
    plan = near_duplicate_lines(make_docs([row(1, "a b c d e f")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_awkward_rows(spark, awkward, awkward_rows, nothing):
    short = [r for r in awkward_rows if len(r["text"] or "") < 10_000]
    found = near_duplicate_lines(awkward)
    assert {tuple(r) for r in found.collect() if r["doc_id"] != 11} == plain(short)
    kept = without_lines(awkward, found)
    assert kept.columns == awkward.columns and kept.count() == len(awkward_rows)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[7] is None and texts[8] == "" and texts[5] == ""
    assert near_duplicate_lines(nothing).count() == 0


def test_a_line_of_many_words(spark, make_docs):
    words = [f"w{k}" for k in range(20_000)]
    rows = [row(1, " ".join(words)), row(2, " ".join(words[:9999] + words[10_000:])), row(3, " ".join(words[:10] + words[12:]))]
    assert {tuple(r) for r in near_duplicate_lines(make_docs(rows)).collect()} == {(2, 0, 1, 0, 1)}
