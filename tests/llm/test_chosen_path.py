"""The join against all pairs; recall; large groups; components."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pytest
from corpus_rows import prose, row

from paceline.llm.chosen_path import PathSettings, compare, near_duplicates, one_of_each, shared_counts, word_form
from paceline.llm.components import connected_components


def shingle_set(text: str | None, size: int = 5) -> frozenset:
    words = [w for w in (word_form(x) for x in (text or "").split()) if w]
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def plain(rows):
    """(doc_id, class_id, n_copies, n_links) of every row, by comparing all pairs of distinct sets."""
    sets = [shingle_set(r["text"]) for r in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    links = {s: [t for t in distinct if t is not s and len(s & t) * 1800 >= 800 * (len(s) + len(t))] for s in distinct}
    component = {}
    for s in distinct:
        todo, seen = [s], {s}
        while todo:
            for t in links[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        ids = [r["doc_id"] for r, x in zip(rows, sets, strict=True) if x in seen and r["doc_id"] is not None]
        component[s] = min(ids, default=None)
    return [
        (r["doc_id"], component[s] if s else r["doc_id"], sets.count(s) if s else 1, len(links[s]) if s else 0) for r, s in zip(rows, sets, strict=True)
    ]


def edited(text: str, draw: random.Random, edits: int) -> str:
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


def same(found, wanted):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(9)
    texts = [prose(k, draw.randint(40, 160)) for k in range(60)]
    texts += [edited(draw.choice(texts[:30]), draw, draw.randint(0, 4)) for _ in range(80)]
    shared = prose(999, 60)
    texts += [shared + " " + prose(2000 + k, 50) for k in range(40)]
    return [row(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("settings", [PathSettings(), PathSettings(bucket=5, block_shingles=700), PathSettings(bucket=3, levels=2, block_shingles=200)])
def test_equals_all_pairs(spark, make_docs, corpus, settings):
    """Also with buckets so small that every group is split or compared in blocks."""
    same(near_duplicates(make_docs(corpus), settings).collect(), plain(corpus))


def test_a_large_group_of_near_copies(spark, make_docs):
    draw, base = random.Random(3), prose(1, 120)
    rows = [row(k, edited(base, draw, 1)) for k in range(150)] + [row(200 + k, base) for k in range(50)]
    same(near_duplicates(make_docs(rows), PathSettings(bucket=20, block_shingles=3000, block_sets=9)).collect(), plain(rows))


def test_shared_counts_and_ownership():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    full = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    others = ~np.eye(9, dtype=bool)  # of a set with itself only shared tokens count
    assert (shared_counts(sets, 0, 7) == full)[others].all() and (shared_counts(sets, 4, 7) == full[:4, 4:]).all()
    alike = [sets[0]] * 3
    assert compare(alike, [np.array([5, 9])] * 3, 5, 0, 800).sum() == 3  # the least common bucket counts the pairs
    assert compare(alike, [np.array([5, 9])] * 3, 9, 0, 800).sum() == 0


def test_counting_takes_little_room():
    """A block's shingles are held few times over while they are counted, whatever they share."""
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 1 << 40, 20_000).astype(np.uint64)) for _ in range(25)] * 2
    tracemalloc.start()
    counts = shared_counts(sets, 25)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.diag(counts) == [len(x) for x in sets[:25]]).all()
    assert peak < 4.5 * sum(x.nbytes for x in sets)


def test_few_common_minhashes_rule_out_the_threshold():
    settings = PathSettings()
    m, k = settings.minhashes, settings.least_equal
    missed = sum(math.comb(m, j) * 0.8**j * 0.2 ** (m - j) for j in range(k))
    assert missed <= 1e-9 and m / 4 < k < m * 0.8  # sets of a quarter of the tokens in common hardly ever pass


def test_runs_follow_from_the_recall():
    assert PathSettings(recall=0.9).runs == 2 and PathSettings(recall=0.9999).runs == 6


def test_awkward_rows(spark, awkward, awkward_rows, nothing):
    same(near_duplicates(awkward).collect(), plain(awkward_rows))
    assert near_duplicates(nothing).count() == 0


def test_one_of_each(spark, make_docs, corpus, awkward, awkward_rows):
    kept = sorted(r["doc_id"] for r in one_of_each(make_docs(corpus)).collect())
    assert kept == sorted({r[1] for r in plain(corpus)})
    found = one_of_each(awkward)
    assert found.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in found.collect()) == [0, 0, 3, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    found = {r["node"]: r["label"] for r in connected_components(links).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(links.limit(0)).count() == 0
