"""The mix against a plain earliest-deadline-first schedule, and its promise: less than one block of deviation."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from corpus_rows import CLASHING, row
from pyspark.sql import functions as F

from paceline.llm.pfair_mix import earliest_deadline_first, interleave, schedule


def plain_cycle(parts: list[int]) -> list[int]:
    q, done, order = sum(parts), [0] * len(parts), []
    for t in range(q):
        ready = [(-(-(done[k] + 1) * q // p), k) for k, p in enumerate(parts) if done[k] < p and done[k] * q // p <= t]
        order.append(min(ready)[1])
        done[order[-1]] += 1
    return order


CYCLES = [[1], [1, 1], [5, 1], [3, 2, 7], [1, 1, 1, 1, 20], [13, 8, 5, 3, 2, 1], [50, 49, 1]]


def test_cycles(spark):
    for parts in CYCLES:
        found = spark.range(1).select(earliest_deadline_first(F.lit(parts).cast("array<long>")).alias("o")).first()["o"]
        assert found == plain_cycle(parts)
        for t in range(1, len(found) + 1):
            taken = Counter(found[:t])
            assert all(abs(taken[k] - Fraction(t * p, sum(parts))) < 1 for k, p in enumerate(parts))


def test_kinds_are_scheduled_after_they_are_dealt_out(spark):
    """The schedule is computed once, above the exchange."""
    sources = spark.createDataFrame([("a", 23, 5), ("b", 4, 3)], "source string, blocks long, parts long")
    plan = schedule(sources)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "sequence(" in above and "sequence(" not in below


def test_schedule_of_all_kinds(spark):
    """Blocks of sources that run out at different times fill all slots once, in order, each phase fairly."""
    listed = [("a", 23, 5), ("b", 4, 3), ("c", 9, 1), (None, 1, 2)]
    sources = spark.createDataFrame(listed, "source string, blocks long, parts long")
    plan = {(r["source"], r["kind"], r["nth"]): r for r in schedule(sources).collect()}
    kinds = sorted({k for _, k, _ in plan})
    slots = {}
    for source, blocks, parts in listed:
        for block in range(blocks):
            kind = max(k for k in kinds if k <= block // parts)
            r = plan[source, kind, block % parts]
            slots[r["slot"] + (block // parts - kind) * r["slots"]] = (source, block)
    assert sorted(slots) == list(range(sum(n for _, n, _ in listed)))
    for source, blocks, _ in listed:
        assert [b for t, (s, b) in sorted(slots.items()) if s == source] == list(range(blocks))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(2)
    return [row(k, "x" * draw.randint(0, 400), "en", draw.choice(["big"] * 6 + ["mid", "mid", "small"])) for k in range(600)]


def test_deviation_is_below_one_block(spark, make_docs, corpus):
    parts = {"big": 3, "mid": 4, "small": 1}
    rows = interleave(make_docs(corpus), parts, block_chars=1000).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(600))
    order = {r["slot"]: r["source"] for r in rows}
    blocks = {s: -(-sum(r["n_chars"] for r in rows if r["source"] == s) // 1000) for s in parts}
    full = min(n // parts[s] for s, n in blocks.items()) * sum(parts.values())  # while every source lasts
    taken = Counter()
    for t in range(full):
        taken[order[t]] += 1
        assert all(abs(taken[s] - Fraction((t + 1) * p, 8)) < 1 for s, p in parts.items())
    assert max(order) < sum(blocks.values())
    for r in rows:  # a block holds its characters, but for the end of its last document
        assert r["block_offset"] < 1000 or r["block_no"] == blocks[r["source"]] - 1


def test_order_does_not_depend_on_partitions(spark, make_docs, corpus):
    one, two = (sorted((r["slot"], r["block_offset"], r["doc_id"]) for r in interleave(make_docs(corpus, k), block_chars=500, digits=d).collect()) for k, d in ((1, 1), (5, 3)))
    assert one == two


def test_only_dataframe_operations(spark, make_docs, corpus):
    assert not re.search("Python|Pandas|Arrow", interleave(make_docs(corpus))._jdf.queryExecution().toString())


def test_awkward_rows(spark, awkward, awkward_rows, nothing):
    found = interleave(awkward, block_chars=300)
    assert set(CLASHING) < set(found.columns) and {"_slot", "_block_no", "block_offset"} <= set(found.columns)
    rows = found.collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), str(r["source"]), r["slot"])
    assert sorted(map(key, rows)) == sorted(key(r | {"slot": r["slot"]}) for r in awkward_rows)
    assert interleave(nothing).count() == 0
    blank = awkward.filter("text is null or text = ''")
    assert interleave(blank).count() == blank.count()
