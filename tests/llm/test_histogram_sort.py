"""Shards against borders found by sorting everything in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from corpus_rows import prose, row

from paceline.llm.histogram_sort import LEVELS, keyed, shard_documents, splitters, write_shards


def digest(value: str) -> int:
    return int(hashlib.md5(value.encode()).hexdigest()[:15], 16)


def plain_shards(rows: list[dict], shards: int, permille: int = 1) -> Counter:
    """(doc_id, size, crc, shard, slot) of all rows: sorted, borders at the nearest group if it is near, else at the nearest row."""
    sized = sorted((digest(r["text"] or ""), digest("" if r["doc_id"] is None else str(r["doc_id"])), k, len((r["text"] or "").encode()) + 16) for k, r in enumerate(rows))
    total, ends, groups = sum(x[3] for x in sized), [], {}
    for key, *_, size in sized:
        start = ends[-1] if ends else 0
        groups[key] = (groups.get(key, (start,))[0], start + size)
        ends.append(start + size)
    borders = []
    for i in range(1, shards):
        k = next(k for k, end in enumerate(ends) if i * total < end * shards)
        nearest = lambda start, end: start if i * total - start * shards <= end * shards - i * total else end  # noqa: E731, B023
        by_group, by_row = nearest(*groups[sized[k][0]]), nearest(ends[k] - sized[k][3], ends[k])
        borders.append(by_group if 1000 * abs(by_group * shards - i * total) <= permille * total else by_row)
    found, filled = Counter(), defaultdict(int)
    for (_, _, k, size), end in zip(sized, ends, strict=True):
        shard = sum(b <= end - size for b in borders)
        found[rows[k]["doc_id"], size, zlib.crc32((rows[k]["text"] or "").encode()), shard, filled[shard]] += 1
        filled[shard] += 1
    return found


def found_shards(docs, shards: int, **settings) -> Counter:
    got = shard_documents(docs, shards, ["doc_id"], **settings)
    return Counter(map(tuple, got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()))


def test_equal_to_sorting(make_docs):
    draw = random.Random(4)
    rows = [row(k, prose(k, draw.choice([3, 30, 300]))) for k in range(400)]
    assert found_shards(make_docs(rows, 5), 7) == plain_shards(rows, 7)


def test_few_probes(make_docs):
    """Many rounds of four probes each come to the same borders."""
    rows = [row(k, f"document {k} " * (k % 9)) for k in range(150)]
    assert found_shards(make_docs(rows, 3), 6, probes=4) == plain_shards(rows, 6)


@pytest.mark.parametrize("same_id", [False, True])
def test_a_large_group_is_cut(make_docs, same_id):
    """A third of all rows with one text, or even wholly equal: shards stay equal to a row."""
    rows = [row(7 if same_id else 10_000 + k, "one text " * 20) for k in range(300)] + [row(k, prose(k, 40)) for k in range(500)]
    found = found_shards(make_docs(rows, 4), 10)
    assert found == plain_shards(rows, 10)
    sizes = defaultdict(int)
    for (_, size, _, shard, _), n in found.items():
        sizes[shard] += n * size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(size for _, size, *_ in found)


def test_small_groups_stay_whole(make_docs):
    rows = [row(1000 * k + j, f"short text {k}") for k in range(3000) for j in range(k % 3)]
    where = defaultdict(set)
    for _, _, crc, shard, _ in found_shards(make_docs(rows), 4, tolerance_permille=5):
        where[crc].add(shard)
    assert all(len(x) == 1 for x in where.values())


def test_rounds_look_at_open_ranges_only(make_docs):
    docs = make_docs([row(k, f"text {k}") for k in range(50)])
    borders = splitters(keyed(docs, ["doc_id"]).select("size", *LEVELS), 5)
    assert borders == sorted(borders) and len(borders) == 4


def test_awkward(awkward, awkward_rows, nothing):
    assert found_shards(awkward, 3) == plain_shards(awkward_rows, 3)
    assert found_shards(awkward, 40) == plain_shards(awkward_rows, 40)
    assert found_shards(awkward, 1) == plain_shards(awkward_rows, 1)
    assert not found_shards(nothing, 4)
    got = shard_documents(awkward, 3)
    # The awkward columns shard, slot and size are passed on; the added ones stand beside them.
    assert got.columns == [*awkward.columns, "_size", "text_crc32", "_shard", "_slot"]
    assert sorted(map(str, got.select(*awkward.columns).collect())) == sorted(map(str, awkward.collect()))


def test_files(spark, make_docs, tmp_path):
    rows = [row(k, prose(k, 20)) for k in range(100)]
    write_shards(make_docs(rows), str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in back) == plain_shards(rows, 5)
    assert {r["text"] for r in back} == {r["text"] for r in rows}
