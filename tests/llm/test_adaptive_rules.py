"""Counts against a plain count, sketches against exact quantiles, merging, and limits that differ by group."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus_rows import prose, row
from pyspark.sql import functions as F

from paceline.llm.adaptive_rules import RULES, apply_rules, deciles, leading_bits, limits, measure, repeated_words, sketches


def plain_counts(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


COUNTED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts(spark, make_docs, awkward, awkward_rows):
    extra = ["a b c a b c", "a a a a a", "x\ny\nx\n\n\ny z", "# * $ % &|<> é", "a\x1cb\x0bc\x85d", "one  two\tthree", "a b c d a b c e a b c"]
    rows = [*awkward_rows, *[row(100 + k, x) | {c: 0 for c in awkward_rows[0] if c not in row(1, "")} for k, x in enumerate(extra)]]
    found = measure(make_docs(rows)).select("doc_id", *COUNTED).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(((r["doc_id"], *plain_counts(r["text"])) for r in rows), key=key)


def test_repeated_words_with_a_large_vocabulary():
    draw = random.Random(4)
    ids = np.array([draw.randrange(6) for _ in range(200)])
    assert repeated_words(ids, 6) == repeated_words(ids * 1_000_000, 1 << 23) == plain_counts(" ".join(map(str, ids)))[4]


def test_sketch_quantiles_are_close_and_merge(spark):
    draw = random.Random(5)
    values = [(draw.choice("ab"), int(draw.expovariate(1 / 3000))) for _ in range(4000)]
    cells = spark.createDataFrame(values, "source string, v long").groupBy("source", leading_bits(F.col("v")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("rule", F.lit("r"))
    for keys, chosen in ((["rule", "source"], "a"), (["rule"], None)):
        found = deciles(cells, keys).filter(F.col("source") == chosen if chosen else F.lit(True)).first()
        own = sorted(v for s, v in values if chosen in (None, s))
        for name, tenths in (("low", 1), ("median", 5), ("high", 9)):
            exact = own[-(-tenths * len(own) // 10) - 1]
            assert exact * 63 / 64 - 1 <= found[name] <= exact
        assert found["size"] == len(own)


def test_limits_follow_the_group(spark, make_docs):
    """Pipes are normal in one source, noise in another."""
    tables = [row(k, " | ".join(f"cell{k:03}x{j:02}" for j in range(80)), "en", "tables") for k in range(130)]
    clean = [row(1000 + k, prose(1000 + k, 80), "en", "prose") for k in range(130)]
    odd = [row(5000, tables[0]["text"].replace("cell", "") + " more", "en", "prose"), row(5001, prose(5001, 20), "en", "prose"), row(5002, "spam spam spam " * 30, "en", "prose")]
    found = {r["doc_id"]: r for r in apply_rules(make_docs(tables + clean + odd)).collect()}
    assert all(found[r["doc_id"]]["kept"] for r in tables + clean)
    assert not found[5000]["kept"] and "symbols" in found[5000]["failed_rules"]
    assert found[5001]["base_failed"] and found[5002]["base_failed"] and not found[5002]["kept"]


@pytest.mark.parametrize("rule", RULES)
def test_limits_move_with_the_tail_of_their_group(spark, rule):
    """For every rule: what one group's upper half holds moves its limit, and no other group's."""
    counts = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    column = {"word_length": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words"}[rule]

    def found(tail: int) -> dict:
        rows = []
        for k in range(400):
            values = {"word_chars": 2500, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0}
            values[column] += (tail if k % 2 else 1) * (k % 20 > 11)
            rows.append((k, "en", "ab"[k % 2], 500, *values.values(), 100))
        learned = limits(sketches(spark.createDataFrame(rows, counts))).collect()
        return {r["source"]: r[f"{rule}_high"] for r in learned}

    small, large = found(1), found(60)
    assert small["a"] == large["a"] and large["b"] > small["b"]


def test_nothing_but_what_is_learned(spark, make_docs):
    """Documents that are all alike are kept, whatever they are like; those a little beyond what one more symbol makes are not."""
    rows = [row(k, prose(k, 80) + " #" * (k % 3), "en", "a") for k in range(150)] + [row(900, prose(900, 80) + "".join(f" #{j}x" for j in range(40)), "en", "a")]
    found = {r["doc_id"]: r for r in apply_rules(make_docs(rows)).collect()}
    assert found.pop(900)["failed_rules"] == ["symbols"] and all(r["kept"] for r in found.values())


def test_small_groups_take_the_limits_of_their_language(spark, make_docs):
    rows = [row(k, prose(k, 80), "en", f"s{k % 40}") for k in range(200)] + [row(900, " ## ".join(f"unit{j}" for j in range(80)), "en", "s1")]
    found = {r["doc_id"]: r["kept"] for r in apply_rules(make_docs(rows)).collect()}
    assert found.pop(900) is False and all(found.values())


def test_awkward_rows(spark, awkward, awkward_rows, nothing):
    found = apply_rules(awkward).collect()
    assert len(found) == len(awkward_rows)
    assert {r["doc_id"] for r in found if r["n_words"] == 0} == {7, 8, 9, 15, None}
    assert all(r["base_failed"] and not r["kept"] for r in found if r["n_words"] < 50)
    assert {r["doc_id"] for r in found if r["kept"]} >= {3, 5, 11, 12, 13, 18}
    assert apply_rules(nothing).count() == 0


def test_documents_that_fail_the_base_rules_teach_nothing(spark, make_docs):
    cells = sketches(measure(make_docs([row(1, "a b c"), row(2, prose(2, 60))])))
    assert {r["n"] for r in cells.collect()} == {1}
