from __future__ import annotations

import difflib
import random
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from paceline.functions.text import DIVISIONS, letter_counts, letter_keys, shared_bound
from paceline.operators import conform, similarity
from paceline.operators.conform import conformed_event_log, name_conformance, property_conformance
from workload import inputs
from workload.inputs import misspelt_words, word_dictionary
from workload.queries import queries

EVENTS = ["view", "click", "purchase", "signup", "file_uploaded"]


def feed(spark, names):
    return spark.createDataFrame([(n,) for n in names], "event string")


def test_vectors(spark):
    names = ["purchas", "clic", "CLICK", "click", "file_uploade", "click", "purchas", None]
    found = {r.from_name: (r.to_name, r.score) for r in name_conformance(feed(spark, names), EVENTS).collect()}
    assert found == {
        "purchas": ("purchase", 0.933),
        "clic": (None, 0.889),
        "CLICK": ("click", 1.0),
        "file_uploade": ("file_uploaded", 0.96),
    }


def test_scores_equal_a_full_search(spark):
    rng = random.Random(2)
    names = {"".join(rng.choice("clikpurhasevw_") for _ in range(rng.randrange(1, 12))) for _ in range(300)}
    names |= {e[:k] + c + e[k:] for e in EVENTS for k in range(len(e)) for c in "xE"}
    for row in name_conformance(feed(spark, sorted(names)), feed(spark, EVENTS)).collect():
        scores = [
            (difflib.SequenceMatcher(None, row.from_name.lower(), e.lower()).ratio(), e) for e in sorted(EVENTS)
        ]
        best = max(score for score, _ in scores)
        assert row.score == round(best, 3)
        assert row.to_name == (next(e for s, e in scores if s == best) if best >= 0.9 else None)


def test_empty_dictionary_resolves_nothing(spark):
    assert [tuple(r) for r in name_conformance(feed(spark, ["x"]), []).collect()] == [("x", None, 0.0)]


def plain_best(name: str, known) -> tuple[str | None, float]:
    """(match, score) over all known names; of equal scores the least name."""
    scores = [(-difflib.SequenceMatcher(None, name.lower(), k.lower()).ratio(), k) for k in known]
    less, match = min(scores)
    return (match if -less >= 0.9 else None), round(-less, 3)


def test_bounds_are_never_too_low():
    rng = random.Random(8)
    names = ["".join(rng.choice("abcdeXéßİ日 ") for _ in range(rng.randrange(9))) for _ in range(60)]
    lowered = [x.lower() for x in names]
    before = np.ones((60, 60))
    for classes in DIVISIONS:
        counts = letter_counts(lowered, classes)
        bound = np.array([shared_bound(counts, counts[k]) for k in range(60)])
        assert (bound <= before).all()  # a finer division bounds more tightly
        before = bound
    for i, j in product(range(60), repeat=2):
        assert difflib.SequenceMatcher(None, lowered[i], lowered[j]).ratio() <= before[i, j]


@pytest.mark.parametrize("step", [0.1, 0.9])
def test_a_large_dictionary(spark, monkeypatch, step):
    """Searched through the index, in rounds of any width: exact best matches, near and far."""
    monkeypatch.setattr(conform, "LIST_NAMES", 7)
    monkeypatch.setattr(similarity, "STEP", step)
    rng = random.Random(5)
    known = sorted({"".join(rng.choice("abcdeXé") for _ in range(rng.randrange(1, 14))) for _ in range(400)})
    names = sorted({"".join(rng.choice("abcdeXéz") for _ in range(rng.randrange(1, 16))) for _ in range(60)} | {k + "a" for k in known[::9]} | {""})
    rows = {r.from_name: (r.to_name, r.score) for r in name_conformance(feed(spark, names), feed(spark, known)).collect()}
    assert rows == {name: plain_best(name, known) for name in set(names) - set(known)}


def test_both_ways_agree(spark, monkeypatch):
    """The dictionary on every task, and searched through the index: the same rows."""
    rng = random.Random(6)
    known = ["".join(rng.choice("xyzw_") for _ in range(rng.randrange(0, 8))) for _ in range(150)] + ["A", "a", "Ärger", "ärger", "9" * 300]
    names = [k[1:] + "q" for k in known] + ["", "AA", "9" * 290, "ÄRGER", None]
    direct = sorted(map(tuple, name_conformance(feed(spark, names), feed(spark, known)).collect()))
    monkeypatch.setattr(conform, "LIST_NAMES", 0)
    assert sorted(map(tuple, name_conformance(feed(spark, names), feed(spark, known)).collect())) == direct


def test_a_search_meets_few_names(spark):
    """Names one letter off meet a small part of a dictionary of 3,000 names."""
    rng = random.Random(7)
    known = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(3000)})
    rows = [("", k[:4] + "#" + k[5:], -1.0) for k in known[::10]]
    index = similarity.signatures(spark.createDataFrame([("", k) for k in known], "kind string, known string"))
    names = spark.createDataFrame(rows, "kind string, name string, score double")
    pairs = similarity.candidates(names, index, similarity.tree(index), 0.8).collect()
    assert {(r["name"], r["known"]) for r in pairs} >= {(n, k) for (_, n, _), k in zip(rows, known[::10], strict=True)}
    assert len(pairs) < len(rows) * len(known) / 200


def test_keys_hold_the_letters_of_all_coarser_divisions(spark):
    """A node has few children, and its key gives its bound: no text has to stand for it."""
    names = ["", "Aß~z", "é日本7", "\x7f@?", "x" * 300]
    keys = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", letter_keys()("n").alias("keys")).orderBy("k").collect()
    for c, coarser in zip(DIVISIONS[1:], DIVISIONS, strict=False):
        assert c == 2 * coarser
        for d in DIVISIONS[: DIVISIONS.index(c) + 1]:
            assert (letter_counts([r["keys"][f"k{c}"] for r in keys], d) == letter_counts([n.lower() for n in names], d)).all()
    assert [r["keys"]["k1"] for r in keys] == [str(len(n)) for n in names]


def test_the_words_query_cuts_texts_once(spark, monkeypatch, tmp_path):
    for name in ("documents", "conversations", "benchmark"):
        pq.write_table(pa.table({"text": [f"some words of {name}"]}), tmp_path / f"{name}.parquet")
    tokens, cut = inputs._tokens, []
    monkeypatch.setattr(inputs, "_tokens", lambda table: cut.append(table) or tokens(table))
    found = queries()["name_conformance_words"](spark, str(tmp_path))
    assert len(cut) == 3 and "documents.parquet" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.from_name for r in found.collect()) == ["benchmark", "off", "somee", "wordss"]


def test_the_words_query(spark, monkeypatch, tmp_path):
    """The registered query on small tables, against all pairs of words."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 9))) for _ in range(250)]
    tables = {"documents": [" ".join(words[:150]) + "\nline", None], "conversations": [" ".join(words[100:180])], "benchmark": [" ".join(words[150:]) + " the, 7"]}
    for name, texts in tables.items():
        pq.write_table(pa.table({"text": pa.array(texts, pa.string())}), tmp_path / f"{name}.parquet")
    cut = lambda name: {w for t in tables[name] if t for w in re.split("[ \n]+", t) if w}
    known = cut("documents") | cut("conversations")
    assert {r[0] for r in word_dictionary(spark, str(tmp_path)).collect()} == known
    fed = {w + w[-1] if w in known else w for w in cut("benchmark")}
    assert {r[0] for r in misspelt_words(spark, str(tmp_path)).collect()} == fed
    monkeypatch.setattr(conform, "LIST_NAMES", 50)
    found = queries()["name_conformance_words"](spark, str(tmp_path)).collect()
    assert {r["from_name"]: (r["to_name"], r["score"]) for r in found} == {w: plain_best(w, known) for w in fed - known}


def test_short_dictionaries_cost_one_shuffle(spark):
    """A dictionary that every task can hold: nothing is joined."""
    plan = name_conformance(feed(spark, ["clik"]), feed(spark, EVENTS))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_log_is_corrected(make_log):
    log = make_log([(1, "purchas", 0), (1, "click", 1), (2, "mystery", 2), (3, "PURCHASE", 3)])
    fixed = conformed_event_log(log, EVENTS)
    assert fixed.columns == ["event", "user_id", "ts"]
    assert sorted((r.user_id, r.event) for r in fixed.collect()) == [
        (1, "click"), (1, "purchase"), (2, "mystery"), (3, "purchase"),
    ]


def test_property_pairs(spark):
    values = spark.createDataFrame(
        [("channel", v) for v in ("organic_search", "referral")] + [("device", v) for v in ("desktop", "mobile")],
        "property string, value string",
    )
    pairs = spark.createDataFrame(
        [("chanel", "referal"), ("device", "mobile"), ("device", "mobil"), ("device", "toaster"), ("shoe", "mobile"),
         ("chanel", "referral"), ("plan", "anything")],
        "property string, value string",
    )
    found = property_conformance(pairs, ["channel", "device", "plan"], values)
    assert {tuple(r) for r in found.collect()} == {
        ("chanel", "referal", "channel", "referral", 0.923, 0.933),
        ("chanel", "referral", "channel", "referral", 0.923, None),
        ("device", "mobil", "device", "mobile", None, 0.909),
        ("device", "toaster", "device", None, None, 0.308),
        ("shoe", "mobile", None, "mobile", 0.364, None),
    }
