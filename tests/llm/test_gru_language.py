"""The recurrent network: its gradient's effect, its predictions, its edges."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from corpus_rows import CLASHING, prose, row

from paceline.llm.gru_language import GruLabeller, GruSettings, identify_languages, label_positions, learn_languages, remainder, with_language

SMALL = GruSettings(hidden=6, window=32, docs_per_language=40, windows_per_doc=4, epochs=6, batch=32)


@pytest.fixture(scope="module")
def corpus():
    return [row(k, prose(k, 60, "en" if k % 3 else "de"), "en" if k % 3 else "de") for k in range(120)]


def test_training_follows_the_gradient():
    """One step against numerical slopes of the loss, for a few weights of each kind."""
    settings = GruSettings(hidden=3, window=6, seed=3)
    net = GruLabeller(["x", "y"], settings)
    for name in ("table", "recurrent", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    codes, labels = np.array([[1, 2, 3, 4, 5, 256], [5, 4, 3, 2, 1, 1]], np.int16), np.array([0, 1])

    def loss():
        chances = net.probabilities(net.states(codes))
        real = codes.T != 256
        return -(np.log(chances[:, np.arange(2), labels]) * real).sum() / real.sum()

    slopes = {}
    for name, at in (("recurrent", (0, 1, 2)), ("recurrent", (1, 0, 7)), ("table", (0, 3, 8)), ("table", (1, 2, 1)), ("out", (2, 1)), ("bias", (0,))):
        weights = getattr(net, name)
        old = weights[at]
        weights[at] = old + 1e-2
        high = loss()
        weights[at] = old - 1e-2
        low = loss()
        weights[at] = old
        slopes[name, at] = (high - low) / 2e-2
    before = {name: getattr(net, name).copy() for name, _ in slopes}
    object.__setattr__(settings, "epochs", 1)
    net.train(codes, labels)
    for (name, at), slope in slopes.items():
        if abs(slope) > 1e-3:  # Adam's first step goes against the slope
            assert np.sign(getattr(net, name)[at] - before[name][at]) == -np.sign(slope)


def test_held_out_accuracy(spark, make_docs, corpus):
    found = {r["doc_id"]: r for r in identify_languages(make_docs(corpus), SMALL).collect()}
    assert len(found) == len(corpus)
    held = [r for r in corpus if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in corpus)
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_labels_and_ids_are_no_inputs(spark, make_docs, corpus):
    """Held-out documents under other labels and sources change nothing."""
    other = [r | {"lang": "zz", "source": "q"} if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 else r for r in corpus]
    first, second = (sorted(map(tuple, identify_languages(make_docs(rows, files), SMALL).collect())) for rows, files in ((corpus, 2), (other, 5)))
    assert first == second


def test_positions_of_a_mixed_text(spark, make_docs, corpus):
    model = learn_languages(make_docs(corpus), remainder() != 1, SMALL)
    german, english = prose(900, 60, "de"), prose(901, 60, "en")
    (spans,) = [r["spans"] for r in label_positions(make_docs([row(1, german + " " + english)]), model).collect()]
    assert spans[0]["start"] == 0 and spans[-1]["end"] == len(german) + 1 + len(english)
    assert all(a["end"] == b["start"] and a["lang"] != b["lang"] for a, b in zip(spans, spans[1:]))
    right = sum(max(0, min(s["end"], len(german)) - s["start"]) for s in spans if s["lang"] == "de")
    assert right > 0.7 * len(german)


def test_awkward_rows(spark, make_docs, awkward, awkward_rows, corpus):
    model = learn_languages(make_docs(corpus), remainder() != 1, SMALL)
    found = identify_languages(awkward, SMALL).collect()
    assert len(found) == len(awkward_rows)
    und = sorted(r["doc_id"] or -1 for r in found if r["lang_pred"] == "und")
    assert und == [-1, 7, 8, 9, 10, 15] and all(r["score"] == 0 for r in found if r["lang_pred"] == "und")
    assert all(not r["held_out"] for r in found if r["doc_id"] is None)
    kept = with_language(awkward, model)
    assert kept.columns == awkward.columns and set(CLASHING) < set(kept.columns)
    assert kept.count() == len(awkward_rows) - 6


def test_nothing_to_learn_from(spark, nothing, make_docs):
    assert identify_languages(nothing, SMALL).count() == 0
    unlabelled = make_docs([row(1, "some words here", None), row(2, "more words", None)])
    assert {(r["lang_pred"], r["score"]) for r in identify_languages(unlabelled, SMALL).collect()} == {("und", 0.0)}
