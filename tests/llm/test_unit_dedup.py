"""Repeated units against a plain dictionary of units."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from corpus_rows import prose, row
from pyspark.sql import functions as F

from paceline.llm import unit_dedup
from paceline.llm.unit_dedup import REACH, WINDOW, UnitCutter, repeated_units, unit_batches, without_units

SENTENCE_END = re.compile(r"[.!?]+(?=\s)|\n")
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
PIECES = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")


def lowered(text: str) -> str:
    return text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def text_units(text: str, min_words: int, line_words: int | None = None):
    """(start, end, words) of the units of a text, one after the other: sentences and lines, then the windows that are chosen."""
    low, line_words = lowered(text), min_words if line_words is None else line_words
    held, start, words, line, at = None, 0, [], True, 0
    for end in [*(m.end() for m in SENTENCE_END.finditer(text)), len(text)]:
        words += PIECES.findall(low, at, end)
        at = end
        if len(words) >= min_words:
            if held:
                yield held
            held, words, start, line = (start, end, words), [], end, False
        if end == len(text) or text[end - 1] == "\n":
            if held and words:
                held = (held[0], end, held[2] + words)
            if held:
                yield held
            elif line and words and len(words) >= line_words:
                yield start, end, words
            held, words, start, line = None, [], end, True
    found = list(PIECES.finditer(low))
    # Which windows are chosen follows their hashes alone.
    high, _, starts, _, n_words = UnitCutter(10**9).units(text)
    chosen = set(starts.tolist())
    for k in range(len(found) - WINDOW + 1):
        if found[k].start() in chosen:
            end = found[k + WINDOW].start() if k + WINDOW < len(found) else len(text)
            yield found[k].start(), end, ["\n", *(m[0] for m in found[k : k + WINDOW])]


PASSAGE = prose(500, 70)


def plain(rows, rank=lambda r: 0, least=unit_dedup.MIN_WORDS):
    """The earliest place of each unit, and the units elsewhere."""
    places = {}
    for r in rows:
        for start, end, words in text_units(r["text"] or "", least):
            low = lambda x: (x is not None, x or 0)
            places.setdefault(" ".join(words), set()).add((low(rank(r)), low(r["doc_id"]), start, end, len(words) - (words[0] == "\n")))
    found = set()
    for each in places.values():
        first = min(each)
        found |= {(p[1][1] if p[1][0] else None, p[2], p[3], p[4], first[1][1] if first[1][0] else None, first[2]) for p in each if p[:3] != first[:3]}
    return found


def test_units_cover_words_in_order():
    text = "Aa bb cc. Dd ee ff gg hh ii jj kk ll! X y.\nshort line\nOne two three four five six seven eight nine. ten.\n\nEnd"
    found = [(text[a:b], words) for a, b, words in text_units(text, 5)]
    assert [x for x, _ in found] == ["Aa bb cc. Dd ee ff gg hh ii jj kk ll! X y.\n", "One two three four five six seven eight nine. ten.\n"]
    assert all(words == re.findall(r"\w+", x.lower()) for x, words in found)


ODD = [
    "", "a", "one two.\nthree four five. six\n\nseven", "_x_ y1 é ß. İ I\u0307 Σας", "日本語テキスト。これ は x", "ไทย ภาษา", "word " * 60, "a.b c! d?e f. " * 20,
    prose(3, 200), prose(4, 150, "de"), "\n".join(f"line {k} of many" for k in range(30)), "x" * 5000 + " tail", "🙂 emoji 🙂 and\u0000nul \x1c sep",
]


@pytest.mark.parametrize("least, line", [(5, None), (16, None), (16, 1), (1, 1)])
@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_units_of_odd_texts(monkeypatch, least, line, piece):
    """The same spans as the plain way, and digests that are equal exactly where words are."""
    monkeypatch.setattr(unit_dedup, "PIECE", piece)
    cutter, by_digest, by_words = UnitCutter(least, line), {}, {}
    for text in ODD * 2:
        high, low, start, end, n = (x.tolist() for x in cutter.units(text))
        expected = list(text_units(text, least, line))
        assert sorted(zip(start, end, n, strict=True)) == sorted((a, b, len(w) - (w[0] == "\n")) for a, b, w in expected)
        windows = {a: w for a, _, w in expected if w[0] == "\n"}
        lines = {a: w for a, _, w in expected if w[0] != "\n"}
        for k in range(len(high)):
            words = tuple((windows if k >= len(lines) else lines)[start[k]])
            assert by_digest.setdefault((high[k], low[k]), words) == words and by_words.setdefault(words, (high[k], low[k])) == (high[k], low[k])
    assert len({h for h, _ in by_digest}) == len({x for _, x in by_digest}) == len(by_digest)


def test_one_of_any_neighbouring_windows_is_chosen():
    starts = UnitCutter(10**9).units(prose(8, 500))[2]
    every = [m.start() for m in PIECES.finditer(prose(8, 500).lower())][: 500 - WINDOW + 1]
    chosen = [every.index(x) for x in starts.tolist()]
    assert chosen[0] < REACH and len(every) - chosen[-1] <= REACH and max(b - a for a, b in zip(chosen, chosen[1:])) <= REACH


def test_short_lines_go_if_asked_for(spark, make_docs):
    docs = make_docs([row(k, prose(k, 60) + "\nAll rights reserved.\n" + prose(100 + k, 60)) for k in range(4)])
    assert repeated_units(docs).count() == 0
    assert {(r["doc_id"], r["n_words"]) for r in repeated_units(docs, line_words=1).collect()} == {(1, 3), (2, 3), (3, 3)}


@pytest.fixture(scope="module")
def corpus():
    rows = [row(k, prose(k, 100)) for k in range(20)]
    rows[3]["text"] += "\n" + PASSAGE
    rows[7]["text"] = PASSAGE + "\n" + rows[7]["text"]
    rows[11]["text"] = rows[11]["text"] + " and then " + PASSAGE.upper() + "\n" + PASSAGE
    rows[15]["text"] = rows[4]["text"]
    return rows


def test_equals_a_plain_grouping(spark, make_docs, corpus):
    docs = make_docs(corpus)
    found = {tuple(r) for r in repeated_units(docs).collect()}
    assert found == plain(corpus)
    assert {r[0] for r in found} == {7, 11, 15}
    by_rank = {tuple(r) for r in repeated_units(docs, rank=-F.col("doc_id")).collect()}
    assert by_rank == plain(corpus, lambda r: -r["doc_id"]) and {r[0] for r in by_rank} == {3, 4, 7, 11}


def test_removal_keeps_offsets(spark, make_docs, corpus):
    docs = make_docs(corpus)
    cleaned = {r["doc_id"]: r for r in without_units(docs, repeated_units(docs)).collect()}
    texts = {r["doc_id"]: r["text"] for r in corpus}
    for doc_id, r in cleaned.items():
        assert r["text"] == "".join(texts[doc_id][s["start"] : s["end"]] for s in r["kept_spans"])
    assert cleaned[4]["text"] == texts[4] and len(cleaned[15]["text"]) < 0.1 * len(texts[15])
    assert len(cleaned[7]["text"]) < len(texts[7]) - 0.9 * len(PASSAGE)


def test_awkward_rows(spark, awkward, awkward_rows, nothing):
    found = repeated_units(awkward)
    assert {tuple(r) for r in found.collect()} == plain(awkward_rows)
    cleaned = without_units(awkward, found)
    assert cleaned.columns == [*awkward.columns, "_kept_spans"] and cleaned.count() == len(awkward_rows)
    assert repeated_units(nothing).count() == 0 and without_units(nothing, repeated_units(nothing)).count() == 0


def test_lower_case_of_another_length(spark, make_docs):
    text = "İstanbul one two three four five six seven eight. " * 2
    assert {tuple(r)[:3] for r in repeated_units(make_docs([row(1, text)])).collect()} == {t[:3] for t in plain([row(1, text)])}


def test_repeated_windows_of_51_words_are_found_wherever_they_stand(spark, make_docs):
    """Against all windows of 51 words: what is repeated goes, but for a few words at the ends of a passage."""
    plain_words = lambda seed, n: [x.strip(".").lower() for x in prose(seed, n).split()]
    unmarked, short = plain_words(900, 80), [x.capitalize() + "." if k % 4 == 3 else x for k, x in enumerate(plain_words(901, 90))]
    rows = [row(k, " ".join([*plain_words(950 + k, 33 + k), *(unmarked if k % 2 else short), *plain_words(970 + k, 41 - k)])) for k in range(1, 7)]
    han = "".join(chr(0x4E00 + (k * k * 7 + 13 * k) % 5000) for k in range(90))
    rows += [row(20, f"{han}。"), row(21, f"他说{han[5:80]}吗")]
    gone = {}
    for r in repeated_units(make_docs(rows)).collect():
        gone.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    seen = set()
    for r in rows:
        found = [(m[0].lower(), m.start()) for m in re.finditer(r"[\u4e00-\u9fff]|[a-z]+", r["text"], re.I)]
        windows = [(tuple(w for w, _ in found[k : k + 51]), k) for k in range(len(found) - 50)]
        repeated = {k + j for w, k in windows if w in seen for j in range(51)}
        seen |= {w for w, _ in windows}
        gone_words = {k for k, (_, at) in enumerate(found) if at in gone.get(r["doc_id"], ())}
        missed = sorted(repeated - gone_words)
        assert len(missed) <= 14 and (not repeated or gone_words)
        assert gone_words <= {k + j for k in repeated for j in range(-7, 8)}
    assert set(gone) == {3, 4, 5, 6, 21}


def test_a_run_of_one_word_keeps_its_first_window(spark, make_docs):
    docs = make_docs([row(1, "ha " * 200)])
    left = without_units(docs, repeated_units(docs)).first()["text"]
    assert 24 <= len(left.split()) < 40


def test_units_come_in_small_batches():
    """Many short texts and one long one: what goes to Spark at a time stays small, and nothing is lost."""
    texts = [prose(k, 400) for k in range(300)] + [None, "", prose(7, 200_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts)), pa.array(range(len(texts))), pa.array(texts)], ["rank", "doc_id", "text"])
    found = list(unit_batches(iter([batch]), UnitCutter(16)))
    assert max(x.nbytes for x in found) <= unit_dedup.OUT_BYTES
    cutter = UnitCutter(16)
    counts = [len(cutter.units(text or "")[0]) for text in texts]
    assert [y for x in found for y in x["doc_id"].to_pylist()] == [k for k, n in enumerate(counts) for _ in range(n)]


def test_texts_cut_together_have_the_units_of_each(monkeypatch):
    """Neighbours that end or begin amid a sentence, a line, a run of white space or capitals share nothing."""
    texts = ["", prose(1, 300), PASSAGE, "", "\n", "A b c. D e f", "g h. İ ΑΣ", "ΑΣ " * 30, "x.", " y z!\n\n", "日本語。 文. 日本. " * 20, prose(2, 40) + ".", "w " * 60]
    cutter, calls, plain_hashes = UnitCutter(3, 1), [], unit_dedup.run_hashes
    monkeypatch.setattr(unit_dedup, "run_hashes", lambda *x: calls.append(1) or plain_hashes(*x))
    batch = pa.record_batch({"rank": pa.array([0] * len(texts), pa.int64()), "doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    found = [tuple(x.values()) for part in unit_batches(iter([batch]), cutter) for x in part.to_pylist()]
    assert len(calls) < len(texts)
    each = [(high, low, 0, k, *place) for k, text in enumerate(texts) for high, low, *place in zip(*(x.tolist() for x in cutter.units(text)), strict=True)]
    assert sorted(found) == sorted(each)
