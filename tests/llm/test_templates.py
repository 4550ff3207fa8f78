"""Templates: literal and re-parameterised leaks are found, other documents are not; and all windows of all pairs, one by one."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_rows import prose, row

from paceline.llm.templates import LINES, MAYBE, NAME, Reading, TemplateWords, leaks, template, template_matches, without_leaks

QUESTION = (
    "At noon Alice Smith buys 12 apples for 3 dollars each and gives 5 apples to her brother Tom. How many apples does Alice Smith still have"
    " at the end of the day, and how much money did she spend in total on them?"
)
CHANGED = (
    "At noon Zoe buys 40 apples for 2 euros each and gives 7 apples to her brother Max. How many apples does Zoe still have"
    " at the end of the day, and how much money did she spend in total on them?"
)
MIXED_UP = CHANGED.replace("does Zoe still", "does Max still")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, QUESTION), (2, prose(77, 25)), (3, None), (4, ""), (5, "Too short."), (9, QUESTION)], "item_id long, text string")


def test_slots_are_typed():
    words = TemplateWords()
    one, two = template(QUESTION, words), template(CHANGED, words)
    assert one[0].tolist() == two[0].tolist()
    assert sum(one[1] > 0) == sum(two[1] > 0) == 7  # Alice, 12, 3, dollars, 5, Tom, Alice


def test_literal_and_changed_questions(spark, make_docs, items):
    docs = make_docs(
        [
            row(1, f"{prose(1, 50)}\n{QUESTION}\n{prose(2, 50)}"), row(2, f"{prose(3, 50)}\n{CHANGED}\n{prose(4, 50)}"), row(3, prose(5, 200)),
            row(4, f"{prose(6, 30)} {prose(77, 25)} {prose(7, 30)}"), row(5, prose(8, 40) + " apples and her brother Tom"),
        ]
    )
    found = {(r["doc_id"], r["item_id"]): r for r in leaks(docs, items).collect()}
    assert set(found) == {(1, 1), (2, 1), (4, 2)}
    assert found[1, 1]["coverage"] == 1 and found[1, 1]["n_changed"] == 0
    assert found[2, 1]["coverage"] == 1 and found[2, 1]["n_changed"] == 6
    assert sorted(r["doc_id"] for r in without_leaks(docs, items).collect()) == [3, 5]


def test_slots_must_be_filled_consistently(spark, make_docs, items):
    docs = make_docs([row(1, MIXED_UP), row(2, CHANGED)])
    assert [r["doc_id"] for r in template_matches(docs, items).collect()] == [2]


def test_awkward_rows(spark, awkward, awkward_rows, items, nothing):
    assert template_matches(awkward, items).count() == 0
    kept = without_leaks(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == len(awkward_rows)
    assert leaks(nothing, items).count() == 0 and leaks(awkward, items.limit(0)).count() == 0


def test_repeated_documents_and_null_ids(spark, make_docs, items):
    docs = make_docs([row(4, QUESTION), row(4, QUESTION), row(None, QUESTION), row(6, None), row(7, "word. " * 30_000 + QUESTION)])
    assert sorted((r["doc_id"] or 0, r["item_id"], r["coverage"]) for r in leaks(docs, items).collect()) == [(0, 1, 1.0), (4, 1, 1.0), (7, 1, 1.0)]
    assert [r["doc_id"] for r in without_leaks(docs, items).collect()] == [6]



def test_items_full_of_numbers_are_found_as_literal_copies(spark, make_docs):
    texts = ["Find the mean of 3, 5, 7, 9, 11, 13 and 20.", "What is 12 + 7 * 3 - 4 ?", "Which is prime: 4, 6, 8, 9, 10, 12, 14, 15, 16, 17, 18, 20 or 21?"]
    numeric = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = make_docs([row(k, f"{prose(k, 40)}\n{x}\n{prose(50 + k, 40)}") for k, x in enumerate(texts)] + [row(9, f"{prose(9, 40)}\n{texts[0].replace('9', '8')}"), row(10, "What is 12 + 8 * 3 - 4 ?")])
    found = {(r["doc_id"], r["item_id"]): r["coverage"] for r in leaks(docs, numeric).collect()}
    assert found == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0}


def test_names_that_start_sentences_may_change(spark, make_docs):
    item = "Tom has 3 red apples. Tom buys 4 more red apples at the market. Ann gives Tom 2 of her own green apples. Tom eats 1 of them. How many apples are left?"
    changed = item.replace("Tom", "Max").replace("Ann", "Eve").replace("3", "8")
    other = item.replace("Tom", "Mary Jones", 1)
    questions = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make_docs([row(1, f"{prose(1, 40)}\n{item}"), row(2, f"{prose(2, 40)}\n{changed}\n{prose(3, 40)}"), row(3, prose(4, 100)), row(4, f"the task\n{changed}")])
    found = {r["doc_id"]: r["coverage"] for r in leaks(docs, questions).collect()}
    assert set(found) == {1, 2, 4} and found[1] == 1 and min(found[2], found[4]) > 0.8, found
    assert {r["doc_id"] for r in leaks(make_docs([row(5, other)]), questions).collect()} == {5}


def test_one_contradiction_costs_its_windows_alone(spark, make_docs):
    start = "On a farm with 2 barns there are many hens and Ann counts 2 baskets of eggs each day before she walks to the village"
    item = f"{start}. There she sells most of the eggs to a baker, who gives her bread and some butter for the week, and how much is left for the family?"
    texts = [item.replace("2 baskets", "3 baskets"), item.replace("2 barns", "5 barns").replace("2 baskets", "7 baskets")]
    questions = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: r["coverage"] for r in leaks(make_docs([row(k, x) for k, x in enumerate(texts)]), questions).collect()}
    assert set(found) == {0, 1} and all(0.6 < x < 1 for x in found.values())


def found_ids(spark, make_docs, item: str, *texts: str) -> list[float]:
    """The coverage of one item in each text, 0 if it is not reported."""
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: r["coverage"] for r in leaks(make_docs([row(k, x) for k, x in enumerate(texts)]), items).collect()}
    return [found.get(k, 0) for k in range(len(texts))]


def test_numbers_with_units_glued_on(spark, make_docs):
    item = "A runner covers the first 5km of the race in 20min and then the other 8km in just 30min, so how fast was she on average?"
    changed = item.replace("5km", "7km").replace("20min", "25min").replace("8km", "9km").replace("30min", "twenty-five")
    other = item.replace("20min", "time").replace("30min", "some").replace("5km", "part").replace("8km", "part")
    assert found_ids(spark, make_docs, item, item, changed)[:2] == [1, 1]
    assert found_ids(spark, make_docs, item, other)[0] < 1


def test_signs_beside_numbers_are_words(spark, make_docs):
    item = "What is 12 + 7 * 3?"
    assert found_ids(spark, make_docs, item, f"{prose(1, 30)}\n{item}\n{prose(2, 30)}", "What is 12 7 3 about?", "What is 12 * 7 + 3?") == [1, 0, 0]


def test_scripts_without_spaces(spark, make_docs):
    item = "東京から大阪まで電車で何時間かかりますか教えて"
    assert found_ids(spark, make_docs, item, f"これは文です。{item}。次の文。", "東京は大きい町です。大阪も大きい町です。") == [1, 0]
    changed = "太郎は3個のりんごと5個のみかんを買いました。全部で何個ですか。"
    assert found_ids(spark, make_docs, changed, changed.replace("3", "7").replace("5", "12")) == [1]


def test_items_of_a_few_words_match_whole_lines(spark, make_docs):
    item = "Name the capital."
    assert found_ids(spark, make_docs, item, f"{prose(1, 20)}\nName the capital\n{prose(2, 20)}", "Do name the capital.", "name the capitals", "x\n  NAME THE CAPITAL?") == [1, 0, 0, 1]


def test_languages_that_capitalise_nouns(spark, make_docs):
    item = "Ein Zug fährt um 8 Uhr vom Bahnhof in Hamburg ab und kommt nach 3 Stunden in Berlin an, während das Auto für die Strecke 4 Stunden braucht."
    changed = item.replace("Hamburg", "München").replace("Berlin", "Köln").replace("8 ", "9 ").replace("3 Stunden", "5 Stunden").replace("4 Stunden", "6 Stunden")
    other = "Ein Mann geht um 8 Uhr vom Haus in die Stadt ab und kauft nach 3 Stunden im Laden ein, während die Frau für die Kinder 4 Kuchen macht."
    found = found_ids(spark, make_docs, item, item, changed, other)
    assert found[0] == 1 and found[1] > 0.8 and found[2] == 0


def test_many_items_of_one_template(spark, make_docs):
    """Rows grow with items and documents, not with their product; each document is reported once, with the class."""
    text = "At noon {a} buys {n} apples for {m} dollars each and gives some of them to her brother. How many apples does {a} still have at the end of the day?"
    names = [f"{x}{y}a" for x in "BCDFG" for y in "aeiou"]
    filled = lambda k: text.format(a=names[k % 25], n=k + 2, m=k % 7 + 2)
    items = spark.createDataFrame([(k + 10, filled(k)) for k in range(60)], "item_id long, text string")
    docs = make_docs([row(k, f"{prose(k, 20)}\n{filled(k + 100)}") for k in range(40)])
    found = leaks(docs, items).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(40))
    assert {(r["item_id"], r["n_items"]) for r in found} == {(10, 60)} and min(r["coverage"] for r in found) > 0.8


def plain_matches(docs: list[tuple], items: list[tuple], window: int = 8, literals: int = 5) -> dict:
    """(doc_id, class) -> (matched, n_windows), from every window of every text against every window of every item."""
    words, classes = TemplateWords(), defaultdict(list)

    def windows(reading, sizes):
        found = set()
        for size in sizes:
            for exact, (at, places, hashes, slots) in enumerate(reading.windows(size, literals)):
                for p, place, value in zip(at.tolist(), places.tolist(), hashes.tolist(), strict=True):
                    filled = tuple(int(x) for x in slots[p : p + size] if x) if exact != 1 else ()
                    found.add((place, size, value, filled, exact == 1))
        return found

    for item_id, text in sorted(items):
        reading = Reading(text, words)
        sizes = {x if x >= literals else LINES for x in (min(window, len(reading)), min(window, len(reading.found))) if x}
        key = (tuple(reading.found.tolist()), tuple(reading.open_found.tolist()))
        classes[key].append((item_id, windows(reading, sizes)))
    result = {}
    for members in classes.values():
        wanted = {w for w in members[0][1]} | {w for _, all_of in members for w in all_of if w[4]}
        n_all, n_typed = len({w[0] for w in wanted}), len({w[0] for w in wanted if not w[4]})
        for doc_id, text in docs:
            diagonals = defaultdict(set)
            for pos, size, value, slots, exact in windows(Reading(text, words), {w[1] for w in wanted}):
                for item_pos, item_size, item_value, item_slots, item_exact in wanted:
                    if (size, value) == (item_size, item_value):
                        pairs = tuple((a & ~0xFFFF, b & ~0xFFFF, a & 3) for a, b in zip(item_slots, slots, strict=False)) if not item_exact else ()
                        diagonals[pos - item_pos].add((item_pos, pos, size, item_exact, pairs))
            at, typed_at = set(), set()
            for held in diagonals.values():
                filled = [p for w in held for p in w[4]]
                names = defaultdict(set)
                for of, by, kind in filled:
                    if kind == int(NAME):
                        names[of].add(by)
                if any(len(by) > 1 and of not in by and any(by & other for o, other in names.items() if o != of) for of, by in names.items()):
                    continue
                counts = Counter((of, by) for of, by, _ in filled)
                best = {}
                for (of, by), n in counts.items():
                    best[of] = max(best.get(of, (0, False, 0)), (n, by == of, by if by < 1 << 63 else by - (1 << 64)))
                kept = [w for w in held if all(best[of][2] == (by if by < 1 << 63 else by - (1 << 64)) for of, by, _ in w[4])]
                at |= {w[0] for w in kept}
                typed_at |= {w[0] for w in kept if not w[3]}
            if at:
                share = lambda m, n: (m / n if n else 0.0, m, n)
                _, matched, n = max(share(len(at), n_all), share(len(typed_at), n_typed))
                result[doc_id, members[0][0]] = (matched, n)
    return result


def test_against_all_pairs(spark, make_docs):
    """Random texts of few words, with values replaced here and there; every match and its windows, none more."""
    draw = random.Random(11)

    def text(n: int) -> str:
        kinds = [lambda: draw.choice("the of and red apples house with goes".split()), lambda: str(draw.randrange(30)), lambda: draw.choice(["Tom", "Ann", "Max Miller"]), lambda: draw.choice(["km", "5km", "+", "days."])]
        return " ".join(kinds[draw.choice([0, 0, 0, 0, 0, 1, 2, 3])]() for _ in range(n))

    def changed(x: str) -> str:
        return " ".join(str(draw.randrange(30)) if w.isdigit() and draw.random() < 0.5 else draw.choice(["Tom", "Eve"]) if w == "Tom" else w for w in x.split(" "))

    items = [(k, text(draw.choice([3, 7, 12, 25]))) for k in range(40)]
    docs = [(k, " ".join([text(15), changed(draw.choice(items)[1]), text(15), changed(draw.choice(items)[1])])) for k in range(60)]
    docs += [(100 + k, f"{text(10)}\n{x}\n{text(10)}") for k, x in items]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["n_windows"]) for r in template_matches(make_docs([row(*x) for x in docs]), frame).collect()}
    assert got == plain_matches(docs, items) and len(got) > 80


def test_a_known_word_is_hashed_once(monkeypatch):
    """A full stop or a comma after a known word costs no second normal form; the marks are those of the word met alone."""
    from paceline.llm import templates as T

    words, calls, digest = T.TemplateWords(), [], T.xxhash.xxh3_64_intdigest
    listed = ["Berlin", "three", "km", "house"]
    apart = {x + end: T.TemplateWords()[x + end] for x in listed for end in ("", ".", ",")}
    monkeypatch.setattr(T.xxhash, "xxh3_64_intdigest", lambda x: calls.append(x) or digest(x))
    assert {x + end: words[x + end] for x in listed for end in ("", ".", ",")} == apart
    assert len(calls) == len(listed)


def test_texts_read_together_have_the_windows_of_each():
    """Numbers, names, signs and sentences at the end of a text do not reach into the next."""
    from paceline.llm import templates as T

    texts = ["", "Anna saw 5", "km + 3 at the house of the river bank in town", "", "— Berlin and the house of the river bank in town Paris", "— Oslo = 4", "+ 5 a b c d e f g h", "One."] * 3
    words, passes = TemplateWords(), np.ones(1 << T.FILTER_BITS, bool)
    for size in (5, 8):
        found = list(T._listed(Reading(texts, words).parts(size, 5), size, passes))
        each = [(k, *rest) for k, text in enumerate(texts) for _, *rest in T._listed(Reading(text, words).parts(size, 5), size, passes)]
        assert sorted(found) == sorted(each) and found
