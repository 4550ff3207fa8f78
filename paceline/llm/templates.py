"""Benchmark decontamination by templates: finds benchmark items in documents even with other numbers, names or units.

A text becomes a sequence of template words: numbers (also with a unit glued on), names (capitalised words inside a sentence; neighbours are
one name) and units (after a number) turn into typed slots, other words are lower-cased and stripped of punctuation; signs beside a number are
words (but no literals), and so is each letter of a script written without spaces. Windows of ``window`` template words, at least ``literals`` of them not slots,
are hashed; those with fewer are hashed with the values of their slots, so they only match as they stand. Items of fewer than ``literals``
words match lines that hold just their words, with equal values. Equal hashes of a document and an item are joined.

A capitalised word that starts a sentence may be a name or not, and so may any in a sentence of which a fifth is capitalised (as nouns are
in German): windows that hold one are hashed both ways. Places are counted as if it were a name, in documents and items alike.
Items of one template are one class, reported by its least id with the number of its items: their windows that match with any values are joined
once, however many items there are; those that match as they stand belong to the class too, with the values of each item.

Matches of one document and class that lie on one diagonal fill the slots: a window counts only if every
value of its slots is replaced by what replaces it most often on the diagonal, and none does if names change places. An item leaks into a
document if consistent matches cover at least ``coverage`` of its windows, or of those that are not exact.

Defined cases: null and empty texts match nothing, nor do items without a word; items of equal text are
reported by their least id; an item shorter than a window is one window; repeated documents with one id count
once; a null ``doc_id`` is matched like any other; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import batches_of, given_back, mixed, window_hashes
from paceline.session import materialise

# Words that are numbers, and units that may follow a number, in English, German, French and Spanish.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    " twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half"
    " null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn zwanzig dreißig vierzig fünfzig hundert tausend"
    " deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille"
    " dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta cien mil".split()
)
UNIT_WORDS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec secs min mins h hr hrs inch inches foot feet yard yards mile miles meter meters"
    " metre metres kilometer kilometers kilometre kilometres centimeter centimeters gram grams kilogram kilograms pound pounds ounce ounces"
    " ton tons liter liters litre litres gallon gallons cup cups second seconds minute minutes hour hours day days week weeks month months"
    " year years dollar dollars cent cents euro euros percent degree degrees kmh mph km/h m/s"
    " stunde stunden minuten sekunde sekunden tag tage tagen woche wochen monat monate jahr jahre jahren gramm kilogramm tonnen prozent grad"
    " heure heures secondes jour jours semaine semaines mois an ans année années mètre mètres kilomètres grammes"
    " hora horas minutos segundos día días semana semanas mes meses año años metro metros kilómetros gramos litros".split()
)
NUMBER, GLUED = re.compile(r"[+-]?\d[\d.,:/]*%?"), re.compile(r"[+-]?\d[\d.,:/]*([^\W\d_]+(?:/[a-z])?)")
SIGN = re.compile(r"[+*/=<>^×÷±−≤≥-]+")
# Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
HAS_UNSPACED, PIECES = re.compile(f"[{UNSPACED}]"), re.compile(f"[{UNSPACED}]|[^{UNSPACED}]+")
SENTENCE_MARK = re.compile(r"[.!?:。！？][\"')\]]*$")
EDGES = re.compile(r"^[^\w%]+|[^\w%]+$")
#: A sentence with this share of capitalised words is in a language that capitalises nouns, or a title.
MANY_CAPITALS = 0.2
HASH = np.uint64(0xFFFF ^ (1 << 64) - 1)  # the bits of a packed word or a slot's value without its marks
CAPITAL, NUMERIC, UNIT, SENTENCE_END, NOTHING, SIGNS = 1, 2, 4, 8, 16, 32
SLOT_NUMBER, SLOT_NAME, SLOT_UNIT = (np.uint64(x << 8) for x in (1, 2, 3))
# The lowest bits of a slot's value: what it surely is, or a word that may be a name as it starts a sentence.
OTHER, NAME, MAYBE = (np.uint64(x) for x in (1, 2, 3))
FILTER_BITS = 22
PAIRS = "array<struct<item_slots: bigint, slots: bigint>>"
# Stands between texts that are read together: no text holds it as a word.
PART = "\n"
# Bytes of texts that are read together.
TOGETHER = 1 << 18
# Stands for the size of windows that are whole lines.
LINES = 0


class TemplateWords(dict):
    """Word as it stands -> 56 hash bits of its normal form and eight bits of marks."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        if word == PART:
            found = self[word] = SENTENCE_END | NOTHING
            return found
        marks, core = 0, word
        if not word.isalpha():
            if word[-1] in ".,;" and word[:-1].isalpha():  # most other words, without regular expressions
                marks, core = SENTENCE_END if word[-1] == "." else 0, word[:-1]
                if core in self:
                    found = self[word] = self[core] | marks
                    return found
            else:
                marks, core = SENTENCE_END if SENTENCE_MARK.search(word) else 0, EDGES.sub("", word)
        form = core.lower()
        if not form:
            marks |= SIGNS if SIGN.fullmatch(word) else NOTHING
            form = word
        elif form in NUMBER_WORDS or not form.isalpha() and self.is_number(form):
            marks |= NUMERIC
        elif core[0].isupper() and not any(map(str.isupper, core[1:])):
            marks |= CAPITAL
        if form in UNIT_WORDS or form == "%":
            marks |= UNIT
        found = self[word] = (xxhash.xxh3_64_intdigest(form.encode()) >> 16 << 16) | marks
        return found

    @staticmethod
    def is_number(form: str) -> bool:
        if form in NUMBER_WORDS:
            return True
        if form.isalpha():
            return False
        glued = GLUED.fullmatch(form)
        return NUMBER.fullmatch(form) is not None or all(x in NUMBER_WORDS for x in form.split("-")) or glued is not None and glued[1] in UNIT_WORDS


def cut_words(text: str) -> list[str]:
    cut = text.split()
    if HAS_UNSPACED.search(text):
        cut = [y for x in cut for y in PIECES.findall(x)]
    return cut


def _looked_up(cut: list[str], words: TemplateWords, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed words, marks, whether a capital may be no name, number of the text) of the words that hold more than punctuation, and of
    signs beside numbers; ``of``: the number of the text of each word, if there are several, parted by ``PART``."""
    packed = np.fromiter(map(words.__getitem__, cut), np.uint64, len(cut))
    marks = packed.astype(np.uint8)
    starts = np.concatenate([[True], marks[:-1] & SENTENCE_END > 0])[: len(marks)]
    number = np.concatenate([[False], marks & NUMERIC > 0, [False]])
    keep = (marks & NOTHING == 0) & ((marks & SIGNS == 0) | number[:-2] | number[2:])
    sentence = np.cumsum(starts)[keep]
    packed, marks, starts = packed[keep], marks[keep], starts[keep]
    of = np.zeros(len(packed), np.int64) if of is None else of[keep]
    inside = ~starts
    capitals, all_words = (np.bincount(sentence[x], minlength=int(sentence[-1]) + 1 if len(sentence) else 1) for x in (inside & (marks & CAPITAL > 0), inside))
    return packed, marks, starts | ((capitals > 1) & (capitals >= MANY_CAPITALS * all_words))[sentence], of


def _slotted(packed: np.ndarray, marks: np.ndarray, starts: np.ndarray, of: np.ndarray, open_names: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template words, slot values, place of the first word of each); ``open_names``: sentences may start with names."""
    number = marks & NUMERIC > 0
    goes_on = np.concatenate([[False], of[1:] == of[:-1]])[: len(of)]  # a word of the same text stands before
    unit = (marks & UNIT > 0) & ~number & goes_on & np.concatenate([[False], number[:-1]])[: len(number)]
    name = (marks & CAPITAL > 0) & ~unit
    maybe = name & starts
    if not open_names:
        name = name & ~starts
    value = packed & HASH
    found = value | np.uint64(1 << 15)  # no word is a slot
    found[number], found[unit], found[name] = SLOT_NUMBER, SLOT_UNIT, SLOT_NAME
    slots = np.where(number | unit | name, value, np.uint64(0))
    kinds = np.where(name, np.where(maybe, MAYBE, NAME), np.where(slots > 0, OTHER, np.uint64(0)))
    first = np.arange(len(found))
    if name.any():
        runs = name & ~maybe & goes_on & np.concatenate([[False], name[:-1]])  # goes on a name
        if runs.any():
            first = np.flatnonzero(~runs)
            order = (np.arange(len(slots)) - np.maximum.accumulate(np.where(runs, 0, np.arange(len(slots))))).astype(np.uint64)
            found, slots, kinds = found[first], np.add.reduceat(slots * (np.uint64(2) * order + np.uint64(1)), first), kinds[first]
    return found, slots | kinds, first


def template(text: str, words: TemplateWords) -> tuple[np.ndarray, np.ndarray]:
    """(template words, slot values) with words that start sentences as they stand; the value of what is no slot is 0."""
    return _slotted(*_looked_up(cut_words(text), words), False)[:2]


def _hashes_at(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows that start at some places; never those of ``window_hashes``."""
    if not len(at):
        return np.zeros(0, np.uint64)
    total = np.full(len(at), 0xD6E8FEB86659FD93, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[at + k]
    return mixed(total + np.uint64(size))


class Reading:
    """The windows of a text, or of several texts, in both readings of the words that may be names."""

    def __init__(self, text: str | list[str], words: TemplateWords):
        self.text, self.words = text, words
        if isinstance(text, str):
            looked_up = _looked_up(cut_words(text), words)
        else:
            cuts = [[*cut_words(x), PART] for x in text]
            looked_up = _looked_up(list(chain.from_iterable(cuts)), words, np.repeat(np.arange(len(cuts)), [len(x) for x in cuts]))
        self.found, self.slots, first = _slotted(*looked_up, False)
        self.open_found, self.open_slots, self.open_first = _slotted(*looked_up, True)
        signs = looked_up[1] & SIGNS > 0
        self.plain, self.open_plain = (self.slots == 0) & ~signs[first], ~signs[self.open_first]  # no sign is a literal
        # Of every template word, the number of its text, and its place there.
        self.of, self.open_of = looked_up[3][first], looked_up[3][self.open_first]
        self.open_place = np.arange(len(self.open_of)) - np.searchsorted(self.open_of, self.open_of)
        self.place = self.open_place[np.searchsorted(self.open_first, first, "right") - 1]
        self.exact = np.where(self.slots > 0, self.slots & HASH, self.found)

    def __len__(self) -> int:
        return len(self.open_found)

    def lines(self, literals: int) -> list[tuple[np.ndarray, ...]]:
        """Lines of fewer than ``literals`` words, hashed as they stand; parts as of ``parts``, all of them exact."""
        places, hashes, before = [], [], 0
        for line in self.text.split("\n"):
            packed, _, _, _ = _looked_up(cut_words(line), self.words)
            if 0 < len(packed) < literals:
                places.append(min(int(np.searchsorted(self.open_first, before, "right")) - 1, len(self) - 1))
                hashes.append(_hashes_at((packed & HASH) + np.uint64(1), np.zeros(1, np.int64), len(packed))[0])
            before += len(packed)
        nothing, none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        zeros = np.zeros(len(places), np.int64)
        return [(nothing, nothing, nothing, none, none), (zeros, zeros, np.array(places, np.int64), np.array(hashes, np.uint64), none)]

    def windows(self, size: int, literals: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, places, hashes, slot values of the text) of literal readings, exact windows and open readings."""
        return [(at, *rest) for at, _, *rest in self.parts(size, literals)]

    def parts(self, size: int, literals: int) -> list[tuple[np.ndarray, ...]]:
        """(starts, numbers of their texts, places there, hashes, slot values) of literal readings, exact windows and open readings.

        Lines are those of a single text."""
        if size == LINES:
            return self.lines(literals)
        needed, parts = min(literals, size), []
        if len(self.found) < size:
            parts += [(*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64), self.slots)] * 2
        if len(self.found) >= size:
            plain = np.concatenate([[0], np.cumsum(self.plain)])
            rich = plain[size:] - plain[:-size] < needed
            whole = self.of[size - 1 :] == self.of[: len(rich)]
            at = np.flatnonzero(~rich & whole)
            parts.append((at, self.of[at], self.place[at], window_hashes(self.found, size)[at], self.slots))
            at = np.flatnonzero(rich & whole)
            parts.append((at, self.of[at], self.place[at], _hashes_at(self.exact, at, size), self.slots))
        if len(self.open_found) >= size:
            kind = self.open_slots & np.uint64(3)
            maybe = np.concatenate([[0], np.cumsum(kind == MAYBE)])
            plain = np.concatenate([[0], np.cumsum(((kind == 0) | (kind == MAYBE)) & self.open_plain)])
            whole = self.open_of[size - 1 :] == self.open_of[: len(self) - size + 1]
            at = np.flatnonzero((maybe[size:] > maybe[:-size]) & (plain[size:] - plain[:-size] >= needed) & whole)
            if len(at):
                parts.append((at, self.open_of[at], self.open_place[at], window_hashes(self.open_found, size)[at], self.open_slots))
        return parts


def _rows(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def _listed(parts: list[tuple], size: int, passes: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int, list[int], bool]]:
    """(number of the text, place, size, hash, slot values, whether it is exact) of the windows, or of those whose hash passes the filter."""
    for number, (at, of, places, hashes, slots) in enumerate(parts):
        if passes is not None:
            kept = np.flatnonzero(passes[hashes & np.uint64((1 << FILTER_BITS) - 1)])
            at, of, places, hashes = at[kept], of[kept], places[kept], hashes[kept]
        for p, text, place, value in zip(at.tolist(), of.tolist(), places.tolist(), hashes.view(np.int64).tolist(), strict=True):
            filled = slots[p : p + size]
            yield text, place, size, value, filled[filled > 0].view(np.int64).tolist(), number == 1


def item_windows(items: DataFrame, window: int = 8, literals: int = 5) -> DataFrame:
    """item_id, n_items, item_pos, size, hash, item_slots, exact, n_windows and n_typed (those not only exact) of every window of every class
    of items of one template; ``item_id`` is the least of the class."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = TemplateWords()
        for batch in batches:
            rows = []
            for item_id, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                reading = Reading(text, words)
                # A short item is one window in either reading.
                sizes = {min(window, len(reading)), min(window, len(reading.found))}
                # Items of one template have the same readings.
                template = xxhash.xxh3_128_digest(reading.found.tobytes() + b"|" + reading.open_found.tobytes())
                for size in sorted(x if x >= literals else LINES for x in sizes if x):
                    rows += [(item_id, template, *rest) for _, *rest in _listed(reading.parts(size, literals), size)]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            names = ["item_id", "template", "item_pos", "size", "hash", "item_slots", "exact"]
            yield _rows([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    distinct = items.filter(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"))
    schema = "item_id long, template binary, item_pos long, size long, hash long, item_slots array<long>, exact boolean"
    listed = materialise(distinct.select("item_id", "text").mapInArrow(given_back(cut), schema), "item-windows")
    # Windows are counted by their place, as one place may have several hashes.
    classes = materialise(
        listed.groupBy("template").agg(
            F.min(F.coalesce("item_id", F.lit(0))).alias("first"), F.min("item_id").alias("class_id"), F.count_distinct(F.coalesce("item_id", F.lit(0))).alias("n_items"),
            F.count_distinct("item_pos").alias("n_windows"), F.count_distinct(F.when(~F.col("exact"), F.col("item_pos"))).alias("n_typed"),
        ),
        "item-classes",
    )
    joined = listed.join(classes, "template").filter(F.col("exact") | (F.coalesce("item_id", F.lit(0)) == F.col("first")))
    # An exact window has nothing to replace.
    slots = F.when(F.col("exact"), F.array().cast("array<bigint>")).otherwise(F.col("item_slots"))
    return joined.select(F.col("class_id").alias("item_id"), "n_items", "item_pos", "size", "hash", slots.alias("item_slots"), "exact", "n_windows", "n_typed").distinct()


def window_filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """(bitmap over ``FILTER_BITS`` hash bits, sizes of the windows); at most that many bits reach the driver. Runs a job."""
    slot = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("slot")
    rows = windows.select(slot, "size").distinct().toPandas()
    bitmap = np.zeros(1 << FILTER_BITS, bool)
    bitmap[rows["slot"].to_numpy(np.int64)] = True
    return np.packbits(bitmap), sorted(int(x) for x in rows["size"].unique())


def document_windows(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], literals: int = 5) -> DataFrame:
    """doc_id, pos, size, hash, slots of those windows of the documents whose hash passes the filter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, passes = TemplateWords(), np.unpackbits(bitmap).view(bool)
        for batch in (piece for whole in batches for piece in batches_of(whole, TOGETHER)):
            rows: list[tuple] = []
            doc_ids, texts = batch["doc_id"].to_pylist(), [x or "" for x in batch["text"].to_pylist()]
            reading = Reading(texts, words)
            for size in sizes:
                if size == LINES:
                    for doc_id, text in zip(doc_ids, texts, strict=True):
                        rows += [(doc_id, *rest[1:5]) for rest in _listed(Reading(text, words).lines(literals), size, passes)]
                else:
                    rows += [(doc_ids[text], *rest) for text, *rest, _ in _listed(reading.parts(size, literals), size, passes)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield _rows([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "pos", "size", "hash", "slots"])

    schema = "doc_id long, pos long, size long, hash long, slots array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(given_back(cut), schema)


def template_matches(docs: DataFrame, items: DataFrame, window: int = 8, literals: int = 5) -> DataFrame:
    """doc_id, item_id, n_items (of its template), matched and n_windows (windows of the item), coverage, start, end (in template words of the
    document), n_slots and n_changed (slots filled, and those filled otherwise), over all consistent matches."""
    listed = materialise(item_windows(items, window, literals), "class-windows")
    bitmap, sizes = window_filter(listed)
    hits = document_windows(docs, bitmap, sizes, literals).join(listed, ["hash", "size"])

    def value_pair(x: Column) -> Column:
        """Of one slot of an item the value, what fills it in the document, whether it is a name, may be one."""
        kind = x["item_slots"].bitwiseAND(F.lit(int(MAYBE)))
        of, by = (x[name].bitwiseAND(F.lit(~0xFFFF)).alias(alias) for name, alias in (("item_slots", "of"), ("slots", "by")))
        return F.struct(of, by, (kind == int(NAME)).alias("name"), (kind == int(MAYBE)).alias("maybe"))

    def plain(pairs: Column) -> Column:
        return F.array_distinct(F.transform(pairs, lambda x: F.struct(x["of"].alias("of"), x["by"].alias("by"))))

    def agrees(a: Column, b: Column) -> Column:
        return (a["of"] == b["of"]) & (a["by"] == b["by"])

    window_row = F.struct("item_pos", "pos", "size", "exact", F.transform(F.when(F.col("exact"), F.array().cast(PAIRS)).otherwise(F.arrays_zip("item_slots", "slots")), value_pair).alias("pairs"))
    diagonals = (
        hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
        .agg(F.collect_set(window_row).alias("windows"), F.first("n_windows").alias("n_windows"), F.first("n_typed").alias("n_typed"), F.first("n_items").alias("n_items"))
        .withColumn("filled", F.flatten(F.transform("windows", lambda w: w["pairs"])))
        .withColumn("replaced", plain(F.col("filled")))
        .withColumn("names", plain(F.filter("filled", lambda x: x["name"])))
    )
    # Persons that change places make another story: a name with several new ones, of which one also stands for another name.
    mixed_up = F.exists(
        "names",
        lambda p: (F.size(F.filter("names", lambda q: q["of"] == p["of"])) > 1)
        & ~F.exists("names", lambda q: (q["of"] == p["of"]) & (q["by"] == p["of"]))
        & F.exists("names", lambda q: (q["of"] != p["of"]) & (q["by"] == p["by"])),
    )

    def most_frequent(value: Column) -> Column:
        """What fills the value in most windows; if several do, the value itself first."""
        counted = F.transform(
            F.filter("replaced", lambda r: r["of"] == value),
            lambda r: F.struct(
                F.size(F.filter("filled", lambda f: agrees(f, r))).alias("n"), (r["by"] == value).alias("same"), r["of"].alias("of"), r["by"].alias("by")
            ),
        )
        return F.array_max(counted)

    of = F.array_distinct(F.transform("replaced", lambda r: r["of"]))
    kept = F.filter("windows", lambda w: F.forall(w["pairs"], lambda p: F.exists("chosen", lambda c: agrees(c, p))))
    changed = F.size(F.filter("pairs", lambda x: x["of"] != x["by"]))

    def share(matched: Column, n: Column) -> Column:
        return F.struct(F.when(n > 0, matched / n).otherwise(0.0).alias("coverage"), matched.cast("long").alias("matched"), n.alias("n_windows"))

    return (
        diagonals.filter(~mixed_up)
        .withColumn("contradicts", F.size(of) < F.size("replaced"))
        .withColumn("chosen", F.when(F.col("contradicts"), F.transform(of, most_frequent)))
        .withColumn("windows", F.when(F.col("contradicts"), kept).otherwise(F.col("windows")))
        .filter(F.size("windows") > 0)
        .select(
            "doc_id", "item_id", "n_items", "n_windows", "n_typed", F.col("windows.item_pos").alias("at"),
            F.transform(F.filter("windows", lambda w: ~w["exact"]), lambda w: w["item_pos"]).alias("typed_at"),
            F.array_min("windows.pos").alias("start"), F.array_max(F.transform("windows", lambda w: w["pos"] + F.greatest(w["size"], F.lit(1)))).alias("end"),
            plain(F.filter(F.flatten("windows.pairs"), lambda x: ~(x["maybe"] & (x["of"] == x["by"])))).alias("pairs"),
        )
        .withColumn("changed", changed)
        .groupBy("doc_id", "item_id")
        .agg(
            F.greatest(
                share(F.size(F.array_distinct(F.flatten(F.collect_set("at")))), F.first("n_windows")),
                share(F.size(F.array_distinct(F.flatten(F.collect_set("typed_at")))), F.first("n_typed")),
            ).alias("best"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.max(F.size("pairs")).cast("long").alias("n_slots"),
            F.max("changed").cast("long").alias("n_changed"),
            F.first("n_items").alias("n_items"),
        )
        .select("doc_id", "item_id", "n_items", "best.matched", "best.n_windows", "start", "end", "n_slots", "n_changed", "best.coverage")
    )


def leaks(docs: DataFrame, items: DataFrame, coverage: float = 0.3, window: int = 8, literals: int = 5) -> DataFrame:
    """The matches that cover enough of their item."""
    return template_matches(docs, items, window, literals).filter(F.col("coverage") >= coverage)


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents into which no item leaks, with their columns."""
    found = leaks(docs, items, **options).select(F.col("doc_id").alias("leaking_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leaking_id"]), "left_anti")
