"""Quality rules whose limits adapt to each language and source, learned from mergeable quantile sketches.

Every document is measured once over its whole text. The values of a group are held in a sketch: whole numbers, cut
to their seven leading bits, with counts. Sketches are merged by adding counts, in any order, and every quantile is
exact to 1/64 of its value. A group's upper limit lies beyond its ninth decile, by ``reach`` times the way from its median to there;
where that way is shorter than what one more symbol, line or word makes in the group's median document, this is taken for it. Lower limits, of
word lengths, lie as far below the first decile. So all limits are learned; none holds a fixed slack. Documents are compared with them
by the same leading bits. A group of fewer than ``least`` documents takes the limits of its language, a small language those of the corpus.

Defined cases: a null or empty text has no words and fails the base rules; documents that fail them are in no sketch; null
languages and sources are groups like any other; repeated rows are measured each; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import batches_of, div
from paceline.session import materialise

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Measured value (whole number), and the count in a thousand of which it is measured. A rule without one has a lower limit too.
RULES = {
    "word_length": ("100 * word_chars div n_words", None),
    "symbols": ("1000 * n_symbols div n_words", "n_words"),
    "dup_lines": ("1000 * n_dup_lines div n_lines", "n_lines"),
    "repeats": ("1000 * n_repeat_words div n_words", "n_words"),
}
#: What is sketched: the rules' values, and the sizes of documents.
SKETCHED = {rule: formula for rule, (formula, _) in RULES.items()} | {"n_words": "n_words", "n_lines": "n_lines"}
DECILES = {"low": 1, "median": 5, "high": 9}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def repeated_words(ids: np.ndarray, size: int) -> int:
    """Words of a text inside three-word windows that the text has twice or more; ``ids`` are below ``size``."""
    if len(ids) < 4:
        return 0
    ids = ids.astype(np.int64)
    pairs, third = ids[:-2] * size + ids[1:-1], ids[2:]
    if size >= 1 << 21:  # three do not fit one number: the pairs are numbered first
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs * size + third, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in batches_of(whole)):
            texts = pc.fill_null(batch["text"].cast(pa.large_string()), "")
            cut = pc.ascii_split_whitespace(texts)
            offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
            words = cut.flatten().dictionary_encode()
            ids, size = words.indices.to_numpy(), len(words.dictionary)
            empty = pc.index(words.dictionary, "").as_py()
            rows = []
            for k, text in enumerate(texts.to_pylist()):
                own = ids[offsets[k] : offsets[k + 1]]
                own = own[own != empty] if empty >= 0 else own
                lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
                rows.append(
                    (
                        len(own), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, "#*$%&|<>")),
                        len(lines) - len(set(lines)), repeated_words(own, size), len(lines),
                    )
                )
            columns = [pa.array(c, pa.int64()) for c in np.array(rows, np.int64).reshape(-1, len(COUNTS)).T]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["source"], *columns], ["doc_id", "lang", "source", *COUNTS])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long"), "lang", "source", "text").mapInArrow(count, schema)


def leading_bits(value: Column) -> Column:
    """A whole number with all but its seven leading bits set to zero."""
    cut = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(measured: DataFrame) -> DataFrame:
    """rule, lang, source, value, n: the sketch of every group, as rows."""
    values = F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.expr(formula).alias("measure")) for rule, formula in SKETCHED.items()]))
    return (
        measured.filter(~F.expr(BASE_FAILED))
        .select("lang", "source", values)
        .groupBy("rule", "lang", "source", leading_bits(F.col("measure")).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def deciles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged by ``keys``: their size and their deciles (the least value with that share at or below it)."""
    merged = sketch.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("value")
    ranked = merged.withColumn("below", F.sum("n").over(upto)).withColumn("size", F.sum("n").over(Window.partitionBy(*keys)))
    at_least = [F.min(F.when(F.col("below") * 10 >= F.col("size") * k, F.col("value"))).alias(name) for name, k in DECILES.items()]
    return ranked.groupBy(*keys).agg(F.first("size").alias("size"), *at_least)


def limits(sketch: DataFrame, least: int = 100, reach: int = 6) -> DataFrame:
    """lang, source, and the ``<rule>_low`` and ``<rule>_high`` of every group that has a sketch."""
    by_group = deciles(sketch, ["rule", "lang", "source"])
    by_lang = deciles(sketch, ["rule", "lang"]).select(F.col("rule").alias("of_rule"), F.col("lang").alias("of_lang"), *[F.col(c).alias(f"lang_{c}") for c in ("size", *DECILES)])
    corpus = deciles(sketch, ["rule"]).select("rule", *[F.col(c).alias(f"all_{c}") for c in DECILES])
    joined = by_group.join(by_lang, (F.col("rule") == F.col("of_rule")) & F.col("lang").eqNullSafe(F.col("of_lang"))).join(corpus, "rule")

    def settled(name: str) -> Column:
        return F.when(F.col("size") >= least, F.col(name)).when(F.col("lang_size") >= least, F.col(f"lang_{name}")).otherwise(F.col(f"all_{name}"))

    wide = joined.select("rule", "lang", "source", *[settled(c).alias(c) for c in DECILES]).groupBy("lang", "source").pivot("rule", list(SKETCHED)).agg(*[F.first(c).alias(c) for c in DECILES])

    def bounds(rule: str, size: str | None) -> list[Column]:
        low, median, high = (F.col(f"{rule}_{c}") for c in DECILES)
        one_more = F.lit(0).cast("long") if size is None else div(F.lit(1000).cast("long"), F.greatest(F.col(f"{size}_median"), F.lit(1)))
        lower = low - reach * (median - low) if size is None else F.lit(0)
        return [lower.cast("long").alias(f"{rule}_low"), (high + reach * F.greatest(high - median, one_more)).alias(f"{rule}_high")]

    return wide.select("lang", "source", *[c for rule, (_, size) in RULES.items() for c in bounds(rule, size)])


def judge(measured: DataFrame, least: int = 100, reach: int = 6) -> DataFrame:
    """The measured documents with ``base_failed``, ``kept`` and the rules each one fails.

    Limits are joined to documents; a group whose documents all failed the base rules needs none.
    """
    wide = limits(sketches(measured), least, reach).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = measured.join(wide, measured["lang"].eqNullSafe(wide["of_lang"]) & measured["source"].eqNullSafe(wide["of_source"]), "left")
    outside = {rule: ~leading_bits(F.expr(formula)).between(F.col(f"{rule}_low"), F.col(f"{rule}_high")) for rule, (formula, _) in RULES.items()}
    failed = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in outside.items()]))
    base = F.expr(BASE_FAILED)
    return joined.select(
        "doc_id", "lang", "source", *COUNTS, base.alias("base_failed"), F.when(base, F.lit(False)).otherwise(F.size(failed) == 0).alias("kept"),
        F.when(base, F.array().cast("array<string>")).otherwise(failed).alias("failed_rules"),
    )


def apply_rules(docs: DataFrame, least: int = 100, reach: int = 6) -> DataFrame:
    """All documents, judged. The counts are written once, as both the sketches and the judgement read them."""
    return judge(materialise(measure(docs), "measured"), least, reach)
