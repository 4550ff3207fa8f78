"""Text similarity: difflib's ratio, ignoring case, and upper bounds of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of letter classes, each dividing the next: classes of a finer division lie inside those of a coarser one.
DIVISIONS = (1, 2, 4, 8, 16, 32, 64)


def letter_counts(texts: Sequence[str], classes: int) -> np.ndarray:
    """How many letters of each class every text has; a class is what code points leave when divided by their number."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.repeat(np.arange(len(texts)), sizes) * classes + letters % classes
    return np.bincount(at, minlength=len(texts) * classes).reshape(-1, classes)


def shared_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The highest ratio that texts with these letter counts can have: letters they share, twice, by all letters."""
    total = a.sum(axis=-1) + b.sum(axis=-1)
    return np.where(total > 0, 2.0 * np.minimum(a, b).sum(axis=-1) / np.maximum(total, 1), 1.0)


def ratio_bound(classes: int) -> Callable[[Column, Column], Column]:
    """A vectorised function of two keys of ``letter_keys``, of this division or a finer one: the highest ratio that the letters of their
    texts, told apart by class only, allow."""

    def bound(keys: pd.Series, others: pd.Series) -> pd.Series:
        a, b = (letter_counts(list(side), classes) for side in (keys, others))
        return pd.Series(shared_bound(a, b))

    return F.pandas_udf(bound, "double")


def letter_keys() -> Callable[[Column], Column]:
    """A vectorised function of a text: for every division, a key that texts share if they have the same letter counts in it.

    For one class it is the number of letters, else the classes of the letters in ascending order, class k as code point 64 + k, so that
    a key has the letter counts of its text, in its own division and in all coarser ones.
    """

    def keys(names: pd.Series) -> pd.DataFrame:
        lowered = [x.lower() for x in names]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        letters = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner, ends = np.repeat(np.arange(len(lowered)), sizes), np.cumsum(sizes).tolist()
        spelt = {"k1": list(map(str, sizes.tolist()))}
        for c in DIVISIONS[1:]:
            classes = (np.sort(owner * c + letters % c) % c + 64).astype(np.uint8).tobytes().decode("ascii")
            spelt[f"k{c}"] = [classes[start:end] for start, end in zip([0, *ends], ends)]
        return pd.DataFrame(spelt)

    return F.pandas_udf(keys, ", ".join(f"k{c} string" for c in DIVISIONS))


def ratio() -> Callable[[Column, Column], Column]:
    """A vectorised function of two texts: difflib's ratio of the first to the second."""

    def scored(names: pd.Series, others: pd.Series) -> pd.Series:
        import difflib

        matcher, found = difflib.SequenceMatcher(None, "", ""), []
        for name, other in zip(names, others, strict=True):
            matcher.set_seqs(name.lower(), other.lower())
            found.append(matcher.ratio())
        return pd.Series(found, dtype="float64")

    return F.pandas_udf(scored, "double")


def best_of_lists(lists: Mapping[str, Sequence[str]]) -> Callable[[Column, Column], Column]:
    """A vectorised function ``(kind, name) -> struct<match, score>`` over short lists of names, one for each kind.

    Finds the name of the list most similar to the given one; the least of equal ones wins. A list is tried in the order of the
    upper bounds, and no further than a name can still win.
    """
    listed = {kind: sorted(names) for kind, names in lists.items()}

    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import difflib

        prepared = {kind: ([x.lower() for x in names], letter_counts([x.lower() for x in names], DIVISIONS[-1])) for kind, names in listed.items() if names}
        matcher = difflib.SequenceMatcher(None, "", "")
        for kinds, names in batches:
            found = []
            for kind, name in zip(kinds, names, strict=True):
                best, score = None, -1.0
                if kind in prepared:
                    lowered, counts = prepared[kind]
                    bound = shared_bound(counts, letter_counts([name.lower()], DIVISIONS[-1]))
                    for k in np.lexsort((np.arange(len(bound)), -bound)):
                        if bound[k] < score:
                            break
                        matcher.set_seqs(name.lower(), lowered[k])
                        value = matcher.ratio()
                        if value > score or value == score and k < best:
                            best, score = k, value
                found.append((None if best is None else listed[kind][best], max(score, 0.0)))
            yield pd.DataFrame(found, columns=["match", "score"])

    return F.pandas_udf(find, "match string, score double").asNondeterministic()
