"""Rows and invented prose for the tests of the corpus operators."""

from __future__ import annotations

import random

import pyarrow as pa

CLASHING = ["part", "shard", "slot", "block_no", "place", "size", "path", "n", "words", "blob", "at", "label", "key", "start", "end", "first", "place_", "kept_spans"]
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
WORDS = {
    "en": "the of and house water that with from river stone light over under through window morning story people should".split(),
    "de": "der die und haus wasser nicht auch über straße größe mädchen schön licht durch fenster morgen geschichte menschen".split(),
}


def prose(seed: int, n_words: int, lang: str = "en") -> str:
    """Invented sentences, a line break now and then; words get endings so that chance repeats are rare."""
    draw, out = random.Random(seed), []
    while len(out) < n_words:
        size = min(draw.randint(6, 14), n_words - len(out))
        words = [draw.choice(WORDS[lang]) + (str(chr(97 + draw.randrange(26))) + chr(97 + draw.randrange(26)) if draw.random() < 0.6 else "") for _ in range(size)]
        words[0] = words[0].capitalize()
        words[-1] += ".\n" if draw.random() < 0.3 else "."
        out += words
    return " ".join(out).replace("\n ", "\n").strip()


def row(doc_id, text, lang="en", source="a"):
    return {"doc_id": doc_id, "text": text, "lang": lang, "source": source, "n_chars": len(text) if text is not None else None}
