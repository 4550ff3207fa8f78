"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of ``window`` bytes. In each window one recurrent unit runs forwards, one
backwards, and a softmax over both states labels every byte; the mean of a text's label probabilities is its
document probability. The gates are piecewise linear (``clip(x, 0, 1)``), the candidate state is a tanh. Training is
backpropagation through time with Adam, in numpy, on windows of a bounded sample of labelled documents.

Defined cases: a null text, and one without a letter, is ``und`` with score 0, as is every text if no language can
be learned; rows with a null ``doc_id`` are predicted but neither learned from nor held out; repeated rows are kept;
an empty table gives an empty table; other columns are ignored; texts of any length are read to the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import batches_of, given_back

PAD = 256
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass(frozen=True)
class GruSettings:
    """``docs_per_language`` documents and ``windows_per_doc`` windows of each bound the training sample."""

    hidden: int = 8
    window: int = 64
    docs_per_language: int = 300
    windows_per_doc: int = 6
    epochs: int = 4
    batch: int = 128
    rate: float = 0.015
    seed: int = 11


class GruLabeller:
    """The network: its weights, a forward pass, and training."""

    def __init__(self, languages: list[str], settings: GruSettings):
        draw, h = np.random.default_rng(settings.seed), settings.hidden
        self.languages, self.settings = languages, settings
        # Input tables of both directions, one row a byte: update gate, reset gate, candidate.
        self.table = draw.normal(0, 0.3, (2, PAD + 1, 3 * h)).astype(np.float32)
        self.table[:, :, : 2 * h] += 0.5
        self.recurrent = (draw.normal(0, 1, (2, h, 3 * h)) / np.sqrt(3 * h)).astype(np.float32)
        self.out = draw.normal(0, 0.3, (2 * h, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self._hold_pad()

    def _hold_pad(self) -> None:
        """Padding keeps the state: its update gate is always one."""
        self.table[:, PAD] = 0
        self.table[:, PAD, : self.settings.hidden] = 1e4

    def states(self, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
        """(step, direction, window, hidden) for codes (window, position); direction 1 steps backwards."""
        n, steps = codes.shape
        h = self.settings.hidden
        found = np.empty((steps, 2, n, h), np.float32)
        state, inputs, gates = np.zeros((2, n, h), np.float32), np.empty((2, n, 3 * h), np.float32), np.empty((2, n, 3 * h), np.float32)
        by_step = np.ascontiguousarray(codes.T)
        for t in range(steps):
            np.take(self.table[0], by_step[t], axis=0, out=inputs[0], mode="clip")
            np.take(self.table[1], by_step[steps - 1 - t], axis=0, out=inputs[1], mode="clip")
            np.matmul(state, self.recurrent, out=gates)
            zr = inputs[..., : 2 * h] + gates[..., : 2 * h]
            np.clip(zr, 0, 1, out=zr)
            z, r = zr[..., :h], zr[..., h:]
            candidate = np.tanh(inputs[..., 2 * h :] + r * gates[..., 2 * h :])
            if trace is not None:
                trace.append((state, zr, gates[..., 2 * h :].copy(), candidate))
            state = found[t] = candidate + z * (state - candidate)
        return found

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(position, window, language)."""
        h = self.settings.hidden
        scores = states[:, 0] @ self.out[:h]
        scores += states[::-1, 1] @ self.out[h:]
        scores += self.bias
        scores -= scores.max(axis=-1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=-1, keepdims=True)
        return scores

    def train(self, codes: np.ndarray, labels: np.ndarray) -> None:
        s = self.settings
        draw, h, steps = np.random.default_rng(s.seed + 1), s.hidden, codes.shape[1]
        weights = [self.table, self.recurrent, self.out, self.bias]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        rounds = s.epochs * -(-len(codes) // s.batch)
        step = 0
        for _ in range(s.epochs):
            order = draw.permutation(len(codes))
            for at in range(0, len(codes), s.batch):
                some, wanted = codes[order[at : at + s.batch]], labels[order[at : at + s.batch]]
                trace: list = []
                states = self.states(some, trace)
                error = self.probabilities(states)
                error[:, np.arange(len(some)), wanted] -= 1
                real = (some.T != PAD)[:, :, None]
                error *= real / max(1, real.sum())
                flat = error.reshape(-1, error.shape[-1])
                d_out = np.concatenate([states[:, 0].reshape(-1, h).T @ flat, states[::-1, 1].reshape(-1, h).T @ flat])
                from_out = np.stack([error @ self.out[:h].T, (error @ self.out[h:].T)[::-1]], axis=1)
                d_table, d_recurrent = np.zeros_like(self.table), np.zeros_like(self.recurrent)
                carried = np.zeros_like(states[0])
                for t in range(steps - 1, -1, -1):
                    before, zr, gate, candidate = trace[t]
                    z, r = zr[..., :h], zr[..., h:]
                    d = carried + from_out[t]
                    d_candidate = d * (1 - z) * (1 - candidate * candidate)
                    d_zr = np.concatenate([d * (before - candidate), d_candidate * gate], axis=-1) * ((zr > 0) & (zr < 1))
                    d_gates = np.concatenate([d_zr, d_candidate * r], axis=-1)
                    d_inputs = np.concatenate([d_zr, d_candidate], axis=-1)
                    np.add.at(d_table[0], some[:, t], d_inputs[0])
                    np.add.at(d_table[1], some[:, steps - 1 - t], d_inputs[1])
                    d_recurrent += before.transpose(0, 2, 1) @ d_gates
                    carried = d * z + d_gates @ self.recurrent.transpose(0, 2, 1)
                step += 1
                rate = s.rate * (1 - 0.9 * step / rounds)
                slopes = [d_table, d_recurrent, d_out, flat.sum(axis=0)]
                size = np.sqrt(sum(float((g * g).sum()) for g in slopes))
                for w, g, (m, v) in zip(weights, slopes, moments, strict=True):
                    g = g * min(1.0, 1.0 / max(size, 1e-12))
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                self._hold_pad()

    def windows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, number of windows of each text) of texts lying at ``starts:ends`` in ``data``."""
        size = self.settings.window
        counts = -(-(ends - starts) // size)
        first = np.repeat(starts - size * (np.cumsum(counts) - counts), counts) + size * np.arange(int(counts.sum()))
        at = first[:, None] + np.arange(size)
        inside = at < np.repeat(ends, counts)[:, None]
        return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], np.int16(PAD)).astype(np.int16), counts

    def document_probabilities(self, data: np.ndarray, offsets: np.ndarray, most_windows: int = 4096) -> np.ndarray:
        """(document, language): mean label probability over the bytes of each document; zero for an empty one."""
        codes, counts = self.windows(data, offsets[:-1], offsets[1:])
        sums = np.zeros((len(codes) + 1, len(self.languages)))
        for at in range(0, len(codes), most_windows):
            some = codes[at : at + most_windows]
            found = self.probabilities(self.states(some))
            if (some[:, -1] == PAD).any():
                found *= (some.T != PAD)[:, :, None]
            sums[at : at + len(some)] = found.sum(axis=0)
        total = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(sums[:-1], axis=0)])
        ends = np.cumsum(counts)
        return (total[ends] - total[ends - counts]) / np.maximum(np.diff(offsets), 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of every text."""
        known = np.array([bool(self.languages) and x is not None and any(map(str.isalpha, x)) for x in texts], bool)
        encoded = [x.encode() if k else b"" for x, k in zip(texts, known, strict=True)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
        found = self.document_probabilities(np.frombuffer(b"".join(encoded), np.uint8), offsets)
        best = found.argmax(axis=1) if self.languages else np.zeros(len(texts), np.int64)
        names = [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
        return names, np.where(known, np.clip(found.max(axis=1, initial=0), 0, 1), 0.0)

    def position_labels(self, text: str) -> list[tuple[int, int, str]]:
        """Spans (start, end in code points, language) of neighbouring characters with the same label."""
        data = np.frombuffer(text.encode(), np.uint8)
        if not len(data) or not self.languages:
            return []
        codes, _ = self.windows(data, np.zeros(1, np.int64), np.array([len(data)]))
        found = [self.probabilities(self.states(codes[at : at + 4096])).argmax(axis=-1).T.ravel() for at in range(0, len(codes), 4096)]
        labels = np.concatenate(found)[: len(data)][(data & 0xC0) != 0x80]
        cuts = np.flatnonzero(np.diff(labels)) + 1
        return [(int(a), int(b), self.languages[labels[a]]) for a, b in zip([0, *cuts], [*cuts, len(labels)], strict=True)]


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def learn_languages(docs: DataFrame, learn_from: Column, settings: GruSettings = GruSettings()) -> GruLabeller:  # noqa: B008
    """Train on labelled documents for which ``learn_from`` holds. Runs two jobs: a count by language, then the sample.

    Documents are drawn by a hash of their id, the same ones however the table is partitioned. What reaches the driver is
    ``docs_per_language * windows_per_doc`` windows for each language, whatever the size of the corpus or its texts.
    """
    labelled = docs.filter(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    model = GruLabeller(languages, settings)
    if not languages:
        return model
    # 1.3 times as many as wanted and some more, so that chance leaves too few only where there are few.
    shares = {x: min(1.0, (1.3 * settings.docs_per_language + 30) / counts[x]) for x in languages}
    share = F.create_map(*[F.lit(y) for x in languages for y in (x, float(shares[x] * (1 << 24)))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24))
    size, each = settings.window, settings.windows_per_doc

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, doc_id, lang, text in zip(*(batch[c].to_pylist() for c in ("place", "doc_id", "lang", "text")), strict=True):
                data = text.encode()
                draw = np.random.default_rng([doc_id & 0xFFFFFFFF, len(data)])
                for k in range(each if len(data) > size else 1):
                    at = int(draw.integers(0, max(1, len(data) - size + 1)))
                    rows.append((place, doc_id, k, lang, data[at : at + size]))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["place", "doc_id", "k", "lang", "data"])

    drawn = labelled.withColumn("place", place).filter(F.col("place") < share[F.col("lang")])
    sample = drawn.select("place", "doc_id", "lang", "text").mapInArrow(cut, "place long, doc_id long, k long, lang string, data binary")
    rows = sorted({tuple(r) for r in sample.collect() if len(r["data"])})
    kept, taken = [], dict.fromkeys(languages, 0)
    for *_, lang, data in rows:
        if taken[lang] < settings.docs_per_language * each:
            taken[lang] += 1
            kept.append((languages.index(lang), data))
    if not kept:
        return GruLabeller([], settings)
    codes = np.full((len(kept), size), PAD, np.int16)
    for row, (_, data) in zip(codes, kept, strict=True):
        row[: len(data)] = np.frombuffer(data, np.uint8)
    model.train(codes, np.array([label for label, _ in kept]))
    return model


def predict_languages(docs: DataFrame, model: GruLabeller) -> DataFrame:
    """``lang_pred`` and ``score`` of every document, read from its text alone."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in batches_of(whole)):
            names, scores = model.predict(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    held_out = F.coalesce(remainder() == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held_out, "text").mapInArrow(given_back(predict), PREDICTED)


def identify_languages(docs: DataFrame, settings: GruSettings = GruSettings()) -> DataFrame:  # noqa: B008
    """Learn from the documents that are not held out, predict all."""
    return predict_languages(docs, learn_languages(docs, remainder() != 1, settings))


def with_language(docs: DataFrame, model: GruLabeller, least_score: float = 0.35) -> DataFrame:
    """Documents in a language the model knows: neither ``und`` nor of a score below ``least_score``, with all their columns."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in batches_of(whole)):
            names, scores = model.predict(batch["text"].to_pylist())
            yield batch.filter(pa.array([x != "und" and y >= least_score for x, y in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(given_back(sift), docs.schema)


def label_positions(docs: DataFrame, model: GruLabeller) -> DataFrame:
    """The language of every position: ``spans`` of (start, end, lang) in code points, without gaps."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            spans = [model.position_labels(x or "") for x in batch["text"].to_pylist()]
            rows = [[dict(zip(("start", "end", "lang"), s, strict=True)) for s in each] for each in spans]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, kind)], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<start: long, end: long, lang: string>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(label, schema)
