"""Language of texts by a convolutional network over bytes, trained here with numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxweave.llm.common import map_batches, packed, picked
from boxweave.llm.sample import by_label

#: Bytes of a window; texts are cut into windows one after the other, the last filled up with 0.
WINDOW = 256
#: Widths of the filters, filters of each width, numbers that stand for a byte.
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4), 12, 8
#: Windows that pass through the network at a time.
BATCH = 64
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


@dataclass
class ByteNet:
    """Embedded bytes, filters of several widths, the maximum of each over the window, softmax."""

    languages: list[str]
    embed: np.ndarray  # (256, EMBEDDED)
    filters: np.ndarray  # (max width * EMBEDDED, filters); 0 where a filter is narrower
    bias: np.ndarray
    out: np.ndarray  # (filters, languages)
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> ByteNet:
        n, widest = len(WIDTHS) * FILTERS, max(WIDTHS)
        filters = rng.normal(0, 1, (widest * EMBEDDED, n)) / np.sqrt(3 * EMBEDDED) * cls.shape()
        return cls(languages, *(a.astype(np.float32) for a in (rng.normal(0, 0.5, (256, EMBEDDED)), filters, np.zeros(n), rng.normal(0, 0.3, (n, len(languages))), np.zeros(len(languages)))))

    @staticmethod
    def shape() -> np.ndarray:
        """1 where a filter has a weight."""
        rows = np.repeat(np.arange(max(WIDTHS)), EMBEDDED)[:, None]
        return (rows < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each window, before the bias, as (values, all responses)."""
        n, widest = len(windows), max(WIDTHS)
        codes = np.zeros((n, WINDOW + widest - 1), np.uint8)
        codes[:, :WINDOW] = windows
        spread = self.embed[codes]
        each = spread.strides
        patches = np.lib.stride_tricks.as_strided(spread, (n, WINDOW, widest * EMBEDDED), (each[0], each[1], each[2]))
        responses = (patches.reshape(n * WINDOW, -1) @ self.filters).reshape(n, WINDOW, -1)
        return responses.max(axis=1), responses

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), BATCH):
            hidden = np.maximum(self.pooled(windows[at : at + BATCH])[0] + self.bias, 0)
            parts.append(softmax(hidden @ self.out + self.out_bias))
        return np.concatenate(parts)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy; a filter's gradient flows to its largest response alone."""
        n, widest = len(windows), max(WIDTHS)
        best, responses = self.pooled(windows)
        where = responses.argmax(axis=1)
        hidden = np.maximum(best + self.bias, 0)
        slope = softmax(hidden @ self.out + self.out_bias)
        slope[np.arange(n), labels] -= 1
        slope /= n
        back = (slope @ self.out.T) * (hidden > 0)
        codes = np.zeros((n, WINDOW + widest - 1), np.uint8)
        codes[:, :WINDOW] = windows
        taken = codes[np.arange(n)[:, None, None], where[:, :, None] + np.arange(widest)]  # (n, filters, widest)
        patch = self.embed[taken].reshape(n, len(self.bias), -1)
        filters = np.einsum("nf,nfd->df", back, patch, optimize=True) * self.shape()
        embed = np.zeros_like(self.embed)
        np.add.at(embed, taken.ravel(), (back[:, :, None] * self.filters.T[None]).reshape(-1, EMBEDDED))
        return [embed, filters, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def adam(weights: list[np.ndarray], rate: float = 0.01):
    """A step function of the Adam method that changes ``weights`` in place."""
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0

    def step(gradients: list[np.ndarray], scale: float = 1.0) -> None:
        nonlocal t
        t += 1
        for w, g, a, b in zip(weights, gradients, m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= rate * scale * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    return step


def cut(text: str) -> np.ndarray:
    """All windows of a text, (n, WINDOW), at least one."""
    data = text.encode("utf-8")
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def drawn(text: str, n: int) -> np.ndarray:
    """``n`` windows from anywhere in a text, or all it has; the same each time."""
    own = cut(text)
    return own[np.sort(np.random.default_rng(zlib.crc32(text.encode("utf-8"))).permutation(len(own))[:n])]


def train(windows: np.ndarray, labels: list[str], epochs: int = 8, seed: int = 0) -> ByteNet:
    """Network for the languages that occur among ``labels``, one per window."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels)) or [UNDETERMINED]
    net, y = ByteNet.fresh(names, rng), np.searchsorted(names, labels)
    step, total, done = adam(net.weights()), max(1, epochs * -(-len(y) // BATCH)), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            part = order[at : at + BATCH]
            step(net.gradients(windows[part], y[part]), 1 - done / total)
            done += 1
    return net


def learned(docs: DataFrame, learn: Column, text: str = "text", language: str = "lang", key: str = "doc_id", per_language: int = 300, windows_each: int = 3) -> ByteNet:
    """A network trained on a bounded sample of the rows for which ``learn`` holds.

    About ``per_language`` texts of each language, chosen by the hash of ``key``, give up to
    ``windows_each`` windows each, drawn from the whole text; only these come to the driver, and at
    most ``per_language * windows_each`` are kept. Rows without letters or language are not learned
    from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, taken = [], []
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if LETTER.search(value):
                    windows = drawn(value, windows_each)
                    names += [language] * len(windows)
                    taken += [w.tobytes() for w in windows]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(taken, pa.binary())], ["language", "window"])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[language].alias("language"), learn.alias("learn"))
    rows = rows.where("learn AND text IS NOT NULL AND language IS NOT NULL")
    chosen = rows.where(by_label(rows.select("key", "language"), "language", "key", per_language)).select("language", "text")
    sample = sorted((r.language, bytes(r.window)) for r in map_batches(chosen, run, "language string, window binary").collect())
    seen: dict[str, int] = {}
    kept = []
    for i in np.random.default_rng(1).permutation(len(sample)):
        seen[sample[i][0]] = n = seen.get(sample[i][0], 0) + 1
        if n <= per_language * windows_each:
            kept.append(sample[i])
    return train(np.frombuffer(b"".join(w for _, w in kept), np.uint8).reshape(-1, WINDOW), [name for name, _ in kept])


def languages(docs: DataFrame, net: ByteNet, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row.

    All windows of the whole text are classified in batches; a text's probabilities are their mean,
    weighted by the bytes of the windows. Null texts and texts without a letter are ``und`` with
    score 0. ``score`` is the probability of the language named; on a tie the first name counts.
    Rows with a null id are kept, repeated rows repeated.
    """
    return _judged(picked(docs, doc_id=id, text=text), net, "doc_id")


def in_a_language(docs: DataFrame, net: ByteNet, least: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is undetermined or less probable than ``least``."""
    judged = _judged(packed(docs, text=text), net, "row")
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")


def _judged(rows: DataFrame, net: ByteNet, kept: str) -> DataFrame:
    """``(kept, lang_pred, score)`` of rows ``(kept, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            names, scores, held, rows = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows), [], []

            def flush() -> None:
                p = net.probabilities(np.concatenate(held))
                weight = np.concatenate([np.minimum(WINDOW, size - WINDOW * np.arange(len(w))) for w, (_, size) in zip(held, rows)])
                first = np.cumsum([0, *(len(w) for w in held[:-1])])
                mean = np.add.reduceat(p * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
                for (i, _), m in zip(rows, mean):
                    names[i], scores[i] = net.languages[int(m.argmax())], float(m.max())

            size = 0
            for i, value in enumerate(texts):
                value = value.as_py()
                if value and LETTER.search(value):
                    held.append(cut(value))
                    rows.append((i, len(value.encode("utf-8"))))
                    size += len(held[-1])
                if size >= 32 * BATCH:
                    flush()
                    held, rows, size = [], [], 0
            if held:
                flush()
            found = [pa.array(names), pa.array(np.minimum(scores, 1.0))]
            yield pa.RecordBatch.from_arrays([batch.column(kept), *found], [kept, "lang_pred", "score"])

    fields = [rows.schema[kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_batches(rows, run, T.StructType(fields))
