"""Quality of documents by attention-based multiple-instance learning, trained here with numpy.

A document is a bag of passages. Each passage is encoded from its measures, a gated attention
(tanh times sigmoid) weighs the passages of a document against each other, and the weighted sum of
their codes is scored. Labels belong to documents only; the attention learns which passages
account for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxweave.llm.common import map_batches, picked
from boxweave.llm.language import adam

#: Words of a passage; numbers that stand for a passage; attention units.
PASSAGE, CODE, GATE = 80, 24, 12
#: Passages measured or scored at a time.
BLOCK = 4096
PRINTED = [*range(33, 127)]


def _measures() -> int:
    return len(PRINTED) + 12


def measured(text: str | None) -> np.ndarray:
    """Measures of every passage of a text, (passages, measures) as float32, at least one passage.

    Shares of each printed ASCII byte; shares of upper and lower case, digits, other ASCII, bytes
    above ASCII; words' mean length and share of capitalised and of one-letter words; share
    of distinct words and of words equal to the one before; lines per word; length.
    """
    words = (text or "").split()
    lines = (text or "").count("\n") / max(1, len(words))
    blocks = [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)] or [[]]
    out = np.zeros((len(blocks), _measures()), np.float32)
    for i, block in enumerate(blocks):
        data = np.frombuffer("".join(block).encode("utf-8"), np.uint8)
        counts, n, m = np.bincount(data, minlength=256) / max(1, len(data)), max(1, len(block)), len(PRINTED)
        out[i, :m] = counts[PRINTED]
        upper, lower, digit, above = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[128:].sum()
        same = sum(a == b for a, b in zip(block, block[1:]))
        out[i, m:] = [
            upper, lower, digit, 1 - upper - lower - digit - above, above, min(4, len(data) / n / 10), sum(w[0].isupper() for w in block) / n,
            sum(len(w) == 1 for w in block) / n, len(set(block)) / n, same / n, min(1, lines), np.log1p(len(block)) / 5,
        ]
    return out


@dataclass
class AttentionNet:
    """Encoder, gated attention and classifier; ``centre`` and ``scale`` standardise the measures."""

    centre: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    classify: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, passages: np.ndarray, rng: np.random.Generator) -> AttentionNet:
        d = passages.shape[1]
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        return cls(passages.mean(axis=0), passages.std(axis=0) + 0.02, draw(d, CODE), np.zeros(CODE), draw(CODE, GATE), draw(CODE, GATE), draw(GATE), draw(CODE), np.zeros(1))

    def weights(self) -> list[np.ndarray]:
        return [self.encode, self.encode_bias, self.tanh, self.gate, self.attend, self.classify, self.bias]

    def forward(self, passages: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scores of bags that begin at ``first`` and what leads to them."""
        x = np.clip((passages - self.centre) / self.scale, -8, 8)
        code = np.tanh(x @ self.encode + self.encode_bias)
        a, b = np.tanh(code @ self.tanh), 1 / (1 + np.exp(-(code @ self.gate)))
        size = np.diff(np.r_[first, len(passages)])
        bag = np.repeat(np.arange(len(first)), size)
        raw = (a * b) @ self.attend
        e = np.exp(raw - np.maximum.reduceat(raw, first)[bag])
        weight = e / np.add.reduceat(e, first)[bag]
        pooled = np.add.reduceat(weight[:, None] * code, first)
        score = 1 / (1 + np.exp(-np.clip(pooled @ self.classify + self.bias, -30, 30)))
        return score, pooled, weight, bag, a, b, code, x

    def gradients(self, passages: np.ndarray, first: np.ndarray, labels: np.ndarray, decay: float = 1e-3) -> list[np.ndarray]:
        """Of the mean cross-entropy and a quadratic penalty on the weights."""
        score, pooled, weight, bag, a, b, code, x = self.forward(passages, first)
        slope = (score - labels) / len(labels)
        from_pooled = slope[:, None] * self.classify
        d_weight = (code * from_pooled[bag]).sum(axis=1)
        d_raw = weight * (d_weight - np.add.reduceat(weight * d_weight, first)[bag])
        d_gated = d_raw[:, None] * self.attend
        d_a, d_b = d_gated * b * (1 - a * a), d_gated * a * b * (1 - b)
        d_code = (weight[:, None] * from_pooled[bag] + d_a @ self.tanh.T + d_b @ self.gate.T) * (1 - code * code)
        own = [x.T @ d_code, d_code.sum(axis=0), code.T @ d_a, code.T @ d_b, (a * b).T @ d_raw, pooled.T @ slope, np.array([slope.sum()])]
        return [g + decay * w / len(self.weights()) for g, w in zip(own, self.weights())]


def _bagged(bags: list[np.ndarray], chosen) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([bags[i] for i in chosen]).astype(np.float64), np.r_[0, np.cumsum([len(bags[i]) for i in chosen])[:-1]].astype(int)


def train(bags: list[np.ndarray], labels: list[float], seed: int = 0, patience: int = 12, most_steps: int = 6000) -> AttentionNet:
    """Network from bags of measured passages and their documents' labels.

    Every tenth bag is held back (of 50 or more). Passes go on until the loss on these has not fallen for ``patience`` of
    them, ``most_steps`` steps at most, and the weights of the best pass are returned.
    """
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags) if bags else np.zeros((1, _measures()))
    net, y, size = AttentionNet.fresh(everything.astype(np.float64), rng), np.array(labels, np.float64), 32
    held = np.arange(9, len(bags), 10) if len(bags) >= 50 else np.zeros(0, int)
    own = np.setdiff1d(np.arange(len(bags)), held)
    checked = _bagged(bags, held) if len(held) else None
    step, done, best, since, kept = adam(net.weights(), 0.005), 0, np.inf, 0, None
    while len(own) and done < most_steps and since <= patience:
        order = rng.permutation(own)
        for at in range(0, len(order), size):
            part = order[at : at + size]
            step(net.gradients(*_bagged(bags, part), y[part]), max(0.1, 1 - done / most_steps))
            done += 1
        if checked is not None:
            p = np.clip(net.forward(*checked)[0], 1e-9, 1 - 1e-9)
            loss = -(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean()
            if loss < best - 1e-4:
                best, since, kept = loss, 0, [w.copy() for w in net.weights()]
            else:
                since += 1
    for w, saved in zip(net.weights(), kept or []):
        w[...] = saved
    return net


def learned(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", most_documents: int = 4000, most_passages: int = 64) -> AttentionNet:
    """A network trained on a bounded sample of labelled documents.

    ``labels`` holds the rows to learn from; of these at most ``most_documents`` are taken, in the
    order of a hash of their id. Of a document with more than ``most_passages``, so many are learned
    from, spread evenly. An id labelled more than once counts with its mean label; null labels and
    labels without a document are left out.
    """
    sample = labels.select(labels[id].alias("id"), labels[label].cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    sample = sample.groupBy("id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most_documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [measured(t.as_py()) for t in batch.column(1)]
            bags = [b[np.linspace(0, len(b) - 1, most_passages).astype(int)] if len(b) > most_passages else b for b in bags]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in bags]), batch.column(2)], ["id", "bag", "label"])

    rows = picked(docs, id=id, text=text).join(F.broadcast(sample), "id")
    kind = rows.schema["id"].dataType.simpleString()
    found = map_batches(rows.select("id", "text", "label"), run, f"id {kind}, bag binary, label double").collect()
    found = sorted(found, key=lambda r: (str(r.id), bytes(r.bag)))
    return train([np.frombuffer(r.bag, np.float32).reshape(-1, _measures()) for r in found], [r.label for r in found])


def quality_scores(docs: DataFrame, net: AttentionNet, id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row, from the text alone.

    All passages of the whole text are weighed. Null and empty texts are one passage without words
    and score like any other; ``predicted`` is 1 from ``threshold`` on. Repeated rows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, held, size = [], [], 0

            def flush() -> None:
                first = np.r_[0, np.cumsum([len(b) for b in held])[:-1]]
                scores.append(net.forward(np.concatenate(held).astype(np.float64), first)[0])

            for value in batch.column(1):
                held.append(measured(value.as_py()))
                size += len(held[-1])
                if size >= BLOCK:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = picked(docs, id=id, text=text)
    return map_batches(rows, run, f"doc_id {rows.schema['id'].dataType.simpleString()}, score double, predicted int")
