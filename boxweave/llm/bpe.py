"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and its inverse.

A pre-token of n bytes has n leaves. Leaf i holds ``rank << POSITION | i`` of the pair that starts
at i, or ``NONE``. Inner nodes hold the minimum, so the root names the leftmost pair of the
lowest rank. Merging it changes three leaves (the merged pair, its right part, the pair before),
and each costs one walk to the root. The merging ends when the root is ``NONE``.

Short pre-tokens are merged side by side, one tree per row of an array; long ones alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxweave.llm.common import map_batches, picked
from boxweave.llm.pretokens import Encoder, byte_letters, special_tokens, token_bytes

POSITION = 32
NONE = 1 << 62
#: Words remembered by a worker; fewer than where each new one is costlier.
REMEMBERED = 120_000
#: Pre-tokens of up to so many bytes are merged side by side, so many at a time.
SHORT, ROWS = 64, 8192


class Merges:
    """Ranks of the pairs of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)

    def ranked(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaves of the pairs; a side below 0 stands for no token."""
        key = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at] << POSITION | place, NONE)

    def together(self, rows: np.ndarray) -> np.ndarray:
        """Token ids of pre-tokens given as rows of byte ids, -1 after their end; -1 where a token was merged away."""
        n, width = rows.shape
        token, place, every = rows.copy(), np.arange(width), np.arange(n)
        after = np.where(np.c_[token[:, 1:], np.full(n, -1)] >= 0, place + 1, -1)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        tree[:, width : 2 * width - 1] = self.ranked(token[:, :-1], token[:, 1:], place[:-1])
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = every[tree[:, 1] < NONE]
        while len(live):
            root = tree[live, 1]
            at = root & ((1 << POSITION) - 1)
            gone = after[live, at]
            right, left = after[live, gone], before[live, at]
            token[live, at] = self.merged[root >> POSITION]
            token[live, gone] = -1
            after[live, at] = right
            linked = right >= 0
            before[live[linked], right[linked]] = at[linked]
            own = token[live, at]
            tree[live, width + gone] = NONE
            tree[live, width + at] = self.ranked(own, np.where(linked, token[live, right], -1), at)
            first = left < 0
            tree[live[~first], width + left[~first]] = self.ranked(token[live, left], own, left)[~first]
            for leaf in (at, gone, np.where(first, at, left)):
                node = (width + leaf) >> 1
                while node[0] > 0:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node >>= 1
            live = live[tree[live, 1] < NONE]
        return token

    def alone(self, token: list[int]) -> list[int]:
        """Token ids of one pre-token given by its byte ids."""
        n = len(token)
        width = 1 << max(1, (n - 1).bit_length())
        after, before, rank_of, low = [*range(1, n), -1], list(range(-1, n - 1)), self.rank_of, (1 << POSITION) - 1

        def leaf(i: int, j: int) -> int:
            rank = rank_of.get(token[i] << 32 | token[j]) if j >= 0 else None
            return NONE if rank is None else rank << POSITION | i

        tree = [NONE] * width + [leaf(i, after[i]) for i in range(n)] + [NONE] * (width - n)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                least = tree[2 * node] if tree[2 * node] < tree[2 * node + 1] else tree[2 * node + 1]
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < NONE:
            at = tree[1] & low
            token[at] = int(self.merged[tree[1] >> POSITION])
            gone = after[at]
            right = after[at] = after[gone]
            token[gone] = -1
            put(gone, NONE)
            if right >= 0:
                before[right] = at
            put(at, leaf(at, right))
            if before[at] >= 0:
                put(before[at], leaf(before[at], at))
        return [t for t in token if t >= 0]

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens as little-endian unsigned 32-bit integers."""
        data = [p.encode("utf-8") for p in pieces]
        size, out = np.array([len(d) for d in data], np.int64), [b""] * len(data)
        width = 2
        while width <= SHORT:
            own = np.flatnonzero((size <= width) & (size > (width // 2 if width > 2 else 0)))
            for at in range(0, len(own), ROWS):
                part = own[at : at + ROWS]
                rows = np.full((len(part), width), -1, np.int64)
                rows[np.arange(width) < size[part, None]] = self.byte_ids[np.frombuffer(b"".join([data[i] for i in part]), np.uint8)]
                token = self.together(rows)
                kept = token >= 0
                ids, ends = token[kept].astype("<u4").tobytes(), (np.cumsum(kept.sum(axis=1)) * 4).tolist()
                for i, a, b in zip(part.tolist(), [0, *ends], ends):
                    out[i] = ids[a:b]
            width *= 2
        for i in np.flatnonzero(size > SHORT).tolist():
            ids = self.alone(self.byte_ids[np.frombuffer(data[i], np.uint8)].tolist())
            out[i] = np.array(ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Encoder of the vocabulary file; one per worker process, so what it remembers serves all its tasks."""
    return Encoder(Merges(path).encode, special_tokens(path), REMEMBERED)


def decode(ids: list[int], path: str) -> str:
    """Text of token ids; bytes that are no UTF-8 become replacement characters."""
    parts = token_bytes(path)
    return b"".join([parts[i] for i in ids]).decode("utf-8", "replace")


def bpe_round_trip(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: ``(doc_id, ids, decoded)``.

    Null and empty texts have no ids and decode to the empty text. Rows with a null id are kept,
    repeated rows repeated, other columns ignored.
    """

    def finish(name: pa.Array, coded: list[bytes]) -> pa.RecordBatch:
        ids = [np.frombuffer(c, "<u4").astype(np.int32) for c in coded]
        return pa.RecordBatch.from_arrays([name, pa.array(ids, pa.list_(pa.int32())), pa.array([decode(i.tolist(), tokenizer) for i in ids])], ["doc_id", "ids", "decoded"])

    return _encoded(docs, tokenizer, id, text, finish, "ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``bpe_round_trip`` with digests in place of the ids and the decoded text, made where they arise.

    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: sha256 of the decimal ids joined by commas, and of
    the decoded text.
    """
    decimal = [str(i) for i in range(len(token_bytes(tokenizer)))]

    def finish(name: pa.Array, coded: list[bytes]) -> pa.RecordBatch:
        ids = [np.frombuffer(c, "<u4").tolist() for c in coded]
        listed = [hashlib.sha256(",".join([decimal[i] for i in own]).encode()).hexdigest() for own in ids]
        back = [hashlib.sha256(decode(own, tokenizer).encode()).hexdigest() for own in ids]
        return pa.RecordBatch.from_arrays([name, pa.array([len(own) for own in ids], pa.int64()), pa.array(listed), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, tokenizer, id, text, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(docs: DataFrame, tokenizer: str, id: str, text: str, finish, schema: str, rows_at_once: int = 256) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                yield finish(part.column(0), list(ids_of.all(t.as_py() for t in part.column(1))))
        ids_of.rest(forget=True)

    rows = picked(docs, id=id, text=text)
    return map_batches(rows, run, f"doc_id {rows.schema['id'].dataType.simpleString()}, {schema}")
