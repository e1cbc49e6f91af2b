"""Token counts of the sections of a document, from one encoding of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxweave.llm.common import map_batches, picked
from boxweave.llm.pretokens import library_encoder, token_bytes

#: Rows of sections sent on at a time.
SENT = 50_000


def section_ends(data: bytes, mark: bytes = b"\n") -> np.ndarray:
    """Byte ends of the sections of a text: each ends after ``mark``, the last with the text."""
    if len(mark) == 1:
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == mark[0]) + 1
    else:
        found, at = [], data.find(mark)
        while at >= 0:
            found.append(at + len(mark))
            at = data.find(mark, at + len(mark))
        ends = np.array(found, np.int64)
    return ends if len(ends) and ends[-1] == len(data) else np.r_[ends, len(data)]


def allocated(widths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and how many of them cross a boundary.

    Tokens and sections both tile the text in order, so their interval join is two searches in
    sorted ends. A token across a boundary goes to the section that holds most of its bytes, and to
    the earliest of these on a tie.
    """
    token_ends = np.cumsum(widths)
    starts = token_ends - widths
    first = np.searchsorted(ends, starts, "right")
    last = np.searchsorted(ends, token_ends, "left")
    owner = first.copy()
    crossing = np.flatnonzero(last > first)
    for i in crossing:
        over = np.arange(first[i], last[i] + 1)
        held = np.minimum(ends[over], token_ends[i]) - np.maximum(np.r_[0, ends][over], starts[i])
        owner[i] = over[np.argmax(held)]
    n = len(ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", mark: str = "\n") -> DataFrame:
    """Tokens of every section of every document.

    ``(doc_id, section, char_start, char_end, n_tokens, n_crossing)``; sections are the lines of a
    text with their ends, or what ``mark`` ends. A whole document is encoded once and each token is
    given to exactly one section (see ``allocated``), so a document's sections add up to its tokens.
    ``n_crossing`` counts the tokens of a section that reach into another. A null or empty text has
    one section without tokens; rows with a null id are kept, repeated rows repeated, other
    columns ignored.
    """
    stop = mark.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, widths = library_encoder(tokenizer), np.array([len(b) for b in token_bytes(tokenizer)], np.int64)
        names = ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"]
        for batch in batches:
            row, out, held = [], [], 0

            def block() -> pa.RecordBatch:
                table = np.concatenate(out, axis=1)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(row))), *(pa.array(c) for c in table)], names)

            for i, (value, coded) in enumerate(zip(batch.column(1), ids_of.all(t.as_py() for t in batch.column(1)))):
                data = (value.as_py() or "").encode("utf-8")
                ids = np.frombuffer(coded, "<u4")
                ends = section_ends(data, stop)
                counts, crossing = allocated(widths[ids], ends)
                chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) if data else np.zeros(0, np.int64)
                char_ends = np.r_[0, chars][ends]
                out.append(np.stack([np.arange(len(ends)), np.r_[0, char_ends[:-1]], char_ends, counts, crossing]))
                row.append(np.full(len(ends), i))
                held += len(ends)
                if held >= SENT:
                    yield block()
                    row, out, held = [], [], 0
            if out:
                yield block()
        ids_of.rest()

    rows = picked(docs, id=id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, section long, char_start long, char_end long, n_tokens long, n_crossing long")
