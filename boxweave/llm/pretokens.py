"""Splitting text for byte-level BPE, with a bounded memory of what was encoded before.

Byte-level BPE merges within pre-tokens only, and a pre-token holds a space at its start only. So
where words are separated by single spaces, no pre-token reaches from one into the next: a text is
cut at these with plain string methods, and each distinct word, with the space before it, is
encoded once while it is remembered. Any other white space around a space sends the text
through the pattern itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import regex
import tokenizers

# Fixed value: the pattern that byte-level BPE splits text with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SPLIT = regex.compile(PATTERN)
STOPS = (".", ",", ";", ":", "!", "?")
#: Words and pre-tokens remembered per generation; two generations are held.
REMEMBERED = 400_000
#: Characters of text whose new words are encoded together.
GROUP = 100_000


class Memory:
    """What was computed lately: two generations of about ``size`` entries.

    When the young generation is full it becomes the old one; what is used again moves back.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes | None]], size: int):
        self.compute, self.size, self.young, self.old = compute, size, {}, {}

    def look(self, keys: Iterable[str]) -> dict[str, bytes | None]:
        """A small dict of just ``keys``, which stays in the processor's caches; missing ones are computed together."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        wanted = dict.fromkeys(keys)
        lacking = list(filterfalse(self.young.__contains__, wanted))
        fresh = [k for k in lacking if k not in self.old]
        self.young.update((k, self.old[k]) for k in lacking if k in self.old)
        self.young.update(zip(fresh, self.compute(fresh)))
        return dict(zip(wanted, map(self.young.__getitem__, wanted)))


def units(text: str) -> list[str]:
    """``text`` cut at its spaces; the first unit, which has no space before it, is marked."""
    return ("\0" + text).split(" ")


def stands_alone(unit: str) -> bool:
    """Whether a unit with the space before it is encoded the same without its neighbours: no white space at its ends."""
    return unit not in ("", "\0") and not unit.lstrip("\0")[0].isspace() and not unit[-1].isspace()


def pieces(unit: str) -> list[str]:
    """Pre-tokens of a unit that stands alone."""
    return SPLIT.findall(unit[1:] if unit[0] == "\0" else " " + unit)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    ``encode_pieces`` gives the ids of pre-tokens, many at a time, ``encode_words`` those of words of letters with a space before
    each. Special tokens of the vocabulary that occur in a text become their id, as the library does by default.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], specials: dict[str, int], size: int = REMEMBERED,
                 encode_words: Callable[[list[str]], list[bytes]] | None = None):
        self.encode_words = encode_words or (lambda words: encode_pieces([" " + w for w in words]))
        self.specials = {k: v.to_bytes(4, "little") for k, v in specials.items()}
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) or r"(?!)")
        self.piece, self.unit = Memory(encode_pieces, size), Memory(self._units, size)

    def __call__(self, text: str | None) -> bytes:
        return next(self.all([text]))

    def all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn; new words of a group of texts are encoded together."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size > GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def rest(self, forget: bool = False) -> None:
        """Called at the end of a task: an idle worker holds one generation only, or nothing."""
        for memory in (self.piece, self.unit):
            memory.old = {}
            if forget:
                memory.young = {}

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        plain = [not ("\0" in t or any(s in t for s in self.specials)) for t in texts]
        cut = [units(t) if t and p else [] for t, p in zip(texts, plain)]
        known = self.unit.look(chain.from_iterable(cut))
        for text, ok, words in zip(texts, plain, cut):
            try:
                yield b"".join(map(known.__getitem__, words)) if ok else b"".join(self._between(text))
            except TypeError:  # a word that does not stand alone
                yield self._whole(text)

    def _between(self, text: str) -> Iterator[bytes]:
        at = 0
        for m in self.special.finditer(text):
            yield self._whole(text[at : m.start()])
            yield self.specials[m.group()]
            at = m.end()
        yield self._whole(text[at:])

    def _whole(self, text: str) -> bytes:
        parts = SPLIT.findall(text)
        return b"".join(map(self.piece.look(parts).__getitem__, parts))

    def _units(self, units: list[str]) -> list[bytes | None]:
        """Letters are a word, letters and a stop after them a word and the stop; other units go through the pattern."""
        young, old = self.unit.young, self.unit.old
        fresh, stems, odd = {}, {}, {}
        for u in units:
            if u.isalpha():
                fresh[u] = None
            elif u[-1:] in STOPS and u[:-1].isalpha():
                stems[u] = u[:-1]
            else:
                odd[u] = pieces(u) if stands_alone(u) else ()
        fresh.update((w, None) for w in stems.values() if w not in young and w not in old)
        words = dict(zip(fresh, self.encode_words(list(fresh))))
        young.update(words)
        known = self.piece.look(chain(STOPS, chain.from_iterable(odd.values())))
        words.update((u, (young.get(w) or old[w]) + known[u[-1]]) for u, w in stems.items())
        words.update((u, b"".join(map(known.__getitem__, ps)) if ps else None) for u, ps in odd.items())
        return [words[u] for u in units]


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def library_tokenizer(path: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_tokens(path: str) -> dict[str, int]:
    """Special tokens of a vocabulary file and their ids."""
    return {t.content: i for i, t in library_tokenizer(path).get_added_tokens_decoder().items()}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[bytes, ...]:
    """The bytes of each id."""
    tok, letters = library_tokenizer(path), {c: b for b, c in byte_letters().items()}
    own = {i: content.encode() for content, i in special_tokens(path).items()}
    names = [tok.id_to_token(i) for i in range(tok.get_vocab_size())]
    return tuple(own[i] if i in own else bytes(letters[c] for c in name) for i, name in enumerate(names))


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """Encoder whose pre-tokens go through the BPE model of the tokenizers library.

    One per worker process, so its memory serves all tasks the process runs.
    """
    tokenizer, letters = library_tokenizer(path), byte_letters()
    spaced = np.array([b[:1] == b" " for b in token_bytes(path)])

    def one(piece: str) -> bytes:
        spelled = piece.encode("utf-8").decode("latin-1").translate(letters)
        return b"".join([t.id.to_bytes(4, "little") for t in tokenizer.model.tokenize(spelled)])

    def encode_words(words: list[str]) -> list[bytes]:
        """All words in one text, in which each begins with its space."""
        if not words:
            return []
        ids = np.array(tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        data, at = ids.tobytes(), (np.flatnonzero(spaced[ids]) * 4).tolist()
        return [data[a:b] for a, b in zip(at, [*at[1:], len(data)])]

    return Encoder(lambda pieces: list(map(one, pieces)), special_tokens(path), encode_words=encode_words)
