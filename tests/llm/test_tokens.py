import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from boxweave.llm import bpe, dac
from boxweave.llm.pretokens import library_encoder, token_bytes
from boxweave.llm.token_counts import allocated, section_ends, section_tokens
from boxweave.llm.token_store import read_tokens, tokens_at, write_tokens
from conftest_llm import odd_texts, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "\n", "\n\n", " \n ", "a b", "a  b", "a \nb", "a\n b", "a\n\nb", "\ta", "a\t b", "a b", " a b", "it's we'll I'M", "x.y,z!", "...", "a.b ", "naïve façade", "日本語 です", "😀😀 👩‍👩‍👧",
    "1234567 ½ Ⅷ ²", "<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> b <|endoftext|><|endoftext|>", "<|endoftext", "a\0b \0 c", "\0", "__init__ a_b", "aaaa" * 40, " " * 100, "é" * 70, "word " * 50, "\r\n x\r\n", "\x1c\x85 q", "é ́",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("make", [library_encoder, bpe.encoder])
def test_encoders_equal_the_library(library, make):
    texts = TEXTS + [prose(i, 60) for i in range(20)] + [t for _, t in odd_texts()]
    for text, coded in zip(texts, make(PATH).all(texts)):
        assert np.frombuffer(coded, "<u4").tolist() == ids_of(library, text), repr(text)[:80]


def test_memory_that_turns_over_changes_nothing(library):
    small = bpe.Encoder(bpe.Merges(PATH).encode, {}, size=5)
    texts = [prose(i % 7, 40) for i in range(30)]
    assert [np.frombuffer(small(t), "<u4").tolist() for t in texts] == [ids_of(library, t) for t in texts]


def test_long_and_short_pieces_merge_alike():
    merges = bpe.Merges(PATH)
    pieces = ["the", " the", "a", "antidisestablishmentarianism", "é", "zzzzzzzz", " international"]
    for piece, coded in zip(pieces, merges.encode(pieces)):
        assert merges.alone(merges.byte_ids[list(piece.encode())].tolist()) == np.frombuffer(coded, "<u4").tolist()


def test_decode_replaces_what_is_no_text(library):
    ids = [ids_of(library, "é")[0], 220, 50256] + ids_of(library, "日")[:1]
    parts = token_bytes(PATH)
    for cut in (ids, [parts.index(b"\xc3")], [parts.index(b"\xe6"), parts.index(b"a")]):
        assert bpe.decode(cut, PATH) == library.decode(cut, skip_special_tokens=False)


def test_round_trip_of_odd_rows(library, odd, none):
    rows = bpe.bpe_digests(odd, PATH).collect()
    texts = odd_texts()
    want = sorted((str(i), len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts for x in [ids_of(library, t)])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert all(r.decoded == bpe.decode(r.ids, PATH) for r in bpe.bpe_round_trip(odd, PATH).collect())
    assert bpe.bpe_digests(none, PATH).count() == 0


@pytest.mark.parametrize("top", [1, 200, 300, 70_000, 2**32 - 1])
def test_codes_give_back_every_id_at_random(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.integers(0, top + 1, n).astype("<u4") >> rng.integers(0, 24, n).astype("<u4")
        codes = dac.Codes(dac.encode(ids))
        assert len(codes) == n and codes.slice(0, n).tolist() == ids.tolist()
        for i in rng.integers(0, n, 50) if n else []:
            assert codes[int(i)] == ids[i]
            j = int(rng.integers(i, n))
            assert codes.slice(int(i), j).tolist() == ids[i:j].tolist()


@pytest.mark.parametrize("segment", [3, 200, 10**6])
def test_store_in_order_of_the_documents(library, odd, none, segment):
    segments = write_tokens(odd, PATH, end_id=2, segment=segment)
    rows = sorted(read_tokens(segments).collect(), key=lambda r: r.start)
    at = 0
    ordered = sorted(odd_texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [r.doc_id for r in rows] == [i for i, _ in ordered]
    for row, (_, text) in zip(rows, ordered):
        ids = ids_of(library, text) + [2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert read_tokens(write_tokens(none, PATH, end_id=2)).count() == 0


def test_single_tokens_are_read_in_place(spark, library, odd):
    segments = write_tokens(odd.where("doc_id IN (1, 9, 12)"), PATH, end_id=2, segment=500)
    wanted = [(1, 0), (1, 17), (9, 12_345), (12, 3), (12, 10**6), (99, 0), (1, -1)]
    got = {(r.doc_id, r.position): r.token for r in tokens_at(segments, spark.createDataFrame(wanted, "doc_id long, position int")).collect()}
    texts = dict(odd_texts())
    assert got == {(d, p): ids_of(library, texts[d])[p] for d, p in wanted[:4]}


def by_hand(library, text, mark="\n"):
    """Tokens of each line, from the library's tokens and one look at each byte."""
    data, owner, line = text.encode(), [], 0
    for i, b in enumerate(data):
        owner.append(line)
        line += data[max(0, i + 1 - len(mark.encode())) : i + 1] == mark.encode()
    counts, at = [0] * (max(owner, default=0) + 1), 0
    parts = token_bytes(PATH)
    for t in ids_of(library, text):
        own = owner[at : at + len(parts[t])]
        counts[max(sorted(set(own)), key=own.count)] += 1
        at += len(parts[t])
    return counts


def test_sections_add_up(spark, library, odd, none):
    got, texts = {}, {i: t for i, t in odd_texts() if i is not None}
    for r in section_tokens(spark.createDataFrame(list(texts.items()), odd.select("doc_id", "text").schema), PATH).collect():
        got.setdefault(r.doc_id, {})[r.section] = r
    assert got.keys() == texts.keys()
    for doc, sections in got.items():
        text = texts[doc] or ""
        rows = [sections[k] for k in sorted(sections)]
        assert [r.n_tokens for r in rows] == by_hand(library, text)
        assert "".join(text[r.char_start : r.char_end] for r in rows) == text
    assert section_tokens(none, PATH).count() == 0


def test_crossing_tokens_go_where_most_bytes_are():
    assert [c.tolist() for c in allocated(np.array([2, 3, 1]), np.array([1, 4, 6]))] == [[1, 1, 1], [1, 1, 0]]
    assert [c.tolist() for c in allocated(np.array([], int), np.array([0]))] == [[0], [0]]
    assert section_ends(b"ab##c##", b"##").tolist() == [4, 7]
