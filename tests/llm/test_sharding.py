import hashlib
from collections import defaultdict

import pytest

from boxweave.llm.sharding import BITS, assign_shards
from conftest_llm import prose


def row_hash(doc, text):
    name = "" if doc is None else str(doc)
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16) << 28 | int(hashlib.md5(f"{name}\n{text or ''}".encode()).hexdigest()[:7], 16)


def by_splitting(rows, limit):
    """Buckets by splitting an oversized one on its next bit; copies of one row stay together."""
    done, todo = {}, [(0, "", rows)]
    while todo:
        bits, prefix, own = todo.pop()
        if sum(len((t or "").encode()) for _, t in own) <= limit or bits == BITS:
            done[prefix] = sorted(own, key=str)
        else:
            for bit in "01":
                part = [r for r in own if f"{row_hash(*r):060b}"[bits] == bit]
                if part:
                    todo.append((bits + 1, prefix + bit, part))
    return done


def placed(df, limit):
    out = defaultdict(list)
    for r in assign_shards(df, limit).collect():
        out[r.shard, r.page].append(r)
    return out


@pytest.mark.parametrize("limit", [500, 4000, 10**9])
def test_equals_splitting_bucket_by_bucket(spark, limit):
    rows = [(i, prose(i, 5 + i % 40)) for i in range(300)] + [(1000, None), (1001, ""), (1002, prose(3, 2000)), (None, "no id")]
    got = placed(spark.createDataFrame(rows, "doc_id long, text string"), limit)
    want = by_splitting(rows, limit)
    sizes = {p: sorted((str(i), len((t or "").encode())) for i, t in own) for p, own in want.items()}
    assert {p: sorted((str(r.doc_id), r.n_bytes) for r in own) for (p, _), own in got.items()} == sizes
    assert all(len(p) == r.bits for (p, _), own in got.items() for r in own)


def test_many_rows_of_one_id_are_split_by_their_text(spark):
    rows = [(7, prose(i, 20)) for i in range(100)]
    got = placed(spark.createDataFrame(rows, "doc_id long, text string"), 1000)
    assert sum(map(len, got.values())) == 100 and all(sum(r.n_bytes for r in own) <= 1000 for own in got.values())


def test_copies_of_one_row_fill_pages(spark):
    text = "x" * 100
    got = placed(spark.createDataFrame([(7, text)] * 57 + [(8, "y" * 5000)] * 2, "doc_id long, text string"), 1000)
    pages = sorted(len(own) for (_, _), own in got.items() if own[0].doc_id == 7)
    assert pages == [7, 10, 10, 10, 10, 10]
    assert sorted(len(own) for own in got.values() if own[0].doc_id == 8) == [1, 1]


def test_odd_rows_and_none(odd, none):
    assert assign_shards(odd, 2000).count() == odd.count()
    assert assign_shards(none, 2000).count() == 0
