import random

import numpy as np
import xxhash

from boxweave.llm import trie
from boxweave.llm.components import components
from boxweave.llm.simhash import fingerprint, near_codes, near_duplicates, representatives
from conftest_llm import odd_texts, prose


def plain(text, words):
    parts = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    runs = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([b" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(codes, radius):
    """Smallest index reachable from each code over all pairs, by plain search."""
    seen = [None] * len(codes)
    for i in range(len(codes)):
        if seen[i] is None:
            seen[i], todo = i, [i]
            while todo:
                x = todo.pop()
                for y in range(len(codes)):
                    if seen[y] is None and (codes[x] ^ codes[y]).bit_count() <= radius:
                        seen[y] = i
                        todo.append(y)
    return seen


def test_fingerprint_equals_plain_count():
    for _, text in odd_texts():
        for words in (1, 4, 5):
            if len(text or "") < 10_000:
                assert fingerprint(text, words) == plain(text, words)


def near_family(n, seed=0):
    rng = random.Random(seed)
    codes = {0, 2**64 - 1}
    while len(codes) < n:
        base = rng.choice(sorted(codes)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(7)):
            base ^= 1 << rng.randrange(64)
        codes.add(base)
    return sorted(codes)


def test_trie_finds_all_pairs():
    for radius in (0, 1, 4, 7):
        codes = np.array(near_family(400, radius), np.uint64)
        a, b = trie.joined(np.zeros(len(codes), int), codes, radius)
        want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (int(codes[i]) ^ int(codes[j])).bit_count() <= radius}
        assert len(a) == len(want) and {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())} == want


def test_links_keep_components_even_with_tiny_groups(spark):
    codes = near_family(500, 5)
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    for group in (4, 64, 1024):
        found = {r.a: r.b for r in components(near_codes(df, 4, group)).collect()}
        got = [found.get(s, s) for s in signed]
        want = classes(codes, 4)
        least = {}
        for i, w in enumerate(want):
            least[w] = min(least.get(w, signed[i]), signed[i])
        assert got == [least[w] for w in want]


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(1399, 2000)]
    found = {r.a: r.b for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {i: 1000 for i in [*range(1001, 1400), 2000]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(odd, none):
    rows = near_duplicates(odd).collect()
    texts = odd_texts()
    assert len(rows) == len(texts)
    codes = [plain(t, 4) if len(t or "") < 10_000 else fingerprint(t, 4) for _, t in texts]
    root = classes(codes, 4)
    want = sorted((str(i), f"{c:016x}", str(min((j for (j, _), r in zip(texts, root) if r == root[k] and j is not None), default=None))) for k, ((i, _), c) in enumerate(zip(texts, codes)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want
    assert near_duplicates(none).count() == 0


def test_one_row_of_each_class_stays(spark, odd, none):
    kept = representatives(odd, words=4, distinct=False).collect()
    ids = sorted(str(r.doc_id) for r in kept)
    classes_kept = {str(r.component_id) for r in near_duplicates(odd).collect()}
    assert len(ids) == len(set(ids)) and set(ids) == classes_kept
    assert kept[0].asDict().keys() == set(odd.columns)
    assert representatives(none).count() == 0


def test_changed_words_are_near_and_others_are_not(spark):
    base = prose(7, 300).split()
    edited = [*base]
    edited[40] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, prose(8, 300)), (4, prose(9, 300))]
    kept = representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4]


def test_only_texts_of_similar_shingles_link(spark):
    def changed(base, n):
        return [f"new{i}" if i % (len(base) // n) == 10 and i // (len(base) // n) < n else w for i, w in enumerate(base)]

    rng = random.Random(4)
    base = [f"word{rng.randrange(10**6)}" for _ in range(450)]
    moved = base[225:] + base[:225]  # all single words the same, 4 of 450 shingles others
    mixed = [*base]
    rng.shuffle(mixed)  # all single words the same, no shingle
    rows = [(1, base), (2, changed(base, 9)), (3, changed(base, 12)), (4, mixed), (5, moved), (6, changed(base, 9) + ["end"] * 9), (7, base[:360]), (8, base[:350])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    near = {i: {j for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    left, kept = set(sets), set()
    while left:
        todo = {min(left)}
        kept |= todo
        while todo:
            left -= todo
            todo = set().union(*(near[i] for i in todo)) & left
    assert {3, 4} <= kept and {2, 5} & kept == set()
    assert {r.doc_id for r in representatives(df).collect()} == kept


def test_classes_equal_all_pairs(spark):
    rng = random.Random(6)
    texts = []
    for family in range(12):
        base = prose(family, rng.randrange(1, 200)).split()
        for _ in range(8):
            texts.append(" ".join(w if rng.random() > 0.02 else f"x{rng.randrange(50)}" for w in base) + " the same long line below all of them" * (family % 2))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    kept = representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == set(root) and len(kept) < len(texts)
