import hashlib
import random
import re
from collections import Counter

import pytest

from boxweave.llm.decontaminate import Search, contaminated, item_index, item_parts
from boxweave.llm.pii import Disclosure, personal_data, sanitised
from conftest_llm import odd_texts, prose

# The base patterns and the order of the kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PERSONAL = [
    "a@b", "a@b.c", "a@b.c@d.e", "x.y+z@mail.example.com.", "a@b..c@d.e", "@a.b", "é a@b.cé", "a@-.-", "a@b.c+d@e.f,g@h.i", "..@a.b", "a@b." + "c." * 300 + "d",
    "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.0000255", "1.2.3", "1..2.3.4", "99999999999999999999.1.1.1", "a1.2.3.4b",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "4539 1488 0343 6467 and 6011000990139424", "0" * 19, "0" * 20, "12 34",
    "+1 (415) 555-2671", "+49 30 901820", "+1", "+123456789", "+1234567890123456", "+1((((((", "+1 2 3 4 5 6 7 8 9 . 0 (", "++12345678901", "+4111 1111 1111 1111",
    "日本 a@b.c 😀 1.2.3.4 x", "call +1 415 555 2671 or 10.0.0.1, bob@x.org", "",
]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in PATTERNS.items()}


def test_base_spans_equal_the_patterns(spark, odd, none):
    rows = [(i, t) for i, t in enumerate(PERSONAL + [" ".join(PERSONAL), "\n".join(PERSONAL[::-1])])]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want, r = base(text), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want.values()], text
        listed = ",".join(s for v in want.values() for s in v)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed), text
    assert sorted(str(r.doc_id) for r in personal_data(odd).collect()) == sorted(str(i) for i, _ in odd_texts())
    assert personal_data(none).count() == 0


def test_long_runs_take_linear_time(spark):
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + "1.2.3.4 " * 2000
    r = personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_email, r.n_ip) == (0, 2000)


def test_terms_that_go_with_one_value_are_found_and_replaced(spark):
    rows = [(i, f"the walrus {i} dances near bob@x.org each {'monday' if i < 3 else 'friday'} " + prose(i, 20)) for i in range(6)] + [(i, f"each monday the {prose(i, 30)}") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = {r.doc_id: r for r in personal_data(df, rule=Disclosure(generalise=0.6)).collect()}
    text = dict(rows)
    for i in range(6):
        terms = {text[i][int(a):int(b)] for k, a, b in (s.split(":") for s in told[i].spans.split(",")) if k == "term"}
        assert {"walrus", "dances", "near"} <= terms and not terms & {"the", "monday", "each"}
    assert all(told[i].spans == "" for i in range(10, 60))
    clean = {r.doc_id: r.text for r in sanitised(df, rule=Disclosure(generalise=0.6)).collect()}
    assert all("walrus" not in clean[i] and "bob@x.org" not in clean[i] and "[EMAIL]" in clean[i] for i in range(6))
    assert all(clean[i] == text[i] for i in range(10, 60))


def test_share_of_information_by_hand(spark):
    from boxweave.llm.pii import base_spans, disclosing, term_frequencies
    from math import log
    rows = [(i, t) for i, t in enumerate(["zebra a@b.c", "zebra a@b.c", "zebra other", "plain other", "plain d@e.f", "plain", "more", "text"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.term, round(r.share, 9)) for r in disclosing(base_spans(df), term_frequencies(df), Disclosure(generalise=0.1)).collect()}
    assert got == {("zebra", round(log(2 * 8 / (3 * 2)) / log(8 / 2), 9))}


def test_overlapping_values_are_replaced_whole(spark):
    texts = ["+1.2.3.4.5.6.7.8.9", "1.2.3.4 1111 1111 1111 1117", "+49 1234 567890 x", "10.0.0.1 4111 1111 1111 1111"]
    for (_, got), text in zip(sorted((r.doc_id, r.text) for r in sanitised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()), texts):
        covered = {i for spans in base(text).values() for s in spans for i in range(*map(int, s.split(":")[1:]))}
        assert not covered or all(c not in got for c in ("".join(text[i] for i in sorted(covered)),)) and len(re.findall("[0-9]", got)) <= len(text) - len(covered)


def shingled(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])


def brute(docs, items, least=0.8):
    found = {}
    for i, item in items:
        own = shingled(item)
        for d, text in docs:
            all_runs = shingled(text)
            for at in range(len(all_runs) - len(own) + 1 if own else 0):
                common = sum((Counter(all_runs[at : at + len(own)]) & Counter(own)).values())
                similarity = common / (2 * len(own) - common)
                if similarity >= least:
                    found[d, i] = max(found.get((d, i), 0), similarity)
    return found


def test_decontamination_equals_all_windows(spark):
    items = [(i, prose(100 + i, 12 + 7 * i)) for i in range(6)] + [(6, "two words"), (7, None), (8, ""), (9, "a b c d e " * 8), (10, prose(100, 12))]
    docs = [(i, prose(i, 60)) for i in range(10)] + [(20, None), (21, ""), (22, "Two, WORDS!"), (23, "two words more"), (24, "a b c d e " * 20)]
    for n, (i, item) in enumerate(items[:6]):
        words = item.split()
        docs.append((30 + n, prose(n, 20) + " " + item.upper().replace(".", "!") + " " + prose(n + 50, 20)))
        docs.append((40 + n, item))
        docs.append((50 + n, " ".join([*words[:3], "changed", *words[4:]])))
        docs.append((60 + n, " ".join([*words[:-1], "ending", prose(n, 9)])))
        docs.append((70 + n, " ".join(words[len(words) // 2 :])))
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), Search(radius=24, blocks=5)).collect()}
    want = brute(docs, items)
    assert got == pytest.approx(want) and len(want) > 20


def test_long_items_are_searched_in_parts(spark):
    item, docs = prose(1, 70), [(1, prose(2, 30) + " " + prose(1, 70) + " " + prose(3, 30)), (2, prose(4, 90))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contaminated(*frames, Search(longest=32)).collect()] == [(1, 1)]


def test_index_holds_every_fingerprint_within_the_radius(spark):
    rule = Search(radius=4, blocks=3)
    parts = item_parts(spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string"), rule)
    code = parts.first().code & (2**64 - 1)
    rows = {(r.block, r.bits) for r in item_index(parts, rule).collect()}
    import random
    rng = random.Random(0)
    from boxweave.llm.decontaminate import block_masks
    for _ in range(200):
        near = code
        for b in rng.sample(range(64), rng.randrange(5)):
            near ^= 1 << b
        assert any((k, near >> s & ((1 << w) - 1)) in rows for k, (s, w) in enumerate(block_masks(3)))


def test_odd_rows_and_empty_tables(odd, none, spark):
    items = spark.createDataFrame([(1, prose(2, 80)), (2, prose(3, 20))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(odd, items).collect()} == {(1, 1), (5, 1), (6, 2), (13, 2)}
    assert contaminated(none, items).count() == 0
    assert contaminated(odd, items.limit(0)).count() == 0


def test_documents_shorter_than_the_item(spark):
    items = [(m, prose(200 + m, m)) for m in (40, 60)]
    docs = []
    for m, item in items:
        words = item.split()
        docs += [(m, " ".join(words[:-1])), (m + 1, " ".join(words[1:])), (m + 2, " ".join(words[: int(m * 0.7)]))]
    words = items[1][1].split()
    docs.append((99, " ".join(words[:30] + words[31:])))
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), Search(radius=24, blocks=5)).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == pytest.approx({(40, 40): 35 / 36, (41, 40): 35 / 36, (60, 60): 55 / 56, (61, 60): 55 / 56, (99, 60): 51 / 60})


def test_values_seen_once_have_disclosing_terms(spark):
    rows = [(i, f"the walrus writes to user{i}@zoo.org from 10.7.3.{i} " + prose(i, 20)) for i in range(4)] + [(i, f"the {prose(i, 30)}") for i in range(10, 60)]
    rows += [(70, "pelican writes to x@pond.org"), (71, "pelican writes to x@pond.org " + prose(8, 9)), (72, "stork near 172.16.0.1"), (73, "stork near 172.16.0.1")]
    told = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for i in range(4):
        assert "walrus" in {text[i][int(a):int(b)] for k, a, b in (s.split(":") for s in told[i].spans.split(",")) if k == "term"}
    assert all(told[i].n_term == 0 for i in range(10, 60))


def test_long_items_are_found_as_a_whole_only(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(517)]
    light, heavy = [*words], [*words]
    for i in range(20, 517, 60):
        light[i] = "changed"
    heavy[300:420] = [f"n{i}" for i in range(120)]  # one place, a quarter of the item: below the threshold
    place = [*words]
    place[300:340] = [f"n{i}" for i in range(40)]  # one place, little enough
    around = prose(71, 80)
    docs = [(1, f"{around} {' '.join(words[-5:])} {around}"), (2, f"{around} {' '.join(words)} {around}"), (3, f"{around} {' '.join(light)}"), (4, " ".join(heavy)), (5, " ".join(place)),
            (6, " ".join(words[:259])), (7, " ".join(words[:500])), (8, prose(72, 600))]
    items = spark.createDataFrame([(1, " ".join(words)), (2, prose(73, 30))], "item_id long, text string")
    got = {r.doc_id: r.similarity for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}

    def bag(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    own = bag(" ".join(words))
    want = {3: bag(" ".join(light)), 5: bag(" ".join(place)), 7: bag(" ".join(words[:500])), 2: own}
    assert got == pytest.approx({d: len(own & b) / len(own | b) for d, b in want.items()})
    with pytest.raises(ValueError):
        Search(longest=9000)
