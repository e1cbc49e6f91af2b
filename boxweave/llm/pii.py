"""Personal data, and the terms that give it away.

The base finds values of four kinds by pattern. The method then asks what else reveals them: for a
protected value e (an address, a number) and a term t that occurs near it, the corpus gives the
pointwise mutual information log p(t, e) / (p(t) p(e)). Divided by the information of the value,
-log p(e), this is the share of it that the term discloses: 1 where the term occurs with the value
only, 0 where they are independent. Terms above a first threshold are generalised, above a
second removed. Everything here is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxweave.functions.staged import staged
from boxweave.llm.common import picked, stored
from boxweave.llm.native import lengths, row_key, running

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Possessive forms of the base patterns: they match the same and never go back. An address
#: begins where a run of its letters does, or where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
WORDS = r"[\p{L}\p{N}]{3,}"
SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Disclosure:
    """When a term gives a value away.

    ``reach``: characters on each side of a value that count as near; ``support``: documents in which
    term and value must meet; ``generalise``, ``remove``: shares of the value's information.
    """

    reach: int = 120
    support: int = 2
    generalise: float = 0.7
    remove: float = 0.95


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    back = F.reverse(digits)
    each = F.transform(places, lambda i: F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _normal(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_replace(value, r"(^|\.)0+(?=[0-9])", "$1")
    return F.lower(value) if kind == "email" else _digits(value)


def matched(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with, per kind, ``<kind>_hit`` (matches of the pattern) and ``<kind>_gap`` (what lies between)."""
    columns = {}
    for kind in KINDS:
        tried = F.contains(F.col(text), F.lit(HINTS[kind])) if kind in HINTS else F.col(text).rlike("[0-9][ -]?[0-9]")
        columns[f"{kind}_hit"] = F.when(tried, F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = staged(docs, columns)
    gaps = {f"{k}_gap": F.when(F.size(f"{k}_hit") > 0, F.split(F.col(text), PATTERNS[k], -1)).otherwise(F.array().cast("array<string>")) for k in KINDS}
    return staged(found, gaps)


def _spans(kind: str) -> Column:
    """Spans of the valid matches of a kind, in code points."""
    hit, gap = F.col(f"{kind}_hit"), F.col(f"{kind}_gap")
    ends = running(F.zip_with(lengths(F.slice(gap, 1, F.size(hit))), lengths(hit), lambda a, b: a + b))
    all_spans = F.zip_with(hit, ends, lambda m, e: F.struct(F.lit(KINDS.index(kind)).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), _valid(kind, m).alias("ok")))
    kept = F.transform(F.filter(all_spans, lambda s: s.ok), lambda s: F.struct(s.kind, s.start, s.end))
    return F.when(F.size(hit) > 0, kept).otherwise(F.array().cast(SPANS))


def _contexts(kind: str, reach: int) -> Column:
    """Values of a kind with the terms near each."""
    hit, gap = F.col(f"{kind}_hit"), F.col(f"{kind}_gap")

    def near(i: Column) -> Column:
        before, after = F.get(gap, i), F.get(gap, i + 1)
        left = F.when(F.length(before) > reach, F.regexp_replace(F.right(before, F.lit(reach)), r"^[\p{L}\p{N}]+", "")).otherwise(before)
        right = F.when(F.length(after) > reach, F.regexp_replace(F.left(after, F.lit(reach)), r"[\p{L}\p{N}]+$", "")).otherwise(after)
        words = F.regexp_extract_all(F.lower(F.concat_ws(" ", left, right)), F.lit(WORDS), F.lit(0))
        return F.struct(F.concat(F.lit(f"{kind}:"), _normal(kind, F.get(hit, i))).alias("value"), F.array_distinct(words).alias("terms"))

    valid = F.filter(F.sequence(F.lit(0), F.size(hit) - 1), lambda i: _valid(kind, F.get(hit, i)))
    return F.when(F.size(hit) > 0, F.transform(valid, near)).otherwise(F.array().cast("array<struct<value:string,terms:array<string>>>"))


def base_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", reach: int = 120) -> DataFrame:
    """``(key, id, spans, contexts, body)`` of every row; ``body`` is the text where it has spans."""
    rows = picked(docs, id=id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    rows = matched(rows.withColumn("key", row_key("id", "text")))
    found = staged(rows, {"spans": F.concat(*[_spans(k) for k in KINDS]), "contexts": F.concat(*[_contexts(k, reach) for k in KINDS])})
    return found.select("key", "id", "spans", "contexts", F.when(F.size("spans") > 0, F.col("text")).alias("body"))


def term_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(term, documents)``: in how many rows each term occurs."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(docs[text]), F.lit(WORDS), F.lit(0)))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("documents"))


def _pools(value: Column) -> Column:
    """A value, what it belongs to (mail domain, network, prefix of a number) and its kind."""
    kind = F.substring_index(value, ":", 1)
    part = F.when(kind == "email", F.concat(F.lit("email:@"), F.substring_index(value, "@", -1)))
    part = part.when(kind == "ip", F.concat(F.substring_index(value, ".", 3), F.lit(".*")))
    return F.array(value, part.otherwise(F.concat(F.left(value, F.length(kind) + 7), F.lit("*"))), kind)


def disclosing(found: DataFrame, frequencies: DataFrame, rule: Disclosure) -> DataFrame:
    """``(key, term, share)``: terms that give a value away, in each row that holds the value.

    ``found`` are the rows of ``base_spans``. Counts are of rows; a row counts once for a
    value and once for a term near it. A value seen once has no estimate of its own, so those of its
    pools (see ``_pools``) count as well; there, term and pool must meet in ``support`` different texts. The
    greatest share counts. Pairs are formed near a value only, and pre-aggregated before they are dealt out.
    """
    total_rows = float(max(1, found.count()))
    held = found.where("size(contexts) > 0").select("key", F.xxhash64("body").alias("copy"), F.explode("contexts").alias("c"))
    near = held.select("key", "copy", F.explode(_pools(F.col("c.value"))).alias("pool"), "c.terms")
    # one row of a pool and a row of the table, so that a term counts once
    counted = found.where("size(contexts) > 0").select(F.xxhash64("body").alias("copy"), "contexts")
    counted = counted.select("copy", "contexts", F.explode(F.array_distinct(F.flatten(F.transform("contexts", lambda c: _pools(c.value))))).alias("pool"))
    merged = F.array_distinct(F.flatten(F.transform(F.filter("contexts", lambda c: F.array_contains(_pools(c.value), F.col("pool"))), lambda c: c.terms)))
    counted = counted.select("copy", "pool", F.filter("contexts", lambda c: c.value == F.col("pool")).alias("own"), merged.alias("terms"))
    sizes = counted.groupBy("pool").agg(F.count("*").alias("with_pool"))
    pairs = counted.select("pool", "copy", (F.size("own") > 0).alias("exact"), F.explode("terms").alias("term")).groupBy("pool", "term", "exact", "copy").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("pool", "term", "exact").agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    pairs = pairs.where(F.when(F.col("exact"), F.col("both")).otherwise(F.col("texts")) >= rule.support).join(sizes, "pool").join(frequencies, "term")
    information = F.log(F.lit(total_rows) / F.col("with_pool"))
    share = F.log(F.col("both") * F.lit(total_rows) / (F.col("documents") * F.col("with_pool"))) / F.nullif(information, F.lit(0.0))
    telling = stored(pairs.select("pool", "term", share.alias("share")).where(F.col("share") >= rule.generalise), "telling")
    exploded = near.select("key", "pool", F.explode("terms").alias("term")).distinct()
    return exploded.join(telling, ["pool", "term"]).groupBy("key", "term").agg(F.max("share").alias("share"))


def term_spans(found: DataFrame, terms: DataFrame) -> DataFrame:
    """``(key, extra)``: spans of all occurrences of a row's disclosing terms outside its base spans."""
    listed = terms.groupBy("key").agg(F.collect_set("term").alias("terms"))
    rows = found.where("body IS NOT NULL").dropDuplicates(["key"]).select("key", "body", "spans").join(listed, "key")
    cut = staged(rows, {"hit": F.regexp_extract_all("body", F.lit(WORDS), F.lit(0)), "gap": F.split("body", WORDS, -1)})
    ends = running(F.zip_with(lengths(F.slice("gap", 1, F.size("hit"))), lengths(F.col("hit")), lambda a, b: a + b))
    cut = staged(cut, {"ends": ends})
    words = F.zip_with("hit", "ends", lambda w, e: F.struct(w.alias("word"), e.alias("end")))
    own = F.filter(words, lambda w: F.array_contains("terms", F.lower(w.word)))
    placed = F.transform(own, lambda w: F.struct(F.lit(len(KINDS)).alias("kind"), (w.end - F.length(w.word)).alias("start"), w.end.alias("end")))
    free = F.filter(placed, lambda w: ~F.exists("spans", lambda s: (s.start < w.end) & (s.end > w.start)))
    return cut.select("key", free.alias("extra"))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")


def _any_valid(kind: str) -> Column:
    return F.exists(f"{kind}_hit", lambda m: _valid(kind, m))


def _marked(kind: str) -> Column:
    """Matches of a kind, the valid ones as its name in brackets."""
    return F.transform("hit", lambda m: F.when(_valid(kind, m), f"[{kind.upper()}]").otherwise(m))


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: Disclosure = Disclosure()) -> DataFrame:
    """Spans of personal data and of disclosing terms in every row.

    ``(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans)``; ``spans`` lists all as
    ``kind:start:end`` in code points, by kind, then start. Null and empty texts have none. Equal rows
    get equal results and each is returned; rows with a null id are kept; other columns are
    ignored; an empty table gives an empty one.
    """
    found = stored(base_spans(docs, id, text, rule.reach), "spans")
    terms = disclosing(found, term_frequencies(docs, text), rule)
    extra = stored(term_spans(found, terms), "terms")
    rows = found.select("key", "id", "spans").join(extra, "key", "left")
    every = F.concat("spans", F.coalesce("extra", F.array().cast(SPANS)))
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_term"),
        F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
    )


def sanitised(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in ``text``.

    A value becomes the name of its kind in brackets. A term that discloses a value of its row
    is removed from the row where its share reaches ``rule.remove``; otherwise it is generalised to
    ``[number]``, ``[name]`` (a capital first) or ``[word]``. Rows without personal data are returned as they
    are, and never leave their partition; null texts stay null.
    """
    found = stored(base_spans(docs, id, text, rule.reach), "spans")
    terms = disclosing(found, term_frequencies(docs, text), rule)
    listed = stored(terms.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares")), "terms")
    own = [f"own{i}" for i in range(len(docs.columns))]
    place, name = f"own{docs.columns.index(text)}", f"own{docs.columns.index(id)}"
    rows = docs.toDF(*own).withColumns({"body": F.coalesce(place, F.lit("")), "id": F.col(name)})
    held = staged(matched(rows, "body"), {"held": reduce(or_, [_any_valid(k) for k in KINDS])})
    clean = held.where("NOT held").select(*own)
    told = held.where("held").withColumn("key", row_key("id", "body")).join(listed, "key", "left")
    told = staged(told, {"spans": F.array_sort(F.transform(F.concat(*[_spans(k) for k in KINDS]), lambda s: F.struct(s.start, s.end, s.kind)))})
    crossing = F.exists(F.sequence(F.lit(1), F.size("spans")), lambda i: F.coalesce(F.get("spans", i - 1).end > F.get("spans", i).start, F.lit(False)))
    told = staged(told, {"crossing": crossing}).select(*own, "shares", "body", "spans", "crossing")
    apart, crossed = _marked_in_turn(told.where("NOT crossing")), staged(told.where("crossing"), {"body": _marked_at(F.col("body"), F.col("spans"))})
    marks = rf"\[(?:{'|'.join(k.upper() for k in KINDS)})\]|{WORDS}"
    out = staged(apart.unionByName(crossed), {"hit": F.regexp_extract_all("body", F.lit(marks), F.lit(0)), "gap": F.split("body", marks, -1)})
    share = lambda w: F.try_element_at("shares", F.lower(w))
    general = lambda w: F.when(w.rlike(r"^\p{N}+$"), "[number]").when(w.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
    shown = F.transform("hit", lambda w: F.when(w.startswith("[") | share(w).isNull(), w).when(share(w) >= rule.remove, "").otherwise(general(w)))
    out = staged(out, {"body": F.when(F.col("shares").isNull(), F.col("body")).otherwise(_woven(F.col("gap"), shown))})
    return clean.unionByName(out.withColumn(place, F.col("body")).select(*own)).toDF(*docs.columns)


def _marked_in_turn(rows: DataFrame) -> DataFrame:
    """``body`` with the values replaced kind by kind; for rows whose spans do not overlap."""
    for kind in KINDS:
        rows = staged(rows, {"hit": F.regexp_extract_all("body", F.lit(PATTERNS[kind]), F.lit(0)), "gap": F.split("body", PATTERNS[kind], -1)})
        rows = staged(rows, {"body": _woven(F.col("gap"), _marked(kind))})
    return rows.drop("hit", "gap")


def _marked_at(text: Column, spans: Column) -> Column:
    """``text`` with its sorted spans replaced; spans that overlap become one mark."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        apart = s.start >= a.at
        piece = F.concat(a.out, F.substr(text, (a.at + 1).cast("int"), (s.start - a.at).cast("int")), F.get(names, s.kind))
        return F.struct(F.greatest(a.at, s.end).alias("at"), F.when(apart, piece).otherwise(a.out).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a.out, F.substr(text, (a.at + 1).cast("int"), F.length(text))))


def _woven(gaps: Column, marks: Column) -> Column:
    """Gaps and marks in turn, as one text."""
    return F.array_join(F.flatten(F.zip_with(gaps, marks, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
