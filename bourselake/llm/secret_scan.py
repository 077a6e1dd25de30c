"""Secrets by a trigram inverted index: Boolean trigram queries from the rules, postings intersected, candidates verified.

The index lists, for each trigram that a rule asks for, the documents that hold it, in segments of bounded size. A rule's query
is derived from its regular expression; a document outside the result cannot match. Rules without mandatory trigrams scan
every text. All of it is DataFrame functions; only the derivation, a few dozen steps for each rule, is Python on the driver.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product
from re import _constants as parts
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents in a segment of the index, about.
SEGMENT = 8192
#: So many texts that a stretch of a rule can stand for are carried on, and classes of so many characters spelled out.
MOST_TEXTS, MOST_CHARACTERS = 64, 8


class Rule(NamedTuple):
    """A kind of secret: what ``group`` of a match of ``pattern`` holds has ``least`` characters or more; other matches drop.

    Patterns are in the part of the language that Java's and Python's engines share, and match ASCII letters only.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


#: Fixed kinds and patterns.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

#: Further kinds, by the published formats of their issuers.
MORE = (
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._~%!$&'*+,;=-]+:[A-Za-z0-9._~%!$&'*+,;=-]+@"),
)

#: A query over trigrams: True (any document), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def _all(*queries: Query) -> Query:
    each = dict.fromkeys(q for x in queries if x is not True for q in (x[1:] if x[0] == "and" else [x]))
    return True if not each else next(iter(each)) if len(each) == 1 else ("and", *each)


def _held(texts: set[str]) -> Query:
    """What a document that holds one of the texts holds; what another text asks for as well, and more, is left out."""
    if any(len(t) < 3 for t in texts):
        return True
    asked = {t: dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2)) for t in sorted(texts)}
    least = [q for q in asked.values() if not any(o.keys() < q.keys() for o in asked.values())]
    each = dict.fromkeys(_all(*q) for q in least)
    return next(iter(each)) if len(each) == 1 else ("or", *each)


def _characters(items: list) -> set[str] | None:
    """The lower-cased characters of a class, None if there are many or the class is negated."""
    found: set[str] = set()
    for kind, value in items:
        if kind is parts.LITERAL:
            found.add(chr(value).lower())
        elif kind is parts.RANGE and value[1] - value[0] < 4 * MOST_CHARACTERS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CHARACTERS else None


def _meaning(nodes: list) -> tuple[set[str] | None, Query]:
    """(all texts that the parsed expression stands for, lower-cased, if they are few; a query that holds wherever it matches)."""
    query: Query = True
    whole: bool = True
    stretch = {""}  # what stands before this place without a gap
    for kind, value in nodes:
        texts: set[str] | None = None
        inner: Query = True
        if kind is parts.LITERAL:
            texts = {chr(value).lower()}
        elif kind is parts.IN:
            texts = _characters(value)
        elif kind is parts.SUBPATTERN:
            texts, inner = _meaning(value[3])
        elif kind is parts.BRANCH:
            each = [_meaning(option) for option in value[1]]
            if all(t is not None for t, _ in each):
                texts = set().union(*(t for t, _ in each))
            else:
                queries = [_held(t) if t is not None else q for t, q in each]
                inner = True if any(q is True for q in queries) else ("or", *dict.fromkeys(queries))
        elif kind in (parts.MAX_REPEAT, parts.MIN_REPEAT):
            least, most, item = value
            found, asked = _meaning(item)
            if found is not None and most is not parts.MAXREPEAT and len(found) ** most <= MOST_TEXTS and most <= 8:
                texts = {"".join(c) for n in range(least, most + 1) for c in product(found, repeat=n)}
            elif least and found is not None and len(stretch) * len(found) <= MOST_TEXTS:
                # its first time follows what stands before, its last time leads on
                query, whole, stretch = _all(query, _held({a + b for a in stretch for b in found})), False, found
                continue
            elif least:
                inner = asked if found is None else _held(found)
        if texts is not None and len(stretch) * len(texts) <= MOST_TEXTS:
            stretch = {a + b for a in stretch for b in texts}
            continue
        query, whole = _all(query, _held(stretch), inner), False
        stretch = texts if texts is not None and len(texts) <= MOST_TEXTS else {""}
    return (stretch, _held(stretch)) if whole else (None, _all(query, _held(stretch)))


def trigram_query(pattern: str) -> Query:
    """A query over lower-cased trigrams that every text with a match of ``pattern`` answers; True without mandatory trigrams."""
    texts, query = _meaning(list(parser.parse(pattern)))
    return _held(texts) if texts is not None else query


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


def trigram_index(docs: DataFrame, wanted: list[str], key: str = "key", segment: int = SEGMENT) -> DataFrame:
    """(part, trigram, postings): for each part of the keys, the sorted keys of the texts that hold the trigram in any case.

    Keys are dealt into parts by hash, as many as it takes for about ``segment`` rows each, so no list grows with the data.
    """
    rows = max(docs.count(), 1)
    low = docs.select(key, F.lower("text").alias("low")).filter("low is not null")
    held = low.select(key, F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))).alias("trigram"))
    part = F.pmod(F.xxhash64(F.lit(12), key), F.lit(-(-rows // segment)))
    return held.groupBy(part.alias("part"), "trigram").agg(F.array_sort(F.collect_set(key)).alias("postings"))


def _postings(query: Query, lists: Column) -> Column:
    """The keys that answer the query, from the map ``lists`` of a part."""
    if isinstance(query, str):
        return F.coalesce(lists[query], F.array().cast("array<bigint>"))
    join = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(join, [_postings(q, lists) for q in query[1:]])


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the keys that answer a query of the index, with the names of all that they answer."""
    lists = index.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("lists"))
    named = lambda kind: lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind"))
    found = [F.transform(_postings(q, F.col("lists")), named(kind)) for kind, q in queries.items()]
    return lists.select(F.explode(F.concat(*found)).alias("at")).groupBy("at.key").agg(F.collect_set("at.kind").alias("kinds"))


def _sums(numbers: Column, base: Column) -> Column:
    return F.aggregate(numbers, F.array(base), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def sums_before(numbers: Column, block: int = 256) -> Column:
    """For each element of an array of long the sum of all before it, block by block, since appending copies an array."""
    size = lambda a: F.size(a).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(size(numbers) / block).cast("int") - 1), lambda b: F.slice(numbers, b * block + 1, F.lit(block)))
    totals = _sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0).cast("long"))
    each = F.zip_with(blocks, F.slice(totals, F.lit(1), F.size(totals) - 1), lambda b, base: F.slice(_sums(b, base), F.lit(1), F.size(b)))
    return F.when(F.size(numbers) > 0, F.flatten(each)).otherwise(F.array().cast("array<bigint>"))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Structs (start, rule, end) of the leftmost matches that do not overlap, in code points; those too short are left out.

    What stands between the matches gives their places.
    """
    pattern = F.lit(rule.java)
    lengths = lambda texts: F.transform(texts, lambda t: F.length(t).cast("long"))
    gaps = lengths(F.split(text, rule.java, -1))
    sizes = lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    before = sums_before(F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda a, b: a + b))
    rows = F.arrays_zip(before.alias("before"), F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"), sizes.alias("size"), lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("held"))
    start = lambda r: r["before"] + r["gap"]
    kept = F.filter(rows, lambda r: r["held"] >= rule.least)
    return F.transform(kept, lambda r: F.struct(start(r).alias("start"), F.lit(number).alias("rule"), (start(r) + r["size"]).alias("end")))


def whole_runs(rule: Rule) -> Rule:
    """A rule that is one class over and over, with its least length in the pattern: the same spans, without the short matches."""
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]\\]+\]\+", rule.pattern):
        return rule._replace(pattern=f"{rule.pattern[:-1]}{{{rule.least},}}")
    return rule


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with spans: structs (kind, start, end) by start, then in the order of the rules.

    A null text counts as empty. Rows that repeat are rows of their own. Spans of different rules may overlap. ``keep`` may name any
    columns but spans. Texts move once, to meet the rules that the index has left for them; each key of the move is a row
    with its text, so copies of one text under different doc_ids spread.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    columns = [c for c in keep if c != "text"]
    rows = docs.select(F.struct(*columns).alias("kept"), text.alias("text"))
    rows = rows.select(F.xxhash64("kept", "text").alias("key"), "kept", "text")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    wanted = sorted(set().union(*map(trigrams, queries.values())))
    if wanted:
        rows = rows.join(candidates(trigram_index(rows, wanted), queries), "key", "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    nothing = F.array().cast("array<struct<start: bigint, rule: int, end: bigint>>")
    found = []
    for i, rule in enumerate(rules):
        rule, asked = whole_runs(rule), F.lit(True)
        if rule.kind in queries:
            asked = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        found.append(F.when(asked & F.col("text").rlike(rule.java), spans_of(F.col("text"), rule, i)).otherwise(nothing))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(kinds[s["rule"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(*[F.col(f"kept.`{c}`").alias(c) for c in columns], *(["text"] if "text" in keep else []), spans.alias("spans"))
