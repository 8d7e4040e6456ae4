"""Secrets in texts, found through a trigram index; DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams: sets of
lower-case trigrams, one of which any matching text must contain whole. The
index has postings (trigram, key) for the trigrams that the rules name, the key
being a hash of the id and the text, so a group of copies spreads over all
tasks. Postings are intersected by counting, for each key, the trigrams of a
set; only texts that pass are searched with that rule's expression. A rule
without a mandatory trigram searches every text. A key that two texts share by
chance only adds a candidate.

Positions come from the lengths of the matches and of what lies between them.

Defined results: a NULL or empty text has no span; a NULL id stays NULL;
repeated rows give repeated rows; other columns are not looked at and, with
``with_row``, kept as they are in the struct ``row``; an empty table gives no
row.
"""

from __future__ import annotations

import itertools
import re._constants as ops
import re._parser as regex_parser
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import let
from harrow.llm.common import carried, kept

# Strings that stand for a part of an expression, at most.
STRINGS = 64
# A character class of more characters stands for any character.
CHARACTERS = 12
# Values that running totals are first summed by.
TOTALS = 256


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``, syntax common to Java, RE2 and Python.

    ``group``, if not 0, must hold at least ``least`` characters; other matches are dropped.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base kinds; hex and access name their least length in the expression, which for
# a run of one class of characters finds what dropping short matches would leave.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
FURTHER = (
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("api", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
)
RULES = BASE + FURTHER


# --- trigram queries ----------------------------------------------------

Query = frozenset  # of sets of trigrams, one of which must be there whole
ANYTHING: Query = frozenset({frozenset()})


def _either(*queries: Query) -> Query:
    """Some query holds; sets that contain another one say nothing more."""
    sets = frozenset().union(*queries)
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _both(a: Query, b: Query) -> Query:
    joined = _either(frozenset(x | y for x in a for y in b))
    return joined if len(joined) <= STRINGS else min(a, b, key=len)


def _of_strings(strings: frozenset[str]) -> Query:
    """One of the strings occurs."""
    if min(map(len, strings)) < 3:
        return ANYTHING
    return _either(frozenset(frozenset(s[i: i + 3] for i in range(len(s) - 2)) for s in strings))


def _class(members: list) -> frozenset[str] | None:
    found: set[str] = set()
    for op, value in members:
        if op is ops.LITERAL:
            found.add(chr(value).lower())
        elif op is ops.RANGE and value[1] - value[0] < CHARACTERS:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= CHARACTERS else None


def _part(op, value) -> tuple[frozenset[str] | None, Query]:
    """The only strings that a part matches, lower-cased, or None; and what it demands."""
    if op is ops.LITERAL:
        return frozenset({chr(value).lower()}), ANYTHING
    if op is ops.IN:
        return _class(value), ANYTHING
    if op is ops.AT:
        return frozenset({""}), ANYTHING
    if op is ops.SUBPATTERN:
        return _sequence(value[-1])
    if op is ops.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts):
            strings = frozenset().union(*(s for s, _ in parts))
            if len(strings) <= STRINGS:
                return strings, ANYTHING
        return None, _either(*(q if s is None else _of_strings(s) for s, q in parts))
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if strings is not None and most == 1:
            return strings | ({""} if least == 0 else set()), ANYTHING
        if least == 0:
            return None, ANYTHING
        return None, query if strings is None else _of_strings(strings)
    return None, ANYTHING


def _sequence(parts) -> tuple[frozenset[str] | None, Query]:
    run, query, exact = frozenset({""}), ANYTHING, True
    for op, value in parts:
        strings, inner = _part(op, value)
        if strings is not None and len(strings) * len(run) <= STRINGS:
            run = frozenset(a + b for a in run for b in strings)
            continue
        exact = False
        query = _both(query, _of_strings(run))
        if strings is not None:
            run = strings
        else:
            query, run = _both(query, inner), frozenset({""})
    return (run, ANYTHING) if exact else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """Sets of trigrams, one of which the lower-cased text of any match contains."""
    strings, query = _sequence(regex_parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


# --- index and candidates -----------------------------------------------

def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key) for each of the trigrams that a text contains; ``texts`` has key and text."""
    low = texts.select("key", F.lower("text").alias("low"))
    named = F.array(*[F.lit(t) for t in trigrams])
    held = F.filter(named, lambda t: F.contains(F.col("low"), t))
    return low.select("key", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): texts whose postings satisfy a rule's query, and those rules."""
    rows = [
        (f"{kind}/{number}", kind, trigram, len(own))
        for kind, query in queries.items() for number, own in enumerate(sorted(query, key=sorted)) for trigram in sorted(own)
    ]
    sets = index.sparkSession.createDataFrame(rows, "set string, kind string, trigram string, size int")
    # One row for each trigram of a rule: the size of the rule list bounds it.
    whole = index.join(F.broadcast(sets), "trigram").groupBy("key", "kind", "set").agg(
        F.count("*").alias("n"), F.first("size").alias("size")).where(F.col("n") == F.col("size"))
    return whole.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


# --- spans --------------------------------------------------------------

def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each value, all values before it combined; totals of TOTALS values are taken first.

    The chunks are cut out once, as each ``slice`` copies the whole array.
    """
    fold = lambda a: F.aggregate(a, zero, combine)
    places = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / TOTALS).cast("int"))
    chunks = let(values, lambda v: F.transform(places, lambda b: F.slice(v, b * TOTALS + 1, F.lit(TOTALS))))
    return let(chunks, lambda cs: let(F.transform(cs, fold), lambda sums: F.flatten(F.transform(cs, lambda c, b: let(
        fold(F.slice(sums, F.lit(1), b)), lambda earlier: F.transform(c, lambda x, i: combine(earlier, fold(F.slice(c, F.lit(1), i)))))))))


NO_SPANS = "CAST(array() AS array<struct<start:int,place:int,kind:string,end:int>>)"


def with_spans(rows: DataFrame, rules: tuple[Rule, ...], asked: Callable[[Rule], Column]) -> DataFrame:
    """Add ``spans``, sorted by start and place of the rule; ``asked``: where a rule is searched for."""
    none = F.expr("CAST(array() AS array<string>)")
    others = list(rows.columns)

    def of(rule: Rule, group: int) -> Column:
        return F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(group))

    # Each step is a projection of its own, so nothing is computed twice.
    found = rows.select(*others, *[F.when(asked(r), of(r, 0)).otherwise(none).alias(f"m{i}") for i, r in enumerate(rules)])
    some = [F.size(f"m{i}") > 0 for i in range(len(rules))]
    cut = found.select(
        *found.columns,
        *[F.when(some[i], F.transform(F.split("text", r.pattern, -1), lambda x: F.length(x))).alias(f"b{i}") for i, r in enumerate(rules)],
        *[F.when(some[i], F.transform(of(r, r.group), lambda x: F.length(x))).alias(f"g{i}") for i, r in enumerate(rules) if r.group],
    )

    def pairs(i: int) -> Column:
        return F.transform(f"m{i}", lambda m, k: F.get(F.col(f"b{i}"), k) + F.length(m))

    paired = cut.select(*cut.columns, *[F.when(some[i], pairs(i)).alias(f"p{i}") for i in range(len(rules))])
    before = paired.select(*paired.columns, *[
        F.when(some[i], running(F.col(f"p{i}"), lambda a, b: a + b, F.lit(0))).alias(f"s{i}") for i in range(len(rules))])

    def spans(i: int, r: Rule) -> Column:
        start = lambda k: F.get(F.col(f"s{i}"), k) + F.get(F.col(f"b{i}"), k)
        made = F.transform(f"m{i}", lambda m, k: F.struct(
            start(k).alias("start"), F.lit(i).alias("place"), F.lit(r.kind).alias("kind"), (start(k) + F.length(m)).alias("end")))
        if r.group:
            made = F.filter(made, lambda s, k: F.get(F.col(f"g{i}"), k) >= r.least)
        return F.when(some[i], made).otherwise(F.expr(NO_SPANS))

    every = F.array_sort(F.concat(*[spans(i, r) for i, r in enumerate(rules)]))
    return before.select(*others, every.alias("spans"))


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", with_row: bool = False,
) -> DataFrame:
    """(doc_id or row, text, spans) of every document.

    A span is (start, place, kind, end): code points, end exclusive, and the
    rule's place in the list; spans come by start, then place.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    everywhere = {k for k, q in queries.items() if q == ANYTHING}
    indexed = {k: q for k, q in queries.items() if k not in everywhere}
    rows, _ = carried(docs, doc_id, text, with_row)
    own_id = F.col(f"row.`{doc_id}`" if with_row else "row.doc_id")
    rows = rows.select("row", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64(own_id, "text"))
    if not indexed:
        found = with_spans(rows, rules, lambda r: F.lit(True))
    else:
        trigrams = sorted(set(itertools.chain.from_iterable(s for q in indexed.values() for s in q)))
        index = kept(postings(rows, trigrams), "trigrams")
        # The candidates are few and narrow; no sort moves the texts.
        marked = rows.join(candidates(index, indexed).hint("shuffle_hash"), "key", "left")
        found = with_spans(
            marked, rules, lambda r: F.lit(True) if r.kind in everywhere else F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)))
    return found.select("row" if with_row else "row.doc_id", "text", "spans")


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans are replaced together."""
    ends = F.transform(spans, lambda s: s["end"])
    reached = running(ends, lambda a, b: F.greatest(a, b), F.lit(0))
    pieces = F.transform(F.arrays_zip(spans.alias("s"), reached.alias("r")), lambda x: F.when(
        x["s"]["start"] >= x["r"], F.concat(F.substring(text, x["r"] + 1, x["s"]["start"] - x["r"]), F.lit(mark))).otherwise(F.lit("")))
    rest = F.substring(text, F.array_max(ends) + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))
