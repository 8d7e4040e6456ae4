"""Pages to arrays of nodes, and selector matching over those arrays.

Each page becomes ONE row whose ``nodes`` array lists its elements and texts in
document order. ``lo`` is a node's position in that array and ``hi`` the position
of its last descendant, so "everything inside x" is a slice of the array. All
extraction is therefore page-local: no shuffle, no join, no group of elements
collected anywhere. Only the tokenizer below runs in Python (Arrow batches).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import blank_to_null, let

# Fixed values of the HTML standard: elements that never have content.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT_TAGS = frozenset(["script", "style"])
# Their text is not part of the text of the elements around them.
APART_TAGS = frozenset(["script", "style", "template", "rt", "rp"])
# Elements whose end tag may be left out: a new start tag ends the ones listed.
ENDED_BY = {
    **dict.fromkeys(
        "address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
        "header hr main menu nav ol p pre section table ul".split(),
        frozenset(["p"]),
    ),
    "li": frozenset(["li", "p"]),
    **dict.fromkeys(["dt", "dd"], frozenset(["dt", "dd", "p"])),
    **dict.fromkeys(["td", "th"], frozenset(["td", "th", "p"])),
    "tr": frozenset(["tr", "td", "th", "p"]),
    **dict.fromkeys(["tbody", "thead", "tfoot"], frozenset(["tbody", "thead", "tr", "td", "th", "p"])),
    "option": frozenset(["option"]),
}

NODE_TYPE = (
    "array<struct<lo:int,hi:int,depth:int,tag:string,attrs:map<string,string>,"
    "classes:array<string>,text:string,length:int>>"
)
SLICE_BYTES = 4 * 1024 * 1024
TEXT, RAW, COMMENT, DOCTYPE = "#text", "#raw", "#comment", "#doctype"

_ARROW_TYPES = {
    "lo": pa.int32(), "hi": pa.int32(), "depth": pa.int32(), "tag": pa.string(),
    "attrs": pa.map_(pa.string(), pa.string()), "classes": pa.list_(pa.string()),
    "text": pa.string(), "length": pa.int32(),
}


def _markup_size(s: str) -> int:
    """Length of the text once ``& < >`` are written as entities."""
    return len(s) + 4 * s.count("&") + 3 * (s.count("<") + s.count(">"))


class _Tokens(HTMLParser):
    """Collects the nodes of a batch of pages column by column (see NODE_TYPE)."""

    def __init__(self, implied_ends: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.implied_ends = implied_ends
        self.apart = 0
        self.open: Counter[str] = Counter()
        self.tags: list[str] = []
        self.last: list[int] = []
        self.depths: list[int] = []
        self.attrs: list[list | None] = []
        self.classes: list[list | None] = []
        self.texts: list[str | None] = []
        self.lengths: list[int] = []
        self.first = 0
        self.stack: list[int] = []
        self.chunks: list[str] = []

    def _add(self, tag: str, attrs, classes, text: str | None, length: int) -> int:
        at = len(self.tags)
        self.tags.append(tag)
        self.last.append(at - self.first)
        self.depths.append(len(self.stack))
        self.attrs.append(attrs)
        self.classes.append(classes)
        self.texts.append(text)
        self.lengths.append(length)
        return at

    def _leaf(self, kind: str, text: str, length: int) -> None:
        if self.stack:
            self.lengths[self.stack[-1]] += length
        if text := text.strip():
            self._add(kind, None, None, text, length)

    def _end_text(self) -> None:
        if self.chunks:
            text = "".join(self.chunks)
            self.chunks = []
            raw = bool(self.stack) and self.tags[self.stack[-1]] in RAW_TEXT_TAGS
            self._leaf(RAW if self.apart else TEXT, text, len(text) if raw else _markup_size(text))

    def _close_last(self) -> None:
        at = self.stack.pop()
        self.apart -= self.tags[at] in APART_TAGS
        self.open[self.tags[at]] -= 1
        self.last[at] = len(self.tags) - 1 - self.first
        if self.stack:
            self.lengths[self.stack[-1]] += self.lengths[at]

    def handle_starttag(self, tag, attrs) -> None:
        self._end_text()
        values = {k: v or "" for k, v in attrs}
        length = len(tag) + 2 + sum(len(k) + 4 + _markup_size(v) for k, v in values.items())
        void = tag in VOID_TAGS
        if self.implied_ends:
            while self.stack and self.tags[self.stack[-1]] in ENDED_BY.get(tag, ()):
                self._close_last()
        self.apart += tag in APART_TAGS
        self.open[tag] += 1
        self.stack.append(
            self._add(tag, list(values.items()), values.get("class", "").split(), None,
                      length + (1 if void else len(tag) + 3))
        )
        if void:
            self._close_last()

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close_last()

    def handle_endtag(self, tag) -> None:
        self._end_text()
        if self.open[tag]:
            while self.tags[self.stack[-1]] != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data) -> None:
        self.chunks.append(data)

    def handle_comment(self, data) -> None:
        self._end_text()
        self._leaf(COMMENT, data, len(data) + 7)

    def handle_decl(self, decl) -> None:
        self._end_text()
        self._leaf(DOCTYPE, decl, len(decl) + 3)

    def handle_pi(self, data) -> None:
        self._end_text()
        self._leaf(DOCTYPE, data, len(data) + 3)

    def unknown_decl(self, data) -> None:
        self._end_text()
        character_data = data.startswith("CDATA[")
        self._leaf(TEXT if character_data else DOCTYPE, data[6:] if character_data else data, len(data) + 6)

    def page(self, html: str) -> bool:
        """Add one page; a page the tokenizer gives up on leaves nothing behind."""
        self.reset()
        self.first = len(self.tags)
        try:
            self.feed(html)
            self.close()
            self._end_text()
        except AssertionError:
            for column in (self.tags, self.last, self.depths, self.attrs, self.classes, self.texts, self.lengths):
                del column[self.first :]
            self.stack, self.chunks, self.apart = [], [], 0
            self.open.clear()
            return False
        while self.stack:
            self._close_last()
        return True


def _node_lists(pages: Sequence[str | None], implied_ends: bool = False) -> pa.Array:
    """One Arrow list-of-struct column; a missing or unreadable page gives a NULL list."""
    tokens, offsets, missing = _Tokens(implied_ends), [0], []
    for html in pages:
        missing.append(html is None or not tokens.page(html))
        offsets.append(len(tokens.tags))
    starts = np.repeat(np.array(offsets[:-1], "int64"), np.diff(offsets))
    columns = {
        "lo": np.arange(len(tokens.tags)) - starts, "hi": tokens.last, "depth": tokens.depths,
        "tag": tokens.tags, "attrs": tokens.attrs, "classes": tokens.classes,
        "text": tokens.texts, "length": tokens.lengths,
    }
    arrays = [pa.array(columns[name], dtype) for name, dtype in _ARROW_TYPES.items()]
    structs = pa.StructArray.from_arrays(arrays, names=list(_ARROW_TYPES))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, mask=pa.array(missing, pa.bool_()))


def _slices(pages: pa.Array) -> Iterator[tuple[int, int]]:
    """Cut a batch so that a few megabytes of pages are taken apart at a time."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(pages), 0).to_pylist()):
        if size and size + n > SLICE_BYTES:
            yield start, i - start
            start, size = i, 0
        size += n
    if start < len(pages):
        yield start, len(pages) - start


def parse_pages(pages: DataFrame, html: str = "html", implied_ends: bool = False) -> DataFrame:
    """Replace the ``html`` column by ``nodes``; all other columns are kept.

    With ``implied_ends`` a new ``<li>``, ``<td>``, ``<p>`` ... ends an open one, as
    forum pages are read; without it an unclosed element reaches to the end of
    the element around it, as news pages are read.
    """
    kept = [c for c in pages.columns if c != html]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _slices(batch.column(html)):
                part = batch.slice(at, n)
                columns = [part.column(c) for c in kept]
                nodes = _node_lists(part.column(html).to_pylist(), implied_ends)
                yield pa.RecordBatch.from_arrays([*columns, nodes], names=[*kept, "nodes"])

    return pages.select(*kept, html).mapInArrow(run, f"{schema}, nodes {NODE_TYPE}")


class _Tags(HTMLParser):
    """Collects the start tags of some kinds with some of their attributes."""

    def __init__(self, tags: frozenset[str], names: frozenset[str] | None) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted, self.names = tags, names
        self.tags: list[str] = []
        self.attrs: list[list] = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.wanted:
            self.tags.append(tag)
            values = {k: v or "" for k, v in attrs if self.names is None or k in self.names}
            self.attrs.append(list(values.items()))

    def page(self, html: str) -> bool:
        self.reset()
        before = len(self.tags)
        try:
            self.feed(html)
            self.close()
        except AssertionError:
            del self.tags[before:], self.attrs[before:]
            return False
        return True


TAG_TYPE = "array<struct<tag:string,attrs:map<string,string>>>"


def page_tags(pages: DataFrame, tags: Sequence[str], attrs: Sequence[str] | None, *keys: str, html: str = "html") -> DataFrame:
    """E1 projected: (keys, elements) of the start tags named, in document order, with the attributes named (None: all).

    The same elements and values as a filter of the full tree by tag gives, for
    much less: no texts, no nesting, and only the rows asked for leave the tokenizer.
    """
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keys)
    wanted, names = frozenset(tags), None if attrs is None else frozenset(attrs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _slices(batch.column(html)):
                part = batch.slice(at, n)
                found, offsets, missing = _Tags(wanted, names), [0], []
                for page in part.column(html).to_pylist():
                    missing.append(page is None or not found.page(page))
                    offsets.append(len(found.tags))
                structs = pa.StructArray.from_arrays(
                    [pa.array(found.tags, pa.string()), pa.array(found.attrs, _ARROW_TYPES["attrs"])], names=["tag", "attrs"])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, mask=pa.array(missing, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keys], lists], names=[*keys, "elements"])

    return pages.select(*keys, html).mapInArrow(run, f"{schema}, elements {TAG_TYPE}")


def _enclosing(outer_lo: np.ndarray, outer_hi: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One pass over intervals and positions in order, with a stack of the open intervals.

    (nearest, depth) of each position and of each interval: the number of the
    innermost interval around it, -1 if there is none, and how many there are.
    """
    stack: list[tuple[int, int]] = []  # (end, number)
    near_outer, deep_outer = np.empty(len(outer_lo), np.int64), np.empty(len(outer_lo), np.int64)
    near_inner, deep_inner = np.empty(len(inner), np.int64), np.empty(len(inner), np.int64)
    starts, ends, places = outer_lo.tolist(), outer_hi.tolist(), inner.tolist()
    n = 0
    for k, place in enumerate([*places, None]):
        # Intervals that begin before the position; an element is not inside itself.
        while n < len(starts) and (place is None or starts[n] < place):
            while stack and stack[-1][0] < starts[n]:
                stack.pop()
            near_outer[n], deep_outer[n] = (stack[-1][1] if stack else -1), len(stack)
            stack.append((ends[n], n))
            n += 1
        if place is not None:
            while stack and stack[-1][0] < place:
                stack.pop()
            near_inner[k], deep_inner[k] = (stack[-1][1] if stack else -1), len(stack)
    return near_outer, deep_outer, near_inner, deep_inner


ENCLOSED = (
    "outers array<struct<lo:int,hi:int,tag:string,around:int,depth:int>>, "
    "inners array<struct<lo:int,tag:string,attrs:map<string,string>,around:int,depth:int>>"
)


def enclosing(parsed: DataFrame, outer: list[list[dict]], inner: list[list[dict]], *keys: str) -> DataFrame:
    """(keys, outers, inners): how the elements of two rules lie in each other.

    ``around`` is the place in ``outers`` (from 0) of the innermost outer element
    around an element, NULL if there is none, and ``depth`` the number of all of them:
    those around it are ``around``, the ``around`` of that, and so on. Time and output
    are linear in the elements, however deep they are nested; see ``inside_pairs``
    for all pairs. A missing page gives NULL.
    """
    found = parsed.select(
        *keys,
        F.transform(find_all(F.col("nodes"), outer), lambda e: F.struct(e["lo"].alias("lo"), e["hi"].alias("hi"), e["tag"].alias("tag"))).alias("outers"),
        F.transform(find_all(F.col("nodes"), inner), lambda e: F.struct(e["lo"].alias("lo"), e["tag"].alias("tag"), e["attrs"].alias("attrs"))).alias("inners"),
    )
    schema = ", ".join(f"`{c}` {parsed.schema[c].dataType.simpleString()}" for c in keys)

    def parts(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
        flat = column.flatten()
        lengths = np.array(column.value_lengths().fill_null(0), np.int64)
        return np.append(0, np.cumsum(lengths)), [flat.field(c) for c in names]

    def lists(offsets: np.ndarray, fields: dict[str, pa.Array], like: pa.Array) -> pa.Array:
        structs = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), structs, mask=like.is_null())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outer_at, (o_lo, o_hi, o_tag) = parts(batch.column("outers"), ["lo", "hi", "tag"])
            inner_at, (i_lo, i_tag, i_attrs) = parts(batch.column("inners"), ["lo", "tag", "attrs"])
            los, his, places = o_lo.to_numpy(), o_hi.to_numpy(), i_lo.to_numpy()
            found = [
                _enclosing(los[a:b], his[a:b], places[c:d])
                for a, b, c, d in zip(outer_at, outer_at[1:], inner_at, inner_at[1:], strict=False)]
            columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
            around = [pa.array(x.astype(np.int32), mask=x < 0) for x in (columns[0], columns[2])]
            depth = [pa.array(x.astype(np.int32)) for x in (columns[1], columns[3])]
            outers = lists(outer_at, {"lo": o_lo, "hi": o_hi, "tag": o_tag, "around": around[0], "depth": depth[0]}, batch.column("outers"))
            inners = lists(inner_at, {"lo": i_lo, "tag": i_tag, "attrs": i_attrs, "around": around[1], "depth": depth[1]}, batch.column("inners"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], outers, inners], names=[*keys, "outers", "inners"])

    return found.mapInArrow(run, f"{schema}, {ENCLOSED}")


def nearest_outer(parsed: DataFrame, outer: list[list[dict]], inner: list[list[dict]], *keys: str) -> DataFrame:
    """One row for each inner element, with the innermost outer element around it, if any, and their number."""
    near = lambda x: F.get("outers", x["around"])
    rows = F.transform("inners", lambda i: F.struct(
        i["lo"].alias("inner_lo"), i["attrs"].alias("attrs"), near(i)["lo"].alias("outer_lo"), near(i)["tag"].alias("outer_tag"), i["depth"].alias("depth")))
    return enclosing(parsed, outer, inner, *keys).select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def page_links(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, hrefs): the addresses of a page's anchors, in document order; NULL for a missing page."""
    anchors = page_tags(pages, ["a"], ["href"], *keys)
    hrefs = F.transform(F.filter("elements", lambda e: e["attrs"]["href"].isNotNull()), lambda e: e["attrs"]["href"])
    return anchors.select(*keys, hrefs.alias("hrefs"))


def elements(parsed: DataFrame, *keys: str) -> DataFrame:
    """E1 as a long table: one row per node, text nodes included."""
    return parsed.select(*keys, F.explode("nodes").alias("n")).select(*keys, "n.*")


# --- selectors -----------------------------------------------------------------
# A rule is a list of alternatives, an alternative a list of steps, and a step
# says what one element must look like; later steps lie inside earlier ones.


def step(tag: str | None = None, cls: Sequence[str] | str = (), attrs: Sequence[tuple] = ()) -> dict:
    """One compound selector; ``attrs`` holds ``(name, op, value)``, op in has = ^= $= *= ~=."""
    return {"tag": tag, "classes": [cls] if isinstance(cls, str) else list(cls), "attrs": list(attrs)}


def attr(e: Column, name: str) -> Column:
    return e["attrs"][name]


def filled_attr(e: Column, name: str) -> Column:
    return blank_to_null(attr(e, name))


def _attr_test(value: Column, op: Column | str, wanted: Column) -> Column:
    tests = {
        "has": value.isNotNull(),
        "=": value == wanted,
        "^=": F.startswith(value, wanted),
        "$=": F.endswith(value, wanted),
        "*=": F.contains(value, wanted),
        "~=": F.array_contains(F.split(value, r"\s+"), wanted),
    }
    if isinstance(op, str):
        return F.coalesce(tests[op], F.lit(False))
    chosen = F.when(op == "has", tests["has"])
    for name in ("=", "^=", "$=", "*=", "~="):
        chosen = chosen.when(op == name, tests[name])
    return F.coalesce(chosen, F.lit(False))


def _is_element(e: Column) -> Column:
    return e["attrs"].isNotNull()


def _fits(e: Column, s: dict) -> Column:
    test = _is_element(e)
    if s["tag"]:
        test = test & (e["tag"] == s["tag"])
    for c in s["classes"]:
        test = test & F.array_contains(e["classes"], c)
    for name, op, value in s["attrs"]:
        test = test & _attr_test(attr(e, name), op, F.lit(value))
    return test


def _fits_column(e: Column, s: Column) -> Column:
    """The same test for a step that comes from the rules table."""
    return (
        _is_element(e)
        & (s["tag"].isNull() | (s["tag"] == e["tag"]))
        & F.forall(s["classes"], lambda c: F.array_contains(e["classes"], c))
        & F.forall(
            s["attrs"],
            lambda a: _attr_test(e["attrs"][a["name"]], a["op"], a["value"]),
        )
    )


def _spans(es: Column) -> Column:
    return F.transform(es, lambda e: F.struct(e["lo"].alias("lo"), e["hi"].alias("hi")))


COVER_BLOCK = 64


def _cover(spans: Column) -> Column:
    """Spans in order of ``lo`` prepared for ``_inside``: how far any span up to each one reaches.

    The furthest reach is taken inside blocks first and then over the blocks
    before. The blocks are cut out once: each ``slice`` copies the whole array.
    """

    def prepared(x: Column) -> Column:
        before = F.transform(x["tops"], lambda _, b: F.array_max(F.slice(x["tops"], F.lit(1), b)))
        reach = F.flatten(F.zip_with(x["chunks"], before, lambda c, top: F.transform(
            c, lambda _, i: F.greatest(top, F.array_max(F.slice(c, F.lit(1), i + 1))))))
        return F.struct(
            x["los"].alias("lo"), reach.alias("reach"),
            F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda w: w <= F.size(x["los"])).alias("powers"),
        )

    def cut(ss: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(ss) - 1) / COVER_BLOCK).cast("int")))
        chunks = F.transform(blocks, lambda b: F.transform(F.slice(ss, b * COVER_BLOCK + 1, F.lit(COVER_BLOCK)), lambda s: s["hi"]))
        return F.struct(F.transform(ss, lambda s: s["lo"]).alias("los"), chunks.alias("chunks"), F.transform(chunks, F.array_max).alias("tops"))

    return let(let(spans, cut), prepared)


def _inside(e: Column, cover: Column) -> Column:
    """Whether ``e`` lies in one of the spans: a binary search for the spans that begin before it."""
    before = F.aggregate(
        cover["powers"], F.lit(0),
        lambda n, w: F.when(F.coalesce(F.get(cover["lo"], n + w - 1) < e["lo"], F.lit(False)), n + w).otherwise(n),
    )
    return F.coalesce(F.get(cover["reach"], before - 1) >= e["lo"], F.lit(False))


def _alternative(nodes: Column, steps: list[dict], scope: Column) -> Column:
    if len(steps) == 1:
        return F.filter(scope, lambda e: _fits(e, steps[0]))
    outer = _cover(_spans(_alternative(nodes, steps[:-1], nodes)))
    return let(outer, lambda o: F.filter(scope, lambda e: _fits(e, steps[-1]) & _inside(e, o)))


def find_all(nodes: Column, rule: list[list[dict]], scope: Column | None = None) -> Column:
    """Matching elements in document order; ``scope`` narrows the elements tested."""
    scope = nodes if scope is None else scope
    if all(len(steps) == 1 for steps in rule):

        def any_of(e: Column) -> Column:
            test = _fits(e, rule[0][0])
            for steps in rule[1:]:
                test = test | _fits(e, steps[0])
            return test

        return F.filter(scope, any_of)
    found = F.concat(*[_alternative(nodes, steps, scope) for steps in rule])
    return in_document_order(found) if len(rule) > 1 else found


def in_document_order(found: Column) -> Column:
    """Sort by position and drop repeats. ``lo`` is unique, and maps cannot be compared."""
    ordered = F.array_sort(
        found, lambda a, b: F.when(a["lo"] < b["lo"], -1).when(a["lo"] > b["lo"], 1).otherwise(0)
    )
    return let(
        ordered,
        lambda es: F.filter(es, lambda e, i: (i == 0) | (F.get(es, i - 1)["lo"] != e["lo"])),
    )


def find_first(nodes: Column, rule: list[list[dict]], scope: Column | None = None) -> Column:
    return F.get(find_all(nodes, rule, scope), F.lit(0))


def _steps_match(nodes: Column, steps: Column, scope: Column) -> Column:
    everything = F.array(F.struct(F.lit(-1).alias("lo"), F.lit(2**31 - 1).alias("hi")))
    outer = F.aggregate(
        F.slice(steps, F.lit(1), F.size(steps) - 1),
        everything,
        lambda spans, s: let(
            F.struct(_cover(spans).alias("c"), s.alias("s")),
            lambda x: _spans(F.filter(nodes, lambda e: _fits_column(e, x["s"]) & _inside(e, x["c"]))),
        ),
    )
    last = F.element_at(steps, -1)
    return let(
        F.struct(_cover(outer).alias("spans"), last.alias("step")),
        lambda x: F.filter(scope, lambda e: _fits_column(e, x["step"]) & _inside(e, x["spans"])),
    )


def find_all_by(nodes: Column, rule: Column, scope: Column | None = None) -> Column:
    """``find_all`` for a rule held in a column (see ``sources.rules.selector_steps``)."""
    scope = nodes if scope is None else scope
    usable = F.filter(rule, lambda steps: F.size(steps) > 0)
    return in_document_order(F.flatten(F.transform(usable, lambda s: _steps_match(nodes, s, scope))))


def subtree(nodes: Column, e: Column) -> Column:
    """All nodes inside ``e``; ``e`` must be cheap (a lambda variable or a column)."""
    return F.slice(nodes, e["lo"] + 2, e["hi"] - e["lo"])


def text_of(nodes: Column, e: Column, separator: str = "") -> Column:
    """Stripped texts inside ``e`` joined together, without scripts, styles and the like."""
    own_kind = F.when(e["tag"].isin(*sorted(APART_TAGS)), F.lit(RAW)).otherwise(F.lit(TEXT))
    texts = F.filter(subtree(nodes, e), lambda x: x["tag"] == own_kind)
    return F.array_join(F.transform(texts, lambda x: x["text"]), separator)


def inside_pairs(parsed: DataFrame, outer: list[list[dict]], inner: list[list[dict]], *keys: str) -> DataFrame:
    """One row per (outer element, element inside it), found by slicing."""
    nodes = F.col("nodes")
    pairs = F.flatten(
        F.transform(
            find_all(nodes, outer),
            lambda o: F.transform(
                find_all(nodes, inner, subtree(nodes, o)),
                lambda i: F.struct(o["lo"].alias("outer_lo"), i["lo"].alias("inner_lo"),
                                   i["attrs"].alias("attrs")),
            ),
        )
    )
    return parsed.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def flat_links(pages: DataFrame, *keys: str) -> DataFrame:
    """E1 as a flat list of links: every anchor with an address, in document order, numbered from 1."""
    return page_links(pages, *keys).select(*keys, F.posexplode("hrefs").alias("pos", "href")).withColumn("pos", F.col("pos") + 1)
