"""Pages as elements: a reader of tags, attributes, decoded text and nesting, and selections from what it gives.

The reader is the one place where a page is walked; everything after it is arrays of one row, so
pages are never shuffled and need no key.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankatlas.functions.scalars import BLANK

# Elements without content, elements that don't break a line, elements whose text isn't shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("script style noscript svg template".split())
#: An element of these ends an open one of its group, unless one of the others stands between.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Keys of a JSON-LD object whose values may hold addresses, in the order in which they are looked at; keys that wrap further objects.
MAIL_KEYS = ("email", "contactPoint", "author", "creator", "member")
WRAPPERS = ("@graph", "itemListElement", "item")

READ = "_page"  # the column that holds what is read
ELEMENT = "struct<n:int,last:int,tag:string,attrs:map<string,string>,start:int,end:int>"
PAGE = f"struct<text:string,seen:string,base:string,elements:array<{ELEMENT}>,mails:array<string>,things:array<string>>"
CUT, AT = "_item", "_at"  # an item that is cut out of a page, and its page's number within the task
ITEM = f"struct<text:string,head:{ELEMENT},elements:array<{ELEMENT}>,near:string,after:string>"
_ELEMENT = pa.struct([("n", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("start", pa.int32()), ("end", pa.int32())])
_ITEM = pa.struct([("text", pa.string()), ("head", _ELEMENT), ("elements", pa.list_(_ELEMENT)), ("near", pa.string()), ("after", pa.string())])


class PageReader(HTMLParser):
    """Elements of one page in order: number, last number inside, tag, attributes, and where their text starts and ends in the page's.

    Entities are decoded. Text of scripts and styles is kept apart; `seen` leaves out what is inside
    scripts, styles, drawings and hidden elements. A tag that breaks a line is a blank in both texts.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.open: list[tuple[str, int, bool]] = []
        self.text, self.shown, self.size = [], [], 0
        self.base, self.scripts = None, []

    @property
    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def _write(self, text: str) -> None:
        self.text.append(text)
        self.size += len(text)
        if not self.hidden:
            self.shown.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag in ENDS:
            group, walls = ENDS[tag]
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in walls:
                    break
                if self.open[i][0] in group:
                    self._close(i)
                    if tag != "tr":
                        break
        if tag not in INLINE:
            self._write(" ")
        n = len(self.elements)
        if tag == "base" and self.base is None:
            self.base = given.get("href")
        self.elements.append([n, n, tag, given, self.size, self.size])
        if tag not in VOID:
            self.open.append((tag, n, self.hidden or tag in UNSEEN or "hidden" in given or given.get("aria-hidden") == "true"))
            if tag == "script":
                self.scripts.append([given.get("type", "").strip().lower(), ""])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and any(x[0] in ("svg", "math") for x in self.open):
            self._close(len(self.open) - 1)  # only what is in a drawing closes itself so

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return

    def _close(self, i: int) -> None:
        """Ends the open element at i and all inside it."""
        while len(self.open) > i:
            tag, n, _ = self.open[-1]
            if tag not in INLINE:
                self._write(" ")
            self.elements[n][1], self.elements[n][5] = len(self.elements) - 1, self.size
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style"):
            if self.open[-1][0] == "script":
                self.scripts[-1][1] += data
            return
        self._write(data)

    def read(self, page: str) -> PageReader:
        self.feed(page)
        self.close()
        self._close(0)
        return self


def _documents(scripts: list) -> Iterator[object]:
    for kind, body in scripts:
        if kind in ("application/ld+json", "application/ld.json"):
            try:
                yield json.loads(body)
            except (ValueError, RecursionError):
                continue


def mail_texts(value: object) -> list[str]:
    """Texts in a JSON-LD value that may hold addresses, in order, however deep."""
    found, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            found.append(x)
        elif isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            todo += [x[k] for k in reversed(MAIL_KEYS) if k in x]
    return found


def typed_objects(value: object) -> list[str]:
    """Objects with an @type, as JSON, in lists, graphs and item lists, however deep."""
    found, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            if "@type" in x:
                found.append(json.dumps({k: v for k, v in x.items() if k not in WRAPPERS}))
            todo += [x[k] for k in reversed(WRAPPERS) if isinstance(x.get(k), (list, dict))]
    return found


def read_elements(pages: DataFrame, html: str = "html", rows: int = 64) -> DataFrame:
    """Pages with `_page`: text, seen (text that is shown), base (the base element's target), elements, and from JSON-LD mails and things (typed objects).

    A null page has no text and no elements. Broken markup is read as it comes: an end without a
    start is ignored, an element left open ends with the one around it; JSON that can't be parsed is
    skipped.
    """
    schema = StructType([*pages.schema, *StructType.fromDDL(f"{READ} {PAGE}")])
    kind = pa.struct([("text", pa.string()), ("seen", pa.string()), ("base", pa.string()), ("elements", pa.list_(_ELEMENT)), ("mails", pa.list_(pa.string())), ("things", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part, found = batch.slice(at, rows), []
                for page in part.column(part.schema.get_field_index(html)).to_pylist():
                    r = PageReader().read(page or "")
                    documents = list(_documents(r.scripts))
                    found.append({
                        "text": "".join(r.text), "seen": " ".join("".join(r.shown).split()), "base": r.base,
                        "elements": [{"n": n, "last": last, "tag": tag, "attrs": list(given.items()), "start": a, "end": b} for n, last, tag, given, a, b in r.elements],
                        "mails": [x for d in documents for x in mail_texts(d)], "things": [x for d in documents for x in typed_objects(d)],
                    })
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, READ])

    return pages.mapInArrow(run, schema)


_SPACES = re.compile(r"\s+", re.ASCII)


def _selected(*selectors: str) -> Callable[[str, dict], bool]:
    """matches() of a tag and its attributes within the reader, for any of the selectors: what they name is looked up, not tried one by one."""
    tags: set[str] = set()
    classes: dict[str, set[str]] = {}
    tests: dict[str, list[tuple[str, str, str]]] = {}
    for part in (x.strip() for s in selectors for x in s.split(",")):
        tag, mark, name, how, value = _parsed(part)
        if mark == ".":
            classes.setdefault(name, set()).add(tag)
        elif mark:
            tests.setdefault("id" if mark == "#" else name, []).append((tag, "=" if mark == "#" else how, name if mark == "#" else value))
        else:
            tags.add(tag)

    def fit(tag: str, given: dict) -> bool:
        if tag in tags:
            return True
        for key, x in given.items():
            for t, how, value in tests.get(key, ()):
                if (not t or t == tag) and (not how or (x.startswith(value) if how == "^=" else value in x if how == "*=" else x == value)):
                    return True
            if key == "class" and classes:
                for c in _SPACES.split(x):
                    if c in classes and ("" in classes[c] or tag in classes[c]):
                        return True
        return False

    return fit


def _chosen(selector: str, elements: list, parents: list[int], nested: bool) -> list[int]:
    """Numbers of the elements that fit a selector; if nested, a part of it may name an element around them first: `outer inner`."""
    found: set[int] = set()
    for part in selector.split(",") if nested else [selector]:
        outer, _, inner = part.strip().rpartition(" ") if nested else ("", "", part)
        fit = _selected(inner)
        hits = [n for n, e in enumerate(elements) if fit(e[2], e[3])]
        if outer:
            around, inner_of = _selected(outer), []
            for up in parents:
                inner_of.append(up >= 0 and (inner_of[up] or around(elements[up][2], elements[up][3])))
            hits = [n for n in hits if inner_of[n]]
        found.update(hits)
    return sorted(found)


def _cut(text: str, elements: list, heads: list[str], wanted: list[str], texts: list[str], near: tuple[str, ...], following: bool, nested: bool) -> Iterator[dict]:
    """The items of one page, in one walk over its elements."""
    parents, open_ = [], []
    for n, *_ in elements:
        while open_ and elements[open_[-1]][1] < n:
            open_.pop()
        parents.append(open_[-1] if open_ else -1)
        open_.append(n)
    chosen = next((hits for s in heads if (hits := _chosen(s, elements, parents, nested))), [])
    if not chosen:
        return
    nearest: list[str | None] = []
    for (_, _, _, given, _, _), up in zip(elements, parents):
        own = next((given[a] for a in near if a in given), None)
        nearest.append(own if own is not None or up < 0 else nearest[up])
    keep, read = _selected(*wanted), _selected(*texts)
    kept = [n for n, e in enumerate(elements) if keep(e[2], e[3])]
    shown = {n for n in kept if read(elements[n][2], elements[n][3])}

    def moved(n: int, start: int) -> dict:
        _, last, tag, given, a, b = elements[n]
        return {"n": n, "last": last, "tag": tag, "attrs": list(given.items()), "start": a - start, "end": b - start}

    for h, after in zip(chosen, [*chosen[1:], None]):
        _, last, _, _, start, end = elements[h]
        stop = last + 1 if not following else len(elements) if after is None else after
        mine = kept[bisect_left(kept, h + 1) : bisect_left(kept, stop)]
        whole = max([end, *(elements[n][5] for n in mine if n in shown)])
        until = len(text) if after is None else elements[after][4]
        yield {"text": text[start:whole], "head": moved(h, start), "elements": [moved(n, start) for n in mine], "near": nearest[h], "after": text[end:until] if following else None}


def read_items(pages: DataFrame, heads: list[str], wanted: list[str], texts: list[str] | None = None, near: tuple[str, ...] = (), following: bool = False, nested: bool = False, html: str = "html", rows: int = 1000) -> DataFrame:
    """A row an item of each page, in order: the other columns, `_at` (the page's number within its task) and `_item` with text, elements and places of its own.

    An item starts at each element that fits the first of `heads` that its page holds, and reaches
    to that element's end or, if following, to the next one's start. It holds those of its elements
    that fit `wanted`, and its text as far as those that fit `texts` (all of `wanted` by default)
    reach; near is the first of these attributes on the head or the nearest element around it that
    has one, after the text from the head's end on. However many items a page has, each is cut out
    once, so work and memory grow with the page. Pages may have been read by read_elements().
    """
    others = [c for c in pages.columns if c not in (html, READ)]
    schema = StructType([*(pages.schema[c] for c in others), *StructType.fromDDL(f"{AT} int, {CUT} {ITEM}")])
    read, texts = READ in pages.columns, wanted if texts is None else texts

    def page_of(value: object) -> tuple[str, list]:
        if not read:
            r = PageReader().read(value or "")
            return "".join(r.text), r.elements
        return value["text"], [[e["n"], e["last"], e["tag"], dict(e["attrs"]), e["start"], e["end"]] for e in value["elements"]]

    def run(batches):
        page = -1
        for batch in batches:
            names = batch.schema.names
            source, kept = batch.column(names.index(READ if read else html)), [names.index(c) for c in others]
            at, found, pages_of = [], [], []

            def full():
                index = pa.array(at, pa.int32())
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(index) for i in kept), pa.array(pages_of, pa.int32()), pa.array(found, _ITEM)], [*others, AT, CUT])  # noqa: B023

            for row in range(batch.num_rows):
                page += 1
                for item in _cut(*page_of(source[row].as_py()), heads, wanted, texts, near, following, nested):
                    at.append(row)
                    found.append(item)
                    pages_of.append(page)
                    if len(found) >= rows:
                        yield full()
                        at, found, pages_of = [], [], []
            if found:
                yield full()

    return pages.mapInArrow(run, schema)


def in_order(items: DataFrame, value: str, once: str | None = None) -> DataFrame:
    """Rows from read_items() whose `value` isn't null, with `_nth` in place of `_at`: their place in the page from 1 on, counted in the task that has cut it; of rows alike in `once` a page has the first only."""
    others = [c for c in items.columns if c not in (AT, once)]
    schema = StructType([*(items.schema[c] for c in others), *StructType.fromDDL("_nth int")])

    def run(batches):
        page, count, seen = None, 0, set()
        for batch in batches:
            names = batch.schema.names
            there = batch.column(names.index(value)).is_valid().to_pylist()
            keys = batch.column(names.index(once)).to_pylist() if once else there
            rows, nth = [], []
            for i, (at, key) in enumerate(zip(batch.column(names.index(AT)).to_pylist(), keys)):
                if at != page:
                    page, count, seen = at, 0, set()
                if not there[i] or key in seen:
                    continue
                if once:
                    seen.add(key)
                count += 1
                rows.append(i)
                nth.append(count)
            index = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)).take(index) for c in others), pa.array(nth, pa.int32())], [*others, "_nth"])

    return items.mapInArrow(run, schema)


def attribute(element: Column, name: str) -> Column:
    """An attribute's value, null if the element hasn't it."""
    return F.try_element_at(element["attrs"], F.lit(name))


def text_of(element: Column, page: Column | str = READ) -> Column:
    """An element's text with single blanks."""
    whole = F.col(page)["text"] if isinstance(page, str) else page["text"]
    return F.trim(F.regexp_replace(F.substring(whole, element["start"] + 1, element["end"] - element["start"]), rf"{BLANK}+", " "))


def _parsed(part: str) -> tuple[str, str, str, str, str]:
    """Tag, mark (one of [ . # or none), name, how an attribute is compared (empty: it is there), and value of one part of a selector."""
    for mark in ("[", ".", "#"):
        if mark in part:
            tag, _, rest = part.partition(mark)
            name, equal, value = rest.rstrip("]").partition("=") if mark == "[" else (rest, "", "")
            bare = name.rstrip("^*")
            return tag, mark, bare, (name[len(bare) :][-1:] + "=") if equal else "", value.strip("\"'")
    return part, "", "", "", ""


def matches(element: Column, selector: str) -> Column:
    """Whether an element fits a selector: comma-separated `tag`, `.class`, `#id`, `[attribute]`, or that with `=value`, `^=start` or `*=part`, or a tag with one of those."""
    def one(text: str) -> Column:
        tag, mark, name, how, value = _parsed(text)
        fit = element["tag"] == tag if tag else F.lit(True)
        if mark == "#":
            fit &= attribute(element, "id") == name
        elif mark == ".":
            fit &= F.array_contains(F.split(F.coalesce(attribute(element, "class"), F.lit("")), r"\s+"), name)
        elif mark == "[":
            given = attribute(element, name)
            fit &= given.isNotNull() if not how else given.startswith(value) if how == "^=" else given.contains(value) if how == "*=" else given == value
        return F.coalesce(fit, F.lit(False))

    tests = [one(x.strip()) for x in selector.split(",")]
    out = tests[0]
    for t in tests[1:]:
        out |= t
    return out


def fits(selector: str):
    """matches() for one selector, as the function of an element that filters want."""
    return lambda e: matches(e, selector)


def first_match(elements: Column, selectors: list[str], take) -> Column:
    """`take` of the first element that fits the first selector for which that isn't null."""
    tried = [F.get(F.filter(F.transform(F.filter(elements, fits(s)), lambda e: take(e)), lambda x: x.isNotNull()), F.lit(0)) for s in selectors]
    return F.coalesce(*tried)
