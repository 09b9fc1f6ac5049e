"""HTML pages to rows: pre-race pages, result pages, race index pages. Pages come as a DataFrame (path, html)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Container, Iterable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import conform as C

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CELLS, ROWS = {"td", "th"}, {"tr"}
#: Elements whose end tag may be left out: what a start tag ends, and the elements that it doesn't look beyond.
ENDS = {
    "p": ({"p"}, {"div", "td", "th", "li", "table", "body"}), "li": ({"li"}, {"ul", "ol"}), "td": (CELLS, {"tr", "table"}), "th": (CELLS, {"tr", "table"}), "tr": (ROWS, {"table", "tbody", "thead"}),
    "tbody": ({"tbody", "thead"}, {"table"}), "thead": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
}


#: Elements whose content is no markup; how much of it differs between parsers.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp", "svg", "math"}
_GAP, _ATTRIBUTE = r"[ \t\n\r\f]", r'([a-zA-Z][-a-zA-Z0-9_]*)="([^"]*)"'
#: Texts and tags by turns; a tag's inside; comments and document types; an attribute.
BY_TURNS = re.compile(r"[^<>]*+(?:<[^<>]*+>[^<>]*+)*+")
PLAIN = re.compile(rf"(/?)([a-zA-Z][a-zA-Z0-9]*)((?:{_GAP}+{_ATTRIBUTE})*){_GAP}*(/?)")
UNSEEN = re.compile(r"!(?:--(?!-)(?:[^-]|-(?!-))*--|(?i:doctype)[^-]*)")
ATTRIBUTE = re.compile(_ATTRIBUTE)


class Attributes(HTMLParser):
    """The attributes of one start tag."""

    def __init__(self, tag: str):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, str] = {}
        self.feed(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found = {k: v or "" for k, v in attrs}


@lru_cache(8192)
def attributes(raw: str) -> dict[str, str]:
    """The attributes of a plain tag."""
    return Attributes(f"<{raw}>").found if "&" in raw else {k.lower(): v for k, v in ATTRIBUTE.findall(raw)}


def kind(raw: str) -> tuple[str, bool, bool, str] | None:
    """What a tag means for the tree: its name (none: a comment), whether it ends an element or itself, and its classes;
    None for what the standard parser has to read."""
    m = PLAIN.fullmatch(raw)
    if m is None:
        return ("", False, False, "") if UNSEEN.fullmatch(raw) else None
    tag = m[2].lower()
    return None if tag in RAW else (tag, bool(m[1]), bool(m[6]), "" if m[1] else attributes(raw).get("class", ""))


class Shape:
    """The elements of a page in document order: the tag each begins with, the ends of its descendants and texts, and
    places by name and class. It follows from the tags' kinds alone, so pages of one form share it."""

    __slots__ = ("by_class", "by_tag", "end", "last_text", "names", "tag_at")

    def __init__(self, kinds: Iterable[tuple[str, bool, bool, str]]):
        self.names, self.tag_at, self.end, self.last_text = [], [], [], []
        self.by_tag: dict[str, list[int]] = defaultdict(list)
        self.by_class: dict[str, list[int]] = defaultdict(list)
        left: list[tuple[str, int]] = []

        def ended(i: int, text: int) -> None:
            for _, n in left[i:]:
                self.end[n], self.last_text[n] = len(self.end), text
            del left[i:]

        def closed(tag: str, text: int) -> None:
            i = next((i for i in range(len(left) - 1, -1, -1) if left[i][0] == tag), None)
            if i is not None:
                ended(i, text)

        text = 0
        for text, (tag, closing, single, classes) in enumerate(kinds, 1):
            if closing:
                closed(tag, text)
            elif tag:
                if tag in ENDS:
                    ends, within = ENDS[tag]
                    i = next((i for i in range(len(left) - 1, -1, -1) if left[i][0] in within or left[i][0] in ends), None)
                    if i is not None and left[i][0] not in within:
                        ended(i, text)
                n = len(self.end)
                self.names.append(tag)
                self.tag_at.append(text - 1)
                self.end.append(n + 1)
                self.last_text.append(text)
                self.by_tag[tag].append(n)
                for cls in dict.fromkeys(classes.split()):
                    self.by_class[cls].append(n)
                if tag not in VOID:
                    left.append((tag, n))
                if single:
                    closed(tag, text)
        ended(0, text + 1)


class Shapes:
    """Numbers of tags by their text and by their kind, and shapes by the numbers, within bounds of memory."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.kept, self.by_raw, self.numbers, self.kinds, self.shapes = 0, {}, {}, [], {}

    def number(self, told: tuple[str, bool, bool, str]) -> int:
        """The number of a kind."""
        if told not in self.numbers:
            self.numbers[told] = len(self.kinds)
            self.kinds.append(told)
        return self.numbers[told]

    def of(self, raws: list[str]) -> Shape | None:
        """The shape of plain tags; None if one isn't."""
        if len(self.by_raw) > self.most or self.kept > self.most:
            self.forget()
        found = list(map(self.by_raw.get, raws))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    told = kind(raws[i])
                    if told is None:
                        return None
                    found[i] = self.by_raw[raws[i]] = self.number(told)
        key = tuple(found)
        shape = self.shapes.get(key)
        if shape is None:
            shape = self.shapes[key] = Shape(self.kinds[n] for n in key)
            self.kept += len(key)
        return shape


SHAPES = Shapes()


class Node:
    """An element of a page, by its place in the page's shape; -1 is the whole page."""

    __slots__ = ("at", "page")

    def __init__(self, page: Tree, at: int):
        self.page, self.at = page, at

    @property
    def attrs(self) -> dict[str, str]:
        return {} if self.at < 0 else self.page.attributes(self.page.shape.tag_at[self.at])

    def text(self) -> str:
        shape = self.page.shape
        return self.page.text(shape.tag_at[self.at] + 1, shape.last_text[self.at]) if self.at >= 0 else self.page.text(0, None)

    def has(self, cls: str) -> bool:
        return cls in self.attrs.get("class", "").split()

    def places(self, tag: str | None, cls: str | None) -> Iterator[int]:
        page, at = self.page, self.at
        shape = page.shape
        found = shape.by_class.get(cls, ()) if cls is not None else shape.by_tag.get(tag, ()) if tag is not None else range(len(shape.end))
        if at >= 0 and found:
            found = found[bisect_right(found, at) : bisect_left(found, shape.end[at])]
        return (n for n in found if shape.names[n] == tag) if cls is not None and tag is not None else iter(found)

    def all(self, tag: str | None = None, cls: str | None = None) -> list[Node]:
        """Descendants in document order, by tag, class or both."""
        return [Node(self.page, n) for n in self.places(tag, cls)]

    def first(self, tag: str | None = None, cls: str | None = None) -> Node | None:
        at = next(self.places(tag, cls), None)
        return None if at is None else Node(self.page, at)


class Tree(HTMLParser):
    """A forgiving tree of a page: an element of ENDS ends where a next one of its kind begins in the same parent, other
    elements that are never closed end with their parent. Pages of plain tags alone are cut at their brackets; others are
    left to the standard parser, which is slower and says the same of plain ones."""

    def __init__(self, html: str):
        html = html or ""
        self.root = Node(self, -1)
        self.tags: list = []
        self.shape = None
        self.plain = BY_TURNS.fullmatch(html) is not None
        if self.plain:
            pieces = html.replace(">", "<").split("<")
            self.texts, self.tags = pieces[::2], pieces[1::2]
            self.shape = SHAPES.of(self.tags)
        if self.shape is None:
            self.plain, self.tags, self.texts = False, [], [""]
            super().__init__(convert_charrefs=True)
            self.feed(html)
            self.close()
            self.shape = Shape((tag, attrs is None, False, (attrs or {}).get("class", "")) for tag, attrs in self.tags)

    def attributes(self, at: int) -> dict[str, str]:
        return attributes(self.tags[at]) if self.plain else self.tags[at][1]

    def text(self, first: int, last: int | None) -> str:
        found = self.texts[first:last]
        text = "".join(found)
        return " ".join(("".join(map(unescape, found)) if self.plain and "&" in text else text).split())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags.append((tag, {k: v or "" for k, v in attrs}))
        self.texts.append("")

    def handle_endtag(self, tag: str) -> None:
        self.tags.append((tag, None))
        self.texts.append("")

    def handle_data(self, data: str) -> None:
        self.texts[-1] += data


def txt(node: Node | None) -> str | None:
    return node.text() if node is not None else None


def exhibition(root: Node) -> dict[str, tuple[int, str]]:
    """Course (position) and text by lane from the start exhibition or start table."""
    out = {}
    for i, unit in enumerate(root.all(cls="table1_boatImage1"), 1):
        lane = txt(unit.first(cls="table1_boatImage1Number"))
        if lane:
            out[lane] = (i, txt(unit.first(cls="table1_boatImage1TimeInner") or unit.first(cls="table1_boatImage1Time")) or "")
    return out


def unit_text(root: Node, kind: str, part: str = "weather1_bodyUnitLabelData") -> str | None:
    return next((txt(n.first(cls=part)) for n in root.all(cls=kind) if n.first(cls=part) is not None), None) or None


def weather_of(root: Node) -> dict:
    arrow = next((n.first("p") for n in root.all(cls="is-windDirection")), None)
    icon = (arrow.attrs.get("class", "").split() or [None])[-1] if arrow is not None else None
    return {
        "obs_time_label": txt(root.first(cls="weather1_title")) or None, "weather_txt": unit_text(root, "is-weather", "weather1_bodyUnitLabelTitle"), "air_temp_raw": unit_text(root, "is-direction"),
        "wind_speed_raw": unit_text(root, "is-wind"), "water_temp_raw": unit_text(root, "is-waterTemperature"), "wave_height_raw": unit_text(root, "is-wave"), "wind_dir_raw": icon,
    }


WEATHER_FIELDS = "obs_time_label:string,weather_txt:string,air_temp_raw:string,wind_speed_raw:string,water_temp_raw:string,wave_height_raw:string,wind_dir_raw:string"
HEADING = {"place": "string", "race_title": "string", "date_label": "string"}
BEFORE_FIELDS = HEADING | {
    "racers": "array<struct<lane:int,racer_id:string,name:string,weight:string,adjust_weight:string,exhibition_time:string,tilt:string,photo:string,st_time_raw:string,course:int>>",
    "weather": f"struct<{WEATHER_FIELDS}>",
}
RESULT_FIELDS = HEADING | {
    "race_no": "string", "finishers": "array<struct<position:string,lane:int,racer_no:string,racer_name:string,time:string,course:int,st_time:string,tactic:string>>",
    "payouts": "array<struct<bet_type:string,combination:string,payout_yen:int,popularity:int>>", "weather": f"struct<{WEATHER_FIELDS}>",
}


def fields_of(fields: dict[str, str], *names: str) -> str:
    return ",".join(f"{n}:{fields[n]}" for n in names or fields)


BEFORE, RESULT = fields_of(BEFORE_FIELDS), fields_of(RESULT_FIELDS)
INDEX = "races:array<struct<label:string,time:string,href:string>>"


def heading(root: Node) -> dict:
    area = root.first(cls="heading2_area")
    image = area.first("img") if area is not None else None
    tabs = root.first(cls="tab2_tabs")
    active = tabs.first("li", "is-active2") if tabs is not None else None
    return {"place": image.attrs.get("alt") if image is not None else None, "race_title": txt(root.first(cls="heading2_titleName")), "date_label": txt(active)}


def whole_number(s: str | None) -> int | None:
    digits = re.sub(r"[^0-9]", "", s or "")
    return n if digits and (n := int(digits)) < 2**31 else None


def before_page(html: str, wanted: Container[str] = BEFORE_FIELDS) -> dict | None:
    """The pre-race page; None for pages without data, error pages and cancelled days. Without a start exhibition the
    racers and the weather are left out, as are parts that aren't wanted."""
    root = Tree(html).root
    label = txt(root.first(cls="heading1_mainLabel")) or ""
    head = heading(root)
    if "データがありません" in label or "エラー" in label or "中止" in (head["date_label"] or "") or not head["race_title"]:
        return None
    shown, racers = exhibition(root) if "racers" in wanted or "weather" in wanted else {}, []
    for body in (b for t in root.all("table", "is-w748") for b in t.all("tbody", "is-fs12")) if "racers" in wanted and shown else ():
        cells = body.all("td")
        lane = next((c for c in cells if "is-boatColor" in c.attrs.get("class", "")), None)
        link = next((a for a in body.all("a") if "profile?toban=" in a.attrs.get("href", "") and a.text()), None)
        if lane is None or link is None:
            continue
        texts = [c.text() for c in cells]
        where = lambda pattern, after=0: next((i for i in range(after, len(texts)) if re.search(pattern, texts[i])), None)
        kg, time = where("kg"), where(r"^\d+\.\d{2}$")
        adjusted = where(r"^\d+\.\d$", kg + 1) if kg is not None else None
        course, st = shown.get(lane.text(), (None, None))
        image = body.first("img")
        racers.append({
            "lane": whole_number(lane.text()), "racer_id": re.search(r"toban=(\d+)", link.attrs["href"])[1], "name": link.text(), "weight": texts[kg] if kg is not None else None,
            "adjust_weight": texts[adjusted] if adjusted is not None else None, "exhibition_time": texts[time] if time is not None else None,
            "tilt": texts[time + 1] if time is not None and time + 1 < len(texts) else None, "photo": image.attrs.get("src") if image is not None else None, "st_time_raw": st, "course": course,
        })
    racers.sort(key=lambda r: r["lane"] or 0)
    return {**head, "racers": racers, "weather": weather_of(root) if shown and "weather" in wanted else None}


def result_page(html: str, wanted: Container[str] = RESULT_FIELDS) -> dict | None:
    root = Tree(html).root
    tables = {txt((t.first("thead") or t).first("th")): t for t in root.all("table", "is-w495")}
    shown, finishers, payouts = exhibition(root) if "finishers" in wanted else {}, [], []
    for body in tables["着"].all("tbody") if "着" in tables and "finishers" in wanted else []:
        cells = (body.first("tr") or body).all("td")
        if len(cells) < 4:
            continue
        spans = cells[2].all("span")
        course, st = shown.get(cells[1].text(), (None, ""))
        parts = (st or "").split()
        finishers.append({"position": cells[0].text(), "lane": whole_number(cells[1].text()), "racer_no": spans[0].text() if spans else None, "racer_name": spans[1].text() if len(spans) > 1 else cells[2].text(), "time": cells[3].text(), "course": course, "st_time": parts[0] if parts else None, "tactic": parts[1] if len(parts) > 1 else None})
    for row in tables["勝式"].all("tr") if "勝式" in tables and "payouts" in wanted else []:
        cells = row.all("td")
        if len(cells) >= 4 and cells[0].text():
            payouts.append({"bet_type": cells[0].text(), "combination": cells[1].text(), "payout_yen": whole_number(cells[2].text()), "popularity": whole_number(cells[3].text())})
    tabs = root.first(cls="tab3_tabs")
    number = next((m[1] for a in (tabs.all("a") if tabs is not None else []) if (m := re.search(r"rno=(\d{1,2})", a.attrs.get("href", "")))), None)
    return {**heading(root), "race_no": number, "finishers": finishers, "payouts": payouts, "weather": weather_of(root) if "weather" in wanted else None}


def index_page(html: str, wanted: Container[str] = ()) -> dict | None:
    rows = []
    for table in (t for d in Tree(html).root.all("div", "table1") for t in d.all("table")):
        for row in (r for b in table.all("tbody") for r in b.all("tr")):
            cells = row.all("td")
            link = next((a for a in cells[0].all("a") if "racelist" in a.attrs.get("href", "")), None) if len(cells) > 1 else None
            if link is not None:
                rows.append({"label": link.text(), "time": cells[1].text(), "href": link.attrs["href"]})
    return {"races": rows}


def extract(pages: DataFrame, page: Callable[[str, Container[str]], dict | None], fields: str) -> DataFrame:
    """path and the fields of every page that has data; a page that can't be parsed has none and ends no job."""
    parts = to_arrow_schema(T.StructType.fromDDL(fields))
    wanted = set(parts.names)

    def parsed(html: str | None) -> dict | None:
        try:
            return page(html, wanted) if html else None
        except (AssertionError, AttributeError, IndexError, KeyError, TypeError, ValueError):  # whatever odd markup meets
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, html = b.columns
            for k in range(0, len(html), 1000):
                found = pa.array((parsed(x.as_py()) for x in html[k : k + 1000]), pa.struct(list(parts)))
                yield pa.RecordBatch.from_arrays([path[k : k + 1000], found], ["path", "page"])

    return pages.select(F.col("path").cast("string"), "html").mapInArrow(run, f"path string, page struct<{fields}>").where("page is not null").select("path", "page.*")


def before_rows(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Racer rows, weather rows and meta rows of pre-race pages, each from its parts of the pages alone."""
    found = lambda *names: extract(pages, before_page, fields_of(BEFORE_FIELDS, *names)).withColumn("place", C.spaced_place(F.col("place")))
    return found("place", "racers").select("path", "place", F.inline("racers")), found("place", "weather").where("weather is not null").select("path", "place", "weather.*"), found("place", "race_title", "date_label")


def result_rows(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Finisher rows, payout rows and weather rows of result pages, each from its parts of the pages alone."""
    found = lambda *names: extract(pages, result_page, fields_of(RESULT_FIELDS, *names))
    return found(*HEADING, "race_no", "finishers").select("path", "place", "race_title", "date_label", "race_no", F.inline("finishers")), found("place", "race_no", "payouts").select("path", "place", "race_no", F.inline("payouts")), found("place", "race_no", "weather").select("path", "place", "race_no", "weather.*")


def query_value(href: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(href, rf"[?&]{key}=([^&#]*)", 1), F.lit(""))


def closing_times(pages: DataFrame) -> DataFrame:
    """rno, time, close_ts (time zone +09:00), jcd, hd and href of the races of index pages; sort by rno to show them."""
    rows = extract(pages, index_page, INDEX).select("path", F.inline("races"))
    hd = query_value(F.col("href"), "hd")
    rno = F.coalesce(query_value(F.col("href"), "rno").try_cast("int"), F.regexp_extract("label", r"(\d+)\s*R", 1).try_cast("int"))
    ok = hd.rlike(r"^\d{8}$") & F.col("time").rlike(r"^\d{1,2}:\d{2}$")
    stamp = F.when(ok, F.try_to_timestamp(F.concat(hd, F.lit(" "), F.lpad("time", 5, "0"), F.lit("+09:00")), F.lit("yyyyMMdd HH:mmXXX")))
    return rows.select("path", rno.alias("rno"), "time", stamp.alias("close_ts"), query_value(F.col("href"), "jcd").alias("jcd"), hd.alias("hd"), "href")


def race_numbers(html: Column) -> Column:
    """The distinct race numbers 1 to 12 that a page links to, ascending."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"rno=(\d{1,2})"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.between(1, 12))))
