"""HTML extraction: wrappers of hosts as union-free regular expressions over elements and text slots.

A wrapper is inferred by aligning the pages of a host one after another. For each element it has the sequence of what
stands in it: groups of labels, each optional if some pages lack it and repeated if it comes back; text is a slot. The
slots' sizes over all pages then say which element is the article and which texts are the template's own.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import names_apart, others, stored, table
from .urls import host_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<raw>script|style|textarea|noscript|template|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<[!?][^>]*>?|</?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)"
    r"|</?[a-zA-Z][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
MARK = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)

#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_ITSELF = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
FURNITURE = frozenset("head nav header footer aside form button select option dialog menu noscript template svg".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
#: Words in class and id attributes that name page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices popup promo related replies respond share sharing "
    "sidebar skip social sponsor sponsored subscribe toc toolbar widget".split()
)
#: Words that stand beside those in names of furniture, and say only where it is or how it is built.
PLACE_WORDS = frozenset(
    "and area articles bar block body bottom box btn button buttons card col column container content entries first form global grid group head holder home "
    "icon icons inline inner item items js last layout left line link links list local main major message mobile module nav no outer overlay page panel placeholder "
    "post posts primary rail region right row secondary section side signup site slot stories sticky sub text the title top unit up view wrap wrapper zone".split()
)
MAIN_WORDS = frozenset("article articlebody content entry main post story body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold no others: their text counts for the container around them.
PLAIN = HEADINGS | {"p", "li"}
#: Elements that hold blocks, of which one may be the article.
CONTAINER = frozenset("html body div section main article table tbody tr td center form".split())
#: Elements that aren't told apart by class or id.
BARE = frozenset("html body p br b i em strong span a h1 h2 h3 h4 h5 h6 li dt dd u s small sub sup code img hr".split())
#: Tags that may close an open element before them.
CLOSERS = frozenset().union(*CLOSES_ITSELF.values())
#: Levels of elements that a wrapper tells apart; what is nested deeper counts as part of the last one.
DEEPEST = 150
#: Texts of a host that are counted; one on over 1/257 of its pages is among them.
COUNTED = 256


def names_furniture(name: str) -> bool:
    """Whether a class or id names page furniture: one of its parts does, and the others only say where or how (related-posts, not related-work)."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return any(x in FURNITURE_WORDS for x in parts) and all(x in FURNITURE_WORDS or x in PLACE_WORDS for x in parts)


def label(tag: str, attributes: str) -> str:
    """Name of the element in wrappers: tag, words of class and id, and =main, =likely or =off by what they say.

    =maybe: a part of a name is a word for furniture, but the name as a whole may as well be the article's own. What the
    element holds over all pages of the host decides then, see reading().
    """
    words: set[str] = set()
    whole: set[str] = set()
    role = ""
    for kind, *values in MARK.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if kind.lower() == "role":
            role = "off" if value in ROLES else "main" if value == "main" else role
        elif kind.lower() == "itemprop":
            role = "main" if value == "articlebody" else role
        else:
            whole |= {re.sub("[0-9]+", "", w) for w in value.split()}
            words |= {w for w in re.split(r"[^a-z0-9]+", value) if w}
    if tag in ("html", "body"):
        return tag
    name = tag if tag in BARE else ".".join([tag, *sorted(w for w in whole if w)])
    if tag in ("article", "main"):
        return name + ("=off" if whole & FURNITURE_WORDS or role == "off" else "=main")
    if tag in FURNITURE or role == "off" or any(map(names_furniture, whole)):
        return name + "=off"
    if role == "main":
        return name + "=main"
    if words & FURNITURE_WORDS:
        return name + "=maybe"
    return name + "=likely" * (tag in ("div", "section", "td") and bool(words & MAIN_WORDS))


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, label), ("close", tag, "") and ("text", text, "") of a page; raw elements and comments give nothing."""
    at = 0
    known: dict[tuple[str, str], str] = {}
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        tag = m["tag"]
        if tag:
            tag = tag.lower()
            if m[0][1] == "/":
                yield "close", tag, ""
            else:
                key = (tag, m["attributes"])
                if key not in known:
                    known[key] = label(*key)
                yield "open", tag, known[key]
                if m["attributes"].endswith("/") and tag not in VOID and tag not in BLOCK:
                    yield "close", tag, ""
    if at < len(page):
        yield "text", page[at:], ""


def walked(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag or text, label) with unclosed elements closed: open and close, text, break and space."""
    stack: list[tuple[str, str]] = []
    held: dict[str, int] = defaultdict(int)

    def cut(k: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > k:
            x = stack.pop()
            held[x[0]] -= 1
            yield "close", *x

    for kind, tag, name in events(page):
        if kind == "text":
            yield "text", tag, ""
        elif kind == "open" and tag in VOID:
            yield ("break" if tag == "hr" else "space"), tag, ""
        elif kind == "open":
            for k in range(len(stack) - 1, -1, -1) if tag in CLOSERS else ():
                open_tag = stack[k][0]
                if tag in CLOSES_ITSELF.get(open_tag, ()):
                    yield from cut(k)
                    break
                if open_tag in BLOCK and open_tag not in ("p",) and open_tag not in CLOSES_ITSELF:
                    break
                if open_tag in ("table", "ul", "ol", "dl"):
                    break
            stack.append((tag, name))
            held[tag] += 1
            yield "open", tag, name
        elif held[tag]:
            yield from cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
        elif tag == "p":
            yield "break", tag, ""


class Group:
    """Labels that stand in one place of a sequence; again: it comes more than once."""

    __slots__ = ("again", "labels")

    def __init__(self, labels: list[str], again: bool = False):
        self.labels, self.again = labels, again


class Element:
    """What a wrapper knows of the elements in one place: how many there were, in how many parents, and what they hold.

    chars and linked are the characters of text right in them, and those of these inside links.
    """

    __slots__ = ("n", "within", "chars", "linked", "groups", "kids")

    def __init__(self):
        self.n = self.within = self.chars = self.linked = 0
        self.groups: list[Group] = []
        self.kids: dict[str, Element] = {}

    def place(self, name: str, last: int) -> int:
        """Place in the sequence of a child that comes after the one at place last; the sequence is widened to have it.

        A label that isn't known stands on its own after last. One from further left, or the same again, closes a
        repetition: all groups from there to last become one repeated group, each label in it optional.
        """
        at = next((k for k, g in enumerate(self.groups) if name in g.labels), None)
        if at is None:
            self.groups.insert(last + 1, Group([name]))
            self.kids[name] = Element()
            return last + 1
        if at <= last:
            joined = Group([x for g in self.groups[at : last + 1] for x in g.labels], True)
            self.groups[at : last + 1] = [joined]
        return at

    def merge(self, other: Element) -> None:
        """Align the sequence of another wrapper's element with this one, child by child."""
        self.n += other.n
        self.within += other.within
        self.chars += other.chars
        self.linked += other.linked
        last = -1
        for g in other.groups:
            places = []
            for name in g.labels:
                known = name in self.kids
                at = self.place(name, last) if not known or not places else next(k for k, x in enumerate(self.groups) if name in x.labels)
                places.append(at)
                last = max(last, at)
                self.kids[name].merge(other.kids[name])
            if g.again:
                low, high = min(self.at(x) for x in g.labels), max(self.at(x) for x in g.labels)
                self.groups[low : high + 1] = [Group([x for y in self.groups[low : high + 1] for x in y.labels], True)]
                last = low

    def at(self, name: str) -> int:
        return next(k for k, g in enumerate(self.groups) if name in g.labels)

    def written(self) -> str:
        """As a regular expression: (..)+ for what comes again, ? for what may be missing, # for text."""
        made = []
        for g in self.groups:
            parts = [x + self.kids[x].written() + "?" * (self.kids[x].within < self.n) for x in g.labels]
            made.append((f"({' '.join(parts)})+" if len(parts) > 1 else parts[0] + "+") if g.again else parts[0])
        text = ["#"] if self.chars else []
        return f"({' '.join(text + made)})" if text or made else ""

    def packed(self) -> list:
        return [self.n, self.within, self.chars, self.linked, [[g.again, g.labels] for g in self.groups], {k: v.packed() for k, v in self.kids.items()}]

    @staticmethod
    def read(x: list) -> Element:
        made = Element()
        made.n, made.within, made.chars, made.linked = x[:4]
        made.groups = [Group(labels, again) for again, labels in x[4]]
        made.kids = {k: Element.read(v) for k, v in x[5].items()}
        return made


class Wrapper:
    """The wrapper of a host: its elements, its pages, and texts that many of the pages share."""

    def __init__(self, root: Element | None = None, often: dict[int, int] | None = None):
        self.root, self.often = root or Element(), often or {}

    def align(self, page: list[tuple[str, str, str]]) -> None:
        """Widen the wrapper to match one more page."""
        self.root.n += 1
        stack = [[self.root, -1, set()]]
        links = 0
        for kind, what, name in page:
            top = stack[-1]
            if kind == "text":
                n = len(what) - what.count(" ") - what.count("\n")
                top[0].chars += n
                top[0].linked += n * bool(links)
            elif kind == "open" and len(stack) > DEEPEST:
                links += what == "a"
                stack.append(top)
            elif kind == "open":
                top[1] = top[0].place(name, top[1])
                kid = top[0].kids[name]
                kid.n += 1
                if name not in top[2]:
                    top[2].add(name)
                    kid.within += 1
                links += what == "a"
                stack.append([kid, -1, set()])
            elif kind == "close":
                stack.pop()
                links -= what == "a"
        for text in {xxhash.xxh64_intdigest(x[0]) >> 11 for x in blocks(page)}:
            self.often[text] = self.often.get(text, 0) + 1
        self.trim()

    def trim(self) -> None:
        """Keep the texts that may be frequent; each loses at most 1/257 of the pages in all."""
        if len(self.often) > COUNTED:
            least = sorted(self.often.values(), reverse=True)[COUNTED]
            self.often = {k: n - least for k, n in self.often.items() if n > least}

    def merge(self, other: Wrapper) -> None:
        self.root.merge(other.root)
        for k, n in other.often.items():
            self.often[k] = self.often.get(k, 0) + n
        self.trim()

    def packed(self) -> str:
        return json.dumps([self.root.packed(), sorted(self.often.items())], separators=(",", ":"))

    @staticmethod
    def read(text: str) -> Wrapper:
        root, often = json.loads(text)
        return Wrapper(Element.read(root), {k: n for k, n in often})


def sizes(e: Element, found: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """Characters outside links in an element and all below: without furniture, and with it. For all elements, by id()."""
    own = e.chars - e.linked
    inner, every = own, own
    for name, kid in e.kids.items():
        a, b = sizes(kid, found)
        inner += 0 if name.endswith("=off") else a
        every += b
    found[id(e)] = (inner, every)
    return inner, every


def listed(e: Element, found: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """Characters in an element and all below, and those of them in links."""
    chars, linked = e.chars, e.linked
    for kid in e.kids.values():
        a, b = listed(kid, found)
        chars, linked = chars + a, linked + b
    found[id(e)] = (chars, linked)
    return chars, linked


def reading(wrapper: Wrapper) -> dict:
    """How pages of a host are read: regions, the article's place by kind and path, best first; often, the template's texts; off, furniture by path.

    An element whose name may be furniture's is so if most of the text in its place, over all pages of the host, is in links.

    An element marked as main that holds most text comes first, or the one in it that holds most of that; then one whose
    name hints at content and which holds half of a page's text; then one marked so within furniture, if it
    holds half of a page's text; at last the innermost element that still holds nearly all text.
    """
    root, of, links = wrapper.root, {}, {}
    sizes(root, of)
    listed(root, links)
    furniture: list[tuple[str, ...]] = []
    total = of[id(root)][1] / max(1, root.n)
    found: dict[str, list[tuple]] = defaultdict(list)

    def visit(e: Element, path: tuple[str, ...], off: bool) -> None:
        for g in e.groups:
            for name in g.labels:
                kid, at = e.kids[name], (*path, name)
                inner, every = of[id(kid)]
                if name.endswith("=main"):
                    found["hidden" if off else "main"].append((inner, at, kid))
                elif name.endswith("=likely") and not off:
                    found["likely"].append((inner, at, kid))
                if name.endswith("=maybe") and 2 * links[id(kid)][1] > links[id(kid)][0]:
                    furniture.append(at)
                visit(kid, at, off or name.endswith("=off"))

    visit(root, (), False)
    regions: list[tuple[str, tuple[str, ...]]] = []
    for kind in ("main", "likely", "hidden"):
        known = [x for x in found[kind] if x[0] and (kind == "main" or x[0] / x[2].n >= 0.5 * total)]
        known.sort(key=lambda x: (-x[0], x[1]))
        left = known
        while left:
            best = left[0]
            while deeper := [x for x in known if len(x[1]) > len(best[1]) and x[1][: len(best[1])] == best[1] and x[0] >= 0.5 * best[0]]:
                best = deeper[0]
            regions.append(("likely" if kind == "likely" else "main", best[1]))
            left = [x for x in left if x[1] != best[1] and x[1] != left[0][1]]
    e, path = root, ()
    while True:
        inner, every = of[id(e)]
        once = [x for g in e.groups if not g.again for x in g.labels if re.split("[.=]", x)[0] in CONTAINER or of[id(e.kids[x])][1] >= 0.9 * every]
        best = max(once, key=lambda x: of[id(e.kids[x])][1 if x.endswith("=off") else 0], default=None)
        if best is None or re.split("[.=]", best)[0] not in CONTAINER | FURNITURE:
            break
        a, b = of[id(e.kids[best])]
        if not every or (b < 0.9 * every if best.endswith("=off") else a < 0.8 * inner):
            break
        e, path = e.kids[best], (*path, best)
    regions.append(("any", path))
    half = root.n / 2 - root.n / (COUNTED + 1)
    return {"regions": regions, "often": [k for k, n in wrapper.often.items() if root.n >= 4 and n >= half], "off": furniture}


def blocks(
    page: list[tuple[str, str, str]], kind: str = "any", path: tuple[str, ...] = (), furniture: frozenset = frozenset()
) -> Iterator[tuple[str, int, int, int, bool]]:
    """(text, characters in links, container, instance, heading) of the blocks at a path of a page, without furniture below it."""
    part: list[str] = []
    linked, links, made = 0, 0, 0
    stack: list[str] = []
    holders = [0]
    inside, off, instance = not path, 0, 0

    def end() -> Iterator[tuple[str, int, int, int, bool]]:
        nonlocal linked
        line = " ".join(entities.unescape("".join(part)).split())
        if line:
            yield line, linked, holders[-1], instance, bool(stack) and re.split("[.=]", stack[-1])[0] in HEADINGS
        part.clear()
        linked = 0

    for event, what, name in page:
        if event == "text":
            if inside and not off:
                part.append(what)
                linked += len(what) * bool(links)
            continue
        if event == "space":
            part.append(" ")
            continue
        if event == "break" or what in BLOCK:
            yield from end()
        if event == "open":
            stack.append(name)
            if inside and (off or name.endswith("=maybe") and tuple(stack) in furniture or name.endswith("=off") and not (what == "header" and kind != "any")):
                off += 1
            elif not inside and len(stack) == len(path) and tuple(stack) == path:
                inside, instance = True, instance + 1
            links += what == "a"
            if what in BLOCK and what not in PLAIN:
                made += 1
                holders.append(made)
        elif event == "close":
            stack.pop()
            off -= off > 0
            links -= what == "a"
            if what in BLOCK and what not in PLAIN:
                holders.pop()
            if inside and len(stack) < len(path):
                inside = False
    yield from end()


def main_text(page: str, how: dict | None = None) -> str:
    """Blocks of the page's article, one in a line, where the reading of its host (or its own, if None) places it."""
    walk = list(walked(page))
    if how is not None:
        for kind, path in how["regions"]:
            text = region_text(walk, kind, tuple(path), set(how["often"]), frozenset(map(tuple, how["off"])))
            if text:
                return text
    own = Wrapper()
    own.align(walk)
    alone = reading(own)
    for kind, path in alone["regions"]:
        text = region_text(walk, kind, path, set(), frozenset(alone["off"]))
        if text:
            return text
    return ""


def region_text(walk: list[tuple[str, str, str]], kind: str, path: tuple[str, ...], often: set[int], furniture: frozenset) -> str:
    """The text at a path. Of several elements there those go of which most text is in links, unless all are so.

    Where no name marks the article, menus go, as containers of which most text is in links, and so do texts that half of
    the host's pages share. Such a text stays where it stands in the article: in a container that has texts of the page's own,
    between those, or as a heading before them.
    """
    found = list(blocks(walk, kind, path, furniture))
    if kind != "any":
        held: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for text, linked, _, instance, _ in found:
            held[instance][0] += len(text)
            held[instance][1] += min(linked, len(text))
        told = {k for k, (n, linked) in held.items() if 2 * linked <= n} or set(held)
        return "\n".join(x[0] for x in found if x[3] in told)
    chars: dict[int, int] = defaultdict(int)
    links: dict[int, int] = defaultdict(int)
    for text, linked, holder, _, _ in found:
        chars[holder] += len(text)
        links[holder] += min(linked, len(text))
    found = [x for x in found if 2 * links[x[2]] <= chars[x[2]]]
    shared = [xxhash.xxh64_intdigest(x[0]) >> 11 in often for x in found]
    ends: dict[int, tuple[int, int]] = {}
    for k, (x, of_all) in enumerate(zip(found, shared, strict=True)):
        if not of_all:
            ends[x[2]] = (ends.get(x[2], (k, k))[0], k)
    stays = lambda k, x: x[2] in ends and k < ends[x[2]][1] and (k > ends[x[2]][0] or x[4])
    own = [x for k, x in enumerate(found) if not shared[k] or stays(k, x)]
    return "\n".join(x[0] for x in own or found)


def wrappers_of(pages: DataFrame, fan_in: int = 32) -> DataFrame:
    """(host, wrapper): one wrapper for each host of pages (host, html), as packed().

    The pages of a host that a task reads in one batch are aligned there, so a host of a third of all pages has no
    more rows than it has batches. Those are aligned in groups of about fan_in, the wrappers of the groups again, until one
    is left: no task takes a whole host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, Wrapper] = defaultdict(Wrapper)
            for host, page in zip(b.column(0), b.column(1), strict=True):
                found[host.as_py()].align(list(walked(page.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([w.packed() for w in found.values()])], ["host", "wrapper"])

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        wrapper = Wrapper()
        for x in sorted(rows["wrapper"]):
            wrapper.merge(Wrapper.read(x))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [wrapper.packed()]})

    now = stored(pages.select("host", "html").mapInArrow(run, "host string, wrapper string"), "wrappers")
    while True:
        most = now.groupBy("host").agg(F.count(F.lit(1)).alias("k"))
        largest = most.agg(F.max("k")).first()[0] or 0
        if largest <= 1:
            return now
        parts = F.ceil(F.col("k") / fan_in).cast("long")
        dealt = now.join(most, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), parts))
        some = dealt.filter("k > 1").groupBy("host", "part").applyInPandas(lambda rows: merged(rows[["host", "wrapper"]]), "host string, wrapper string")
        now = stored(dealt.filter("k = 1").select("host", "wrapper").unionByName(some), "wrappers")


def readings(wrappers: DataFrame) -> DataFrame:
    """(host, how): the reading of each wrapper, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            how = [json.dumps(reading(Wrapper.read(x.as_py()))) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(how, pa.string())], ["host", "how"])

    return wrappers.select("host", "wrapper").mapInArrow(run, "host string, how string")


@names_apart
def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) without html, with text and n_chars (long).

    Each host's wrapper tells in which of its elements pages have their article, and which texts are the template's own; a
    page on which none of these places is found is read by a wrapper of its own. Inside the article elements of
    page furniture, by name, role or class, are left out with all they hold, as are scripts, styles and comments; what
    holds the article is never furniture. Character references are decoded, white space inside a block becomes one space,
    and blocks are joined by line feeds. Null and empty pages give an empty text; a null url is a host of its own;
    repeated rows are read one by one; columns of pages with the new names are replaced; an empty table gives an
    empty one. A task holds a page, its elements and one batch's wrappers. Pages meet their host's reading in a join that
    splits hot hosts; readings are broadcast only if Spark finds them small.
    """
    kept = others(pages, ("html", "text", "n_chars"))
    hosted = pages.select(*kept, F.coalesce("html", F.lit("")).alias("html"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("_host"))
    how = stored(readings(wrappers_of(hosted.select(F.col("_host").alias("host"), "html"))), "readings")
    met = hosted.join(how.select(F.col("host").alias("_of"), F.col("how").alias("_how")), F.col("_host") == F.col("_of"), "left")
    met = met.select(*kept, "html", "_how")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, known = len(kept), {}
        for b in batches:
            if len(known) > 1000:
                known.clear()
            texts = []
            for page, way in zip(b.column(k), b.column(k + 1).to_pylist(), strict=True):
                if way not in known:
                    known[way] = json.loads(way)
                texts.append(main_text(page.as_py(), known[way]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), pa.array(texts, pa.string())], [*kept, "text"])

    schema = StructType([*met.schema.fields[: len(kept)], StructField("text", StringType())])
    return met.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
