"""Main text of web pages by wrappers inferred from pages of the same host.

A page becomes a stream of tags and texts, nested by the usual rules for tags left open. A wrapper is a regular
expression without unions over such streams: elements in order, each required or optional, once or repeated, with slots
for texts. It starts as one page and is aligned with the next: equal runs of neighbours fold into a repeated group, an
element found on one side only becomes optional, texts that differ become a slot, and this goes on inside every pair
of elements that match. Every page is matched with the wrapper of its host and layout: a text that the wrapper holds outside repeated
groups, the same on pages with different titles, is template and goes; slots and repeated groups stay. The main region is
chosen on every page by where the text is that stays.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.chunked import blocks
from strataframe.session import settle

# Quotes count only where an attribute's value begins; a comment may be empty (`<!-->`) and may end in `--!>`.
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"""
    r"""|</?[a-zA-Z](?>[^>=]++|=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)|=)*+>|[^<]+|<""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = {"script", "style", "title", "textarea", "noscript", "xmp"}
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li",
         "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
KEEPS_OPEN = {"table", "ul", "ol", "dl", "select"}
ASIDE = {"head", "nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "button", "select",
         "textarea", "iframe", "object", "svg", "canvas", "audio", "video", "title", "menu", "dialog", "xmp", "input"}
ASIDE_WORDS = set(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "discussion disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted recommended related replies reply respond responses search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
INTO = {"html", "body", "div", "section", "center", "table", "tbody", "tr", "td", "article", "main"}
CONTENT = {"h1", "h2", "h3", "p", "article", "main", "section"}
OUTER = {"html", "body", "div", "section", "main", "article", "center", "table"}
OUTER_DEPTH = 5
WITNESSES = 3  # pages with different titles that show a text to be part of the template
HELD = 300_000  # parts of wrappers that a task keeps before it hands them on
SALTS = 16
CELLS = 200_000  # of one table of an alignment; longer sides are divided where a longest common subsequence may be
SMALL = 100_000  # rows and sets of constants that may be sent to all tasks
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # merging goes as deep as the pages


class Node:
    __slots__ = ("sig", "tag", "children", "mass", "aside")

    def __init__(self, sig: str, tag: str):
        self.sig, self.tag, self.children, self.mass, self.aside = sig, tag, [], 0, tag in ASIDE


@lru_cache(maxsize=65536)
def signature(token: str, tag: str) -> str:
    """The tag with its classes and role, and an id of the word list, without digits: what tells elements of a template apart."""
    marks = set()
    for kind, x, y, z in MARKS.findall(token):
        for w in (x or y or z).lower().split():
            w = re.sub(r"\d+", "", w).strip("_-").replace(".", "-")
            if w and (kind.lower() != "id" or w in ASIDE_WORDS):
                marks.add(w)
    return tag + "".join("." + w for w in sorted(marks))


def parse(page: str) -> Node:
    """Elements and texts of a page; texts are strings among the children."""
    root = Node("", "")
    stack, at = [root], 0
    unclosed: Counter = Counter()

    def leave(k: int) -> None:
        unclosed.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while m := TOKEN.match(page, at):
        t, at = m[0], m.end()
        if not t.startswith("<") or t == "<":
            stack[-1].children.append(t)
        elif t.startswith("<![CDATA["):
            stack[-1].children.append(entities.escape(t[9:].removesuffix("]]>")))
        elif t[1] in "!?":
            continue
        elif t[1] == "/":
            tag = NAME.match(t)[1].lower()
            if unclosed[tag] > 0:
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
        else:
            tag = NAME.match(t)[1].lower()
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
            for k in range(len(stack) - 1, 0, -1) if any(unclosed[e] > 0 for e in ends) else ():
                if stack[k].tag in ends:
                    leave(k)
                    break
                if stack[k].tag in KEEPS_OPEN or (stack[k].tag in BLOCK and stack[k].tag not in CLOSES):
                    break
            node = Node(signature(t, tag), tag)
            stack[-1].children.append(node)
            if tag not in VOID:  # a slash at the end closes nothing
                stack.append(node)
                unclosed[tag] += 1
                if tag in RAW:  # nothing but its own closing tag is a tag in there
                    end = RAW_END[tag].search(page, at)
                    stop = end.start() if end else len(page)
                    if stop > at:
                        node.children.append(page[at:stop])
                    at = stop
    return root


# A wrapper is nested lists: ["#", text or None, witnesses] is a text, by its digest, or a slot, and [sig, [parts]] an element; a part is
# [items, optional, repeated] with one item, or several that repeat together.


def digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def witness(root: Node) -> str:
    """The digest of the title, or of the longest text if there is none: copies of a page are one witness."""
    longest, todo = "", [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                if text and node.tag == "title":
                    return digest(text)
                longest = max(longest, text, key=len)
            elif c.tag == "title" or c.tag not in RAW:
                todo.append(c)
    return digest(longest)


def layout(root: Node) -> int:
    """A number for the outer elements: the set of their paths of tags."""
    seen, todo = {""}, [(root, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        for c in node.children:
            if not isinstance(c, str) and c.tag in OUTER:
                seen.add(f"{path}/{c.tag}")
                if depth + 1 < OUTER_DEPTH:
                    todo.append((c, f"{path}/{c.tag}", depth + 1))
    return int.from_bytes(blake2b(" ".join(sorted(seen)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def of_page(node: Node, seen: str = "") -> list:
    """The wrapper of one page; children are done before their parents, on a stack of its own. Elements of `ASIDE` stay empty."""
    order, todo, made = [], [node], {}
    while todo:
        order.append(todo.pop())
        if order[-1].tag not in ASIDE:
            todo += [c for c in order[-1].children if not isinstance(c, str)]
    for n in reversed(order):
        parts = []
        for c in n.children if n.tag not in ASIDE else ():
            if isinstance(c, str):
                text = " ".join(c.split())
                if text:
                    parts.append([[["#", digest(text), [seen]]], False, False])
            else:
                parts.append([[made.pop(id(c))], False, False])
        made[id(n)] = [n.sig, fold(parts)]
    return made[id(node)]


def key(part: list) -> tuple:
    return tuple(item[0] for item in part[0])


def fold(parts: list) -> list:
    """Neighbouring runs of up to three parts that follow each other become one repeated group."""
    for width in (1, 2, 3):
        out: list = []
        for part in parts:
            out.append(part)
            while len(out) >= 2 * width:
                a, b = out[-2 * width : -width], out[-width:]
                if [key(x) for x in a] != [key(x) for x in b] or width > 1 and any(x[1] or x[2] for x in a + b):
                    break
                items = [merge(x, y) for p, q in zip(a, b) for x, y in zip(p[0], q[0])]
                out[-2 * width :] = [[items, all(x[1] for x in a + b), True]]
                if width > 1:
                    break
        parts = absorb(out)
    return parts


def absorb(parts: list) -> list:
    """A run that repeats the group in front of it joins that group."""
    out: list = []
    i = 0
    while i < len(parts):
        if out and out[-1][2] and len(out[-1][0]) > 1:
            n = len(out[-1][0])
            run = parts[i : i + n]
            if len(run) == n and all(len(p[0]) == 1 and not p[1] and not p[2] for p in run) and tuple(p[0][0][0] for p in run) == key(out[-1]):
                out[-1][0] = [merge(x, p[0][0]) for x, p in zip(out[-1][0], run)]
                i += n
                continue
        out.append(parts[i])
        i += 1
    return out


def merge(a: list, b: list) -> list:
    """The wrapper of two elements, or of two texts, of one kind."""
    if a[0] == "#":
        return ["#", a[1], sorted({*a[2], *b[2]})[:WITNESSES]] if a[1] == b[1] else ["#", None, []]
    return [a[0], align(a[1], b[1])]


def align(a: list, b: list) -> list:
    """A longest common subsequence is matched part by part; what stands on one side only becomes optional."""
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    start = 0
    while start < min(len(a), len(b)) and ka[start] == kb[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and ka[-1 - stop] == kb[-1 - stop]:
        stop += 1
    n, m = len(a) - stop, len(b) - stop
    pairs = common(ka[start:n], kb[start:m])
    pairs = [(k, k) for k in range(start)] + [(start + i, start + j) for i, j in pairs] + [(n + k, m + k) for k in range(stop)]
    out, i, j = [], 0, 0
    for x, y in pairs + [(len(a), len(b))]:
        out += [[p[0], True, p[2]] for p in a[i:x]] + [[p[0], True, p[2]] for p in b[j:y]]
        if x < len(a):
            p, q = a[x], b[y]
            out.append([[merge(u, v) for u, v in zip(p[0], q[0])], p[1] or q[1], p[2] or q[2]])
        i, j = x + 1, y + 1
    return fold(out)


def lengths(a: list, b: list) -> list[int]:
    """Lengths of the longest common subsequences of `a` with each beginning of `b`, a row of the table as bits."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    steps = bin(row | 1 << len(b))[:2:-1]  # a 0 where the length grows
    return [0, *accumulate(c == "0" for c in steps)]


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Memory is bounded by a table, as large problems are halved (Hirschberg)."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n == 1:
        return [(0, b.index(a[0]))] if a[0] in b else []
    out = []
    if n * m > CELLS:
        half = n // 2
        left, right = lengths(a[:half], b), lengths(a[half:][::-1], b[::-1])
        cut = max(range(m + 1), key=lambda j: left[j] + right[m - j])
        return common(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in common(a[half:], b[cut:])]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def infer(pages: list[str]) -> list:
    """The wrapper of some pages."""
    wrapper = None
    for page in pages:
        root = parse(page)
        one = of_page(root, witness(root))
        wrapper = one if wrapper is None else merge(wrapper, one)
    return wrapper


def nodes_of(wrapper: list) -> list:
    """Elements and texts, parents before children."""
    order, todo = [], [wrapper]
    while todo:
        order.append(todo.pop())
        if order[-1][0] != "#":
            todo += [item for part in order[-1][1] for item in part[0]]
    return order


def write_wrapper(wrapper: list) -> bytes:
    """A flat list, children in front of their parents and named by their places, so that depth does not matter."""
    rows, place = [], {}
    for n in reversed(nodes_of(wrapper)):
        place[id(n)] = len(rows)
        rows.append(n if n[0] == "#" else [n[0], [[[place[id(x)] for x in p[0]], p[1], p[2]] for p in n[1]]])
    return zlib.compress(json.dumps(rows, separators=(",", ":")).encode(), 1)


def read_wrapper(data: bytes) -> list:
    rows: list = []
    for n in json.loads(zlib.decompress(data)):
        rows.append(n if n[0] == "#" else [n[0], [[[rows[k] for k in p[0]], p[1], p[2]] for p in n[1]]])
    return rows[-1]


@lru_cache(maxsize=65536)
def place(parent: bytes, word: str) -> bytes:
    """Where an element is, by the signatures that lead there; or a text, by its digest, in an element."""
    return blake2b(parent + word.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def constants(wrapper: list) -> bytes:
    """The places of texts outside repeated groups that are the same on pages with different titles."""
    found, todo = set(), [(wrapper, b"")]
    while todo:
        node, at = todo.pop()
        for items, _, repeated in node[1]:
            for x in items if not repeated else ():
                if x[0] != "#":
                    todo.append((x, place(at, x[0])))
                elif x[1] is not None and len(x[2]) >= WITNESSES:
                    found.add(place(at, x[1]))
    return b"".join(sorted(found))


@lru_cache(maxsize=4096)
def read_constants(data: bytes) -> frozenset:
    return frozenset(data[k : k + 8] for k in range(0, len(data), 8))


def drop_constants(root: Node, known: frozenset) -> None:
    todo = [(root, b"")]
    while todo:
        node, at = todo.pop()
        kept = []
        for c in node.children:
            if not isinstance(c, str):
                todo.append((c, place(at, c.sig)))
            elif place(at, digest(" ".join(c.split()))) in known:
                continue
            kept.append(c)
        node.children = kept


@lru_cache(maxsize=65536)
def listed(sig: str) -> bool:
    return any(w in ASIDE_WORDS for w in sig.split(".")[1:])


def add_up(root: Node) -> list[Node]:
    """Adds up characters of text outside links and asides below every element; elements in order, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.mass = 0
        todo += [c for c in node.children if not isinstance(c, str) and not c.aside]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.mass += len(c.strip())
            elif c.tag != "a" and not c.aside:
                node.mass += c.mass
    return order


def measure(root: Node) -> None:
    """Masses, with what the word list takes for an aside.

    A listed name makes an element an aside unless it holds half the text of the article or main element around it; or of
    the page, if all such elements are in listed ones.
    """
    order = add_up(root)
    if not any(listed(n.sig) for n in order):
        return
    inside, free, todo = {id(root): root}, False, [(root, False)]
    while todo:
        node, under = todo.pop()
        for c in node.children:
            if not isinstance(c, str) and not c.aside:
                main = c.tag in ("article", "main")
                inside[id(c)] = c if main else inside[id(node)]
                marked = under or listed(c.sig)
                free = free or main and not marked
                todo.append((c, marked))
    around = {id(c): inside[id(n)] for n in order for c in n.children if not isinstance(c, str) and not c.aside}
    for node in order[1:]:
        if listed(node.sig):
            whole = around[id(node)]
            node.aside = 2 * node.mass < whole.mass or whole is root and free and node.tag not in ("html", "body") and not holds_main(node)
    add_up(root)


def holds_main(node: Node) -> bool:
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag in ("article", "main"):
            return True
        todo += [c for c in x.children if not isinstance(c, str)]
    return False


def region(root: Node) -> Node:
    """The innermost element that keeps nearly all text of the page.

    A step down leaves no heading, paragraph or further section behind, and all steps together at most a twentieth.
    """
    node = root
    while True:
        full = [c for c in node.children if not isinstance(c, str) and not c.aside and c.mass]
        best = max(full, key=lambda c: c.mass, default=None)
        if best is None or best.tag not in INTO or 20 * best.mass < 19 * root.mass:
            return node
        if any(c is not best and c.tag in CONTENT for c in full):
            return node
        node = best


def text_of(node: Node) -> str:
    """Blocks of an element in page order, joined by a space; white space inside a block is one space."""
    out, run, todo = [], [], [node]

    def close() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    while todo:
        c = todo.pop()
        if c is None:
            close()
        elif isinstance(c, str):
            run.append(c)
        elif c is node or not c.aside:
            if c.tag in BLOCK or c.tag == "br" or c.tag == "":
                close()
                todo.append(None)
            todo.extend(reversed(c.children))
    close()
    return " ".join(out)


def extract(page: str | None, template: bytes | None = None) -> str:
    """The main text of a page without the constants of its wrapper; a page that has nothing else keeps them."""
    if not page:
        return ""
    root = parse(page)
    if template:
        drop_constants(root, read_constants(template))
    measure(root)
    if template and not root.mass:
        return extract(page)
    return text_of(region(root))


def host_of(url: Column) -> Column:
    """Lower-case host of an address; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


LAID = "host string, layout long, salt int, wrapper binary"


def laid(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                      names=["host", "layout", "salt", "wrapper"])


def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges wrappers that follow each other and have the same host, layout and salt."""
    last, held, out = None, None, []
    for b in batches:
        for *at, data in zip(*(c.to_pylist() for c in b.columns)):
            if at == last:
                held = merge(read_wrapper(held) if isinstance(held, bytes) else held, read_wrapper(data))
                continue
            if last is not None:
                out.append((*last, held if isinstance(held, bytes) else write_wrapper(held)))
            last, held = at, data
            if len(out) >= 500:
                yield laid(out)
                out = []
    if last is not None:
        yield laid([*out, (*last, held if isinstance(held, bytes) else write_wrapper(held))])


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`host, layout, wrapper` from all pages.

    Each task merges the pages it reads, by host and layout; what tasks have found is merged first by a salt and then whole, so
    a large host gives a task at most a wrapper for each salt.
    """
    p = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where(F.length("html") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, salt = {}, 0, TaskContext.get().partitionId() % SALTS
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                root = parse(page.as_py())
                at = (host, layout(root))
                one = of_page(root, witness(root))
                old = held.get(at)
                if old:
                    wrapper = merge(old[0], one)
                    grown = len(nodes_of(wrapper))
                else:
                    wrapper, grown = one, len(nodes_of(one))
                held[at] = (wrapper, grown)
                size += grown - (old[1] if old else 0)
                if size > HELD:
                    yield laid([(*k, salt, write_wrapper(w)) for k, (w, _) in held.items()])
                    held, size = {}, 0
        yield laid([(*k, salt, write_wrapper(w)) for k, (w, _) in held.items()])

    part = p.mapInArrow(run, LAID).repartition("host", "layout", "salt").sortWithinPartitions("host", "layout", "salt", "wrapper")
    whole = part.mapInArrow(fuse, LAID).withColumn("salt", F.lit(0)).repartition("host", "layout")
    return whole.sortWithinPartitions("host", "layout", "wrapper").mapInArrow(fuse, LAID).drop("salt")


def find_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame | None:
    """`host, layout, template` for wrappers that have constants, written; none if no wrapper has.

    With few of them Spark is told to send them to all tasks, else it shuffles.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, n, constants(read_wrapper(w))) for h, n, w in zip(*(c.to_pylist() for c in b.columns))]
            rows = [r for r in rows if r[2]]
            kinds = (pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                             names=["host", "layout", "template"])

    found = settle(infer_wrappers(pages, url, html).mapInArrow(run, "host string, layout long, template binary"), "templates")
    rows, size = found.agg(F.count("*"), F.sum(F.length("template"))).first()
    return None if not rows else F.broadcast(found) if rows + size // 8 <= SMALL else found


def extract_main(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`page_id, url, text, n_chars` for every page.

    A null or empty page has an empty text. Pages without a host share one group. Repeated rows stay; other columns are
    ignored.
    """
    templates = find_templates(pages, url, html)
    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [layout(parse(t)) if t else None for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=["page_id", "url", "html", "host", "layout"])

    if templates is None:
        source = source.withColumn("template", F.lit(None).cast("binary"))
    else:
        hosts = source.withColumn("host", host_of(F.col("url")))
        source = hosts.mapInArrow(locate, "page_id long, url string, html string, host string, layout long").join(
            templates, ["host", "layout"], "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, known = b.column(2).to_pylist(), b.column(3).to_pylist()
            for s in blocks(texts):
                found = [extract(t, k) for t, k in zip(texts[s], known[s])]
                n = s.stop - s.start
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.start, n), b.column(1).slice(s.start, n), pa.array(found, pa.string()),
                     pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
