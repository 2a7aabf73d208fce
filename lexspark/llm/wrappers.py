"""HTML extraction by wrappers inferred from the pages of a host.

A page is a stream of block tags and text runs. The streams of one host are aligned one after another
into a union-free regular expression: texts that differ become slots, parts that only some pages have
become optional, and equal neighbours, single or in sequences, become repeated groups. The wrapper's
text slots are then sorted into main text and the rest, once a host, and each page is read through it.

A wrapper is a nested list, so that it can be pickled, merged and sent about as a value:
an element is [label, least, many, items], a group of several ["(labels)", least, many, items], a text
["#", least, many, [constant or None, times, characters, characters in links]].
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.common import BROADCAST_BYTES, release, written
from lexspark.llm.urls import host_and_path

#: Salts of a host while its wrappers are merged, and when pages meet wrappers in a shuffle.
SALTS = 16
#: Hosts whose wrappers a task holds while it reads pages; then they are passed on.
HELD_HOSTS = 2_000
#: A text that is the same on all of at least so many pages, in a wrapper that has slots, is template (see `decide`).
TEMPLATE_PAGES = 8
#: Longest sequence of neighbours that is looked at as the unit of a repeated group, and items that an
#: element's sequence may have; a longer one becomes one repeated group of all its labels.
LONGEST_UNIT, WIDEST = 6, 64
#: Elements nested deeper than this stand beside each other instead; no text is lost.
DEEPEST = 200
MAX_LINKS = 0.5

#: Comment or declaration, tag (end mark, name, attributes) or text. A quote counts after = only, and what
#: is left open ends with the page; so every place is matched once, and a page takes linear time.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|([^<]++|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg select title".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var"
    " math semantics annotation mrow mi mn mo mtext mspace ms mfrac msqrt mroot mstyle mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mtable mtr mtd".split()
)
_SPACE = frozenset("br wbr img hr".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_SIBLING_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div body nav aside main header footer form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOILER_TAGS = frozenset("nav footer aside form button dialog head menu".split())
_MAIN = re.compile(r"^(?:article|main)(?: |$)| (?:\S* )*(?:main|article|article-body|post-content|entry-content|main-content|post-body)(?: |$)")
_BOILER = re.compile(
    r"(?:^|[ _-])(?:ads?|adverts?|advertisement|advertising|banner|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent"
    r"|notice|popup|modal|newsletter|subscribe|comments?|comment-list|disqus|replies|respond|share|sharing|social|related|promo|promotion|sponsored|sponsor"
    r"|pagination|pager|toolbar|widget|skip|login|signup|search|contentinfo|complementary|hidden)(?:[ _-]|$)"
)
#: Last words of a compound that say what kind of box it is, not what is in it: `share-buttons` are about sharing.
_BOXES = frozenset(
    "area articles bar block body box button buttons column container content entry feed footer form group header holder icons inner item items"
    " label links list module panel posts region row section slot stories strip text thread title top unit wrap wrapper".split()
)


def tree(html: str | None) -> list:
    """The page as [label, children]; a child is such a list or a text run (raw text, characters in
    links). Inline tags do not part a run; raw elements and comments are left out; open elements
    end where HTML ends them by implication. Elements deeper than DEEPEST are children of that level."""
    root: list = ["html", []]
    stack, run, links, in_link = [("html", root)], [], 0, 0
    opened: Counter = Counter()

    def end_run() -> None:
        nonlocal links
        text = "".join(run)
        if text and not text.isspace():
            stack[-1][1][1].append((text, links))
        run.clear()
        links = 0

    def close(names, scope=_SCOPE) -> None:
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                end_run()
                opened.subtract(n for n, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    html, at = html or "", 0
    while found := TOKEN.search(html, at):
        at = found.end()
        text = found[4]
        if text is not None:
            run.append(text)
            if in_link:
                links += len(text)
            continue
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                in_link = 0 if found[1] else 1
            continue
        if found[1]:
            if name == "html" or name == "body":
                continue
            close({name}, ())
            in_link = 0
            continue
        if name in _SPACE:
            run.append(" ")
            if name == "hr":
                close({"p"})
                end_run()
            continue
        if name in _RAW:
            if not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name in _VOID or name in ("html", "body"):
            continue
        if name in _CLOSES_P:
            close({"p"})
        if name in _SIBLING_END:
            close(_SIBLING_END[name])
        end_run()
        label = name
        if found[3]:
            said = [k.lower() if k.lower() == "hidden" else a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(found[3])]
            label = " ".join([name, *re.sub(r"\d+", "0", " ".join(said)).lower().split()])
        node: list = [label, []]
        stack[min(len(stack) - 1, DEEPEST)][1][1].append(node)
        stack.append((name, node))
        opened[name] += 1
        in_link = 0
    end_run()
    return root


def fold(node: list) -> list:
    """The wrapper of one page: its tree with neighbours that repeat turned into groups."""
    out = []
    for child in node[1]:
        if isinstance(child, tuple):
            text = child[0] if len(child[0]) <= 400 else f"\0{xxhash.xxh3_128_hexdigest(child[0])}"  # a long text stands by its hash
            out.append(["#", 1, False, [text, 1, len(child[0]), child[1]]])
        else:
            out.append(fold(child))
    return [node[0], 1, False, collapse(out)]


def merge(a: list, b: list) -> list:
    """What covers both `a` and `b`, two items of one label."""
    if a[0] == "#":
        x, y = a[3], b[3]
        held = [x[0] if x[0] == y[0] else None, x[1] + y[1], x[2] + y[2], x[3] + y[3]]
    else:
        held = align(a[3], b[3])
    return [a[0], min(a[1], b[1]), a[2] or b[2], held]


def align(a: list, b: list) -> list:
    """Two item sequences aligned on their labels (a longest common subsequence); what stands in one
    only is optional in the outcome. Sequences are at most WIDEST long, see `collapse`."""
    x, y = [i[0] for i in a], [i[0] for i in b]
    if x == y:
        return [merge(i, j) for i, j in zip(a, b, strict=True)]
    a, b = in_groups(a, b), in_groups(b, a)
    m, n = len(a), len(b)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < m or j < n:
        if i < m and j < n and a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == n or i < m and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], 0, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], 0, *b[j][2:]])
            j += 1
    return collapse(out)


def in_groups(items: list, other: list) -> list:
    """`items` with each run that spells one turn of a group of `other` made into that group."""
    for group in other:
        if group[0][0] != "(":
            continue
        unit = [i[0] for i in group[3]]
        at = 0
        while at + len(unit) <= len(items):
            if [i[0] for i in items[at : at + len(unit)]] == unit:
                items = [*items[:at], [group[0], min(i[1] for i in items[at : at + len(unit)]), False, items[at : at + len(unit)]], *items[at + len(unit) :]]
            at += 1
    return items


def collapse(items: list) -> list:
    """Neighbours of one label become one repeated item, neighbouring equal sequences one group."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            both = merge(out[-1], item)
            both[1], both[2] = max(out[-1][1], item[1]), True
            out[-1] = both
        else:
            out.append(item)
    if len(out) > 4 * WIDEST:
        return general(out)
    size = 2
    while size <= LONGEST_UNIT and 2 * size <= len(out):
        at, changed = 0, False
        while at + 2 * size <= len(out):
            labels = [i[0] for i in out[at : at + 2 * size]]
            if labels[:size] == labels[size:]:
                held, end = out[at : at + size], at + size
                while [i[0] for i in out[end : end + size]] == labels[:size]:
                    held = [merge(i, j) for i, j in zip(held, out[end : end + size], strict=True)]
                    end += size
                out[at:end] = [["(" + "|".join(labels[:size]) + ")", 1, True, held]]
                changed = True
            at += 1
        size = 2 if changed else size + 1
    return general(out) if len(out) > WIDEST else out


def general(items: list) -> list:
    """`items` as one repeated group that has each label once, in order of labels: what long sequences of
    mixed neighbours, or many pages of different ones, come to."""
    by_label: dict[str, list] = {}
    for item in (x for i in items for x in (i[3] if i[0][0] == "(" else [i])):
        by_label[item[0]] = merge(by_label[item[0]], item) if item[0] in by_label else item
    held = [[label, 0, True, by_label[label][3]] for label in sorted(by_label)]
    return [["(" + "|".join(i[0] for i in held) + ")", 0, True, held]]


def is_boiler(label: str, in_main: bool, holds_main: bool = False) -> bool:
    """Whether an element is a menu, notice or the like, by its tag or the words of its class, id or role.
    Words do not count against what holds the main element, such as a `page with-sidebar`. In a main element a
    compound counts by what it names, so that `inline-ad` and `comment-list` go, and `related-work` and
    `comment-policy` stay."""
    name, _, rest = label.partition(" ")
    if name in _BOILER_TAGS or name == "header" and not in_main:
        return True
    if not rest or holds_main or not _BOILER.search(rest):
        return False
    return not in_main or any(map(_names_boiler, rest.split()))


def _names_boiler(word: str) -> bool:
    """Whether the last part of a compound, but for numbers and boxes, is one of a menu's, notice's or the like."""
    parts = re.split(r"[-_]+", word)
    while len(parts) > 1 and (parts[-1] in _BOXES or not parts[-1].strip("0")):
        parts.pop()
    return bool(_BOILER.search(parts[-1]))


def _holds_main(item: list, found: dict[int, bool]) -> bool:
    """Whether an article or main element stands below `item`; kept in `found` by the item's identity."""
    if item[0] == "#":
        return False
    below = [_holds_main(x, found) or x[0].split(" ", 1)[0] in ("article", "main") for x in item[3]]
    found[id(item)] = any(below)
    return found[id(item)]


def decide(wrapper: list, pages: int) -> list:
    """The wrapper for reading: [label, items, whether it is a main element] and, for texts, whether they
    are kept and whether they stand in a main element. Kept are texts outside menus, notices and the
    like; texts mostly in links and template texts are not, by what all pages of the host have there. In
    a main element, only a text whose own words are those of a notice, and no heading, can be template.
    Of a page that has article or main elements, only the texts in them are read."""
    holds: dict[int, bool] = {}
    _holds_main(wrapper, holds)

    def inside(item: list, boiler: bool, main: bool) -> tuple[bool, bool]:
        if item[0][0] == "(":
            return boiler, main
        boiler = boiler or is_boiler(item[0], main, holds[id(item)])
        return boiler, main or not boiler and bool(_MAIN.search(item[0]))

    def varies(item: list, boiler: bool, main: bool) -> bool:
        if item[0] == "#":
            return item[3][0] is None and not boiler
        boiler, main = inside(item, boiler, main)
        return any(varies(x, boiler, main) for x in item[3])

    slots = varies(wrapper, False, False)

    def keep(item: list, boiler: bool, main: bool, turns: bool, heading: bool = False):
        if item[0] == "#":
            constant, times, chars, links = item[3]
            template = slots and not turns and not item[2] and constant is not None and times >= pages >= TEMPLATE_PAGES
            template = template and (not main or not heading and bool(_BOILER.search(constant.lower())))
            linked = not main and links > MAX_LINKS * chars
            return ["#", bool(not boiler and not template and not linked), main]
        boiler, main = inside(item, boiler, main)
        heading = heading or item[0].split(" ", 1)[0] in _HEADINGS
        turns = turns or item[2]
        return [item[0], [keep(x, boiler, main, turns, heading) for x in item[3]], main]

    return keep(wrapper, False, False, False)


def read(plan: list, node: list, blocks: list[str]) -> None:
    """Walks a page along the plan of its host's wrapper and gathers the main text's blocks: those in
    the page's main elements, all that are kept if the page has none."""
    found: list[tuple[str, bool]] = []
    has_main = _walk(plan, node, found)
    blocks += [text for text, main in found if main or not has_main]


def _walk(plan: list, node: list, found: list[tuple[str, bool]]) -> bool:
    """Adds the kept texts, and whether they stand in a main element; returns whether there is such an
    element. What the wrapper does not know counts as main."""
    items, at, has_main = plan[1], [0], plan[2]
    for child in node[1]:
        label = "#" if isinstance(child, tuple) else child[0]
        item = _next(items, label, at)
        if label == "#":
            if item is None or item[1]:
                text = " ".join(unescape(child[0]).split())
                if text:
                    found.append((text, item is None or item[2]))
        elif item is not None:
            has_main |= _walk(item, child, found)
        elif not is_boiler(label, plan[2]):
            has_main |= _walk([label, [], plan[2] or bool(_MAIN.search(label))], child, found)
    return has_main


def _next(items: list, label: str, at: list[int]) -> list | None:
    """The item that takes a child of `label`: at the place reached or after it, else from the start."""
    for start, end in ((at[0], len(items)), (0, at[0])):
        for i in range(start, end):
            item = items[i]
            if item[0] == label:
                at[0] = i
                return item
            if item[0][0] == "(":
                found = _next(item[1], label, [0])
                if found is not None:
                    at[0] = i
                    return found
    return None


def _packed(wrapper: list, pages: int) -> bytes:
    return zlib.compress(pickle.dumps((wrapper, pages)), 1)


def _unpacked(data: bytes) -> tuple[list, int]:
    return pickle.loads(zlib.decompress(data))


def infer(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(host, wrapper), one row a host: the wrapper of all its pages.

    Each task folds the pages it reads into one wrapper a host (it holds HELD_HOSTS of them), so only
    wrappers are shuffled: first by host and salt, then by host, and merged one into the next as
    sorted streams. A hot host is thus merged by all tasks, and no task holds its pages.
    """

    def from_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[str, tuple[list, int]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for name, page in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    own = fold(tree(page.as_py()))
                    if name in held:
                        wrapper, n = held[name]
                        held[name] = merge(wrapper, own), n + 1
                    else:
                        held[name] = own, 1
                if len(held) > HELD_HOSTS:
                    yield _rows(held)
                    held = {}
        if held:
            yield _rows(held)

    def _rows(held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([_packed(w, n) for w, n in held.values()], pa.binary())], names=["host", "wrapper"]
        )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            out = {}
            for name, salt, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wrapper, n = _unpacked(data)
                if (name, salt) == at:
                    held = merge(held[0], wrapper), held[1] + n
                    continue
                if at is not None:
                    out[at[0]] = held
                    if len(out) > 500:
                        yield _rows(out)
                        out = {}
                at, held = (name, salt), (wrapper, n)
            if out:
                yield _rows(out)
        if at is not None:
            yield _rows({at[0]: held})

    found = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(from_pages, "host string, wrapper binary")
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))
    found = found.withColumn("salt", salt).select("host", "salt", "wrapper")
    found = found.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(merged, "host string, wrapper binary")
    found = found.withColumn("salt", F.lit(0)).select("host", "salt", "wrapper")
    return found.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(merged, "host string, wrapper binary")


def extract(pages: DataFrame, url: str = "url", html: str = "html", to: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`pages` without `html`, with the main text in column `to` (replaced if there).

    Blocks of main text, character references decoded, white space inside made one space, trimmed,
    joined by one \\n; nothing else is dropped, however long. Null and empty pages give the empty text, repeated
    pages the same text each, an empty table an empty one; other columns pass, of whatever type. The
    host is that of the url; pages without one are a host of their own. Every row comes back.

    Wrappers meet pages in a broadcast where their summed bytes are within `broadcast_bytes`; else pages
    and wrappers are shuffled by host and salt, so that no host crowds one task, a wrapper once a salt.
    """
    host, _ = host_and_path(F.col(url))
    spark = pages.sparkSession
    wrappers = written(infer(pages.select(host.alias("host"), html)), "wrappers")
    kept = [c for c in pages.columns if c not in (html, to)]
    rows = pages.select(*kept, F.col(html).alias("__html"), host.alias("__host"))
    bytes_there = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64)).first()[0] or 0
    if bytes_there <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})
        both = rows.withColumn("__wrapper", F.lit(None).cast("binary"))
    else:
        shared = None
        hashed = [c for c in kept if not re.search("map<|variant", rows.schema[c].dataType.simpleString())]
        salt = F.pmod(F.xxhash64("__html", *hashed), F.lit(SALTS))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        side = wrappers.select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in kept), F.lit(None).cast("string").alias("__html"), "host", "wrapper", every.alias("__salt"))
        both = rows.select("*", F.lit(None).cast("binary").alias("__wrapper"), salt.alias("__salt")).union(side)
        # The wrapper of a host comes before its pages, once a salt.
        both = both.repartition("__host", "__salt").sortWithinPartitions("__host", "__salt", F.col("__wrapper").isNull()).drop("__salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        plans: dict[str, list] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, made = [], []
                for row, (page, name, data) in enumerate(zip(*part.columns[-3:], strict=True)):
                    name = name.as_py()
                    if data.is_valid:  # a wrapper row
                        plans = {name: decide(*_unpacked(data.as_py()))}
                        continue
                    if name not in plans:
                        if len(plans) > HELD_HOSTS:
                            plans.clear()
                        plans[name] = decide(*_unpacked(shared.value[name]))
                    blocks: list[str] = []
                    read(plans[name], tree(page.as_py()), blocks)
                    rows.append(row)
                    made.append("\n".join(blocks))
                columns = part.columns[:-3] if len(rows) == part.num_rows else [c.take(pa.array(rows, pa.int64())) for c in part.columns[:-3]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.string())], names=[*kept, to])

    with_text = T.StructType([*(rows.schema[c] for c in kept), T.StructField(to, T.StringType())])
    return both.mapInArrow(run, with_text)
