"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page's token stream is nested by its tags: an element stands by its tag, its classes with digits blotted out, and its
mark. Pages of a host are aligned with its wrapper one after another, children in order against the wrapper's groups.
Mismatches are resolved so: elements in a row that stand by the same name are a repeated group; one that has no partner
is a repetition of a like group beside it, or meets one of its tag and a like inside whose name differs (the name becomes
a slot), or is a new group; groups that some parents lack are optional; texts that differ are slots. Anonymous containers
are told apart by what stands in them. Wrappers of any two sets of pages align in the same way: each task takes in its
own pages, partial wrappers of a host are aligned in SALTS parts and then to one, and no task ever holds a host's pages.

What a page keeps is decided by the groups that it meets when aligned with its host's wrapper. Menus, footers, sidebars,
forms and the like are dropped by tag and role. Class words that tell boilerplate are hints, which the wrapper overrules
where the group has the heading, or most of the text on most pages that have it, or most of the text of the host's slots
(reader comments and related links only by a heading). On pages with a marked article its groups are kept; on others all
the rest but the page's own header (directly in the body) and texts that are the same on all pages that have them, if
SAME_PAGES distinct pages or more do (a page of such texts alone keeps them).

Defined cases: a null or empty html gives an empty text; a null or odd url belongs to the host ""; unclosed elements end
with their parent; repeated rows are each read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import html as html_lib
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._shared import small_batches, written

#: Parts in which a host's partial wrappers are merged first, and in which pages of a host are read where wrappers are many.
SALTS = 16
#: Hosts whose wrappers a task holds before it passes them on.
HOSTS = 256
#: Wrappers are broadcast up to so many bytes; beyond, they are sorted in front of their host's pages.
BROADCAST_BYTES = 8 << 20
#: Distinct pages from which a text that never changes is the host's own.
SAME_PAGES = 3

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: An open <p> ends where one of these begins.
ENDS_P = BLOCK - frozenset("br body html head button caption td th tr tbody thead tfoot legend option".split())
CODE = frozenset(("pre", "code"))
#: An open element of these kinds ends where one of the tag begins, unless one of the others is open within it.
_LIST, _CELL, _ROWS = frozenset("ul ol menu dir table".split()), frozenset("td th".split()), frozenset("tbody thead tfoot".split())
ENDS = {
    "li": (frozenset(("li",)), _LIST),
    "dt": (frozenset("dt dd".split()), frozenset("dl table".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table".split())),
    "td": (_CELL, _ROWS | {"tr", "table"}),
    "th": (_CELL, _ROWS | {"tr", "table"}),
    "tr": (frozenset(("tr",)), _ROWS | {"table"}),
    "tbody": (_ROWS, frozenset(("table",))),
    "thead": (_ROWS, frozenset(("table",))),
    "tfoot": (_ROWS, frozenset(("table",))),
}
DROPPED = frozenset("nav footer aside form script style template noscript iframe textarea title head button select option svg canvas object audio video map dialog menu xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset("nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidenav rail footer header masthead topbar banner ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup login social share sharing sharebar related recommended recommendations comment comments commentlist disqus respond reply replies pagination pager popup modal overlay widget widgets toolbar skip copyright legal disclaimer outbrain taboola".split())
#: Of these, words of headers of pages and articles alike, and words of what readers wrote or may read next.
HEAD_WORDS = frozenset("header masthead".split())
AFTER_WORDS = frozenset("comment comments commentlist disqus respond reply replies related recommended recommendations outbrain taboola".split())
ARTICLE_WORDS = frozenset("article post entry story content articlebody maincontent".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", text, "") in page order; scripts and the like have no text."""
    at, raw = 0, None
    for m in _TOKEN.finditer(page):
        if raw:
            if m[1] and m[2].lower() == raw:
                raw = None
                yield "close", m[2].lower(), ""
                at = m.end()
            continue
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                yield "close", tag, ""
            else:
                yield "open", tag, m[3]
                if tag in RAW and not m[3].endswith("/"):
                    raw = tag
    if not raw and at < len(page):
        yield "text", page[at:], ""


def _mark(tag: str, name: str, role: str, a: dict[str, str]) -> str:
    if tag in DROPPED or role in ROLES or "hidden" in a.get("aria-hidden", ""):
        return "drop"
    if tag in ("article", "main") or role in ("main", "article") or a.get("itemprop", "") == "articleBody":
        return "article"
    if name and tag not in ("html", "body"):
        words = set(_PARTS.findall(_CAMEL.sub(" ", name).lower()))
        if words & WORDS:
            return "after" if words & AFTER_WORDS else "head" if words & WORDS <= HEAD_WORDS else "hint"
        if words & ARTICLE_WORDS and tag in ("div", "section"):
            return "article"
    return ""


@functools.lru_cache(4096)
def _kind(tag: str, attributes: str) -> tuple[str, str]:
    """The name that an element stands by, and its mark: "drop", "hint", "head" or "after" (to drop, by its words alone), "article" or ""."""
    if not attributes.strip(" /"):
        return "", "drop" if tag in DROPPED else "article" if tag in ("article", "main") else ""
    a = {x[0].lower(): x[1] or x[2] or x[3] for x in _ATTRIBUTE.findall(attributes)}
    name = f"{a.get('class', '')} {a.get('id', '')}".strip()
    return re.sub(r"[0-9]+", "#", name), _mark(tag, name, a.get("role", "").lower(), a)


#: The name of a group whose members' names differ.
ANY = "*"
HINTS = frozenset(("hint", "head", "after"))


class Group:
    """An element of a page or wrapper: how often and in how many parents it stands, its own text, its groups in order."""

    __slots__ = ("tag", "name", "mark", "times", "parents", "most", "same", "chars", "pages", "held", "leads", "titled", "groups")

    def __init__(self, tag: str = "", name: str = "", mark: str = "") -> None:
        self.tag, self.name, self.mark, self.times, self.parents, self.most = tag, name, mark, 0, 0, 1
        self.same: int | None = None  # checksum of its text, -1 where texts differ
        self.chars = 0
        self.pages: list[int] = []  # while its text is the same: the SAME_PAGES smallest digests of pages that have it
        self.held, self.leads, self.titled = 0, 0, 0  # of a hint: pages that have it, those most of whose text is in it, and those with their heading in it
        self.groups: list[Group] = []

    def text(self, checksum: int, chars: int, pages: list[int]) -> None:
        """Takes in a text by its checksum, -1 where it differs already."""
        self.same = checksum if self.same is None or self.same == checksum else -1
        self.chars += chars
        self.pages = [] if self.same == -1 else sorted({*self.pages, *pages})[:SAME_PAGES]

    def constant(self) -> bool:
        """The host's own text: the same on SAME_PAGES distinct pages or more, and on no page another."""
        return self.same not in (None, -1) and len(self.pages) >= SAME_PAGES

    def stands_by(self) -> tuple[str, str, str]:
        return self.tag, self.name, self.mark

    def anonymous(self) -> bool:
        return not self.name and self.tag in ("div", "section", "article", "main", "center", "table", "ul", "ol", "dl")

    def take(self, run: list[Group]) -> None:
        """The counts of others that stand for the same in one parent, but for parents and most. Their texts count as one."""
        for other in run:
            self.times += other.times
            self.held += other.held
            self.leads += other.leads
            self.titled += other.titled
            if self.name != other.name:
                self.name = ANY
        said = [g for g in run if g.same is not None]
        if said:
            each = [g.same for g in said]
            same = each[0] if len({*each}) == 1 else -1 if -1 in each else zlib.crc32(repr(each).encode())
            self.text(same, sum(g.chars for g in said), sorted({p for g in said for p in g.pages}))

    def preorder(self) -> Iterator[Group]:
        stack = [self]
        while stack:
            g = stack.pop()
            yield g
            stack += reversed(g.groups)

    def to_json(self) -> list:
        """A row for each group in order: its depth, then what it counts."""
        out, stack = [], [(0, self)]
        while stack:
            depth, g = stack.pop()
            out.append([depth, g.tag, g.name, g.mark, g.times, g.parents, g.most, g.same, g.chars, g.pages, g.held, g.leads, g.titled])
            stack += [(depth + 1, c) for c in reversed(g.groups)]
        return out

    @classmethod
    def from_json(cls, rows: list) -> Group:
        path: list[Group] = []
        for depth, tag, name, mark, *counts in rows:
            g = cls(tag, name, mark)
            g.times, g.parents, g.most, g.same, g.chars, g.pages, g.held, g.leads, g.titled = counts
            del path[depth:]
            if path:
                path[-1].groups.append(g)
            path.append(g)
        return path[0]


def _alike(a: Group, b: Group) -> float:
    """From 0 to 1: the part of what stands in them that both have; of leaves, whether both are."""
    x, y = {(g.tag, g.mark) for g in a.groups}, {(g.tag, g.mark) for g in b.groups}
    return len(x & y) / len(x | y) if x or y else 1.0


def _runs(groups: list[Group]) -> list[list[Group]]:
    """Siblings in a row that stand by the same, but for anonymous containers, as one."""
    out: list[list[Group]] = []
    for g in groups:
        if out and out[-1][0].stands_by() == g.stands_by() and not g.anonymous():
            out[-1].append(g)
        else:
            out.append([g])
    return out


def _fits(a: Group, b: Group) -> bool:
    return a.tag == b.tag and a.mark == b.mark and a.name in (b.name, ANY)


def _anchors(known: list[Group], runs: list[list[Group]]) -> list[tuple[int, int]]:
    """Pairs (place in known, place in runs), both rising, of the best alignment: as many as can be, then those with the
    same text or a like inside."""
    n, m = len(known), len(runs)
    if n == m and all(_fits(a, r[0]) and not a.anonymous() for a, r in zip(known, runs, strict=True)):
        return [(i, i) for i in range(n)]
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        a, row, below = known[i], score[i], score[i + 1]
        for j in range(m - 1, -1, -1):
            best = below[j] if below[j] >= row[j + 1] else row[j + 1]
            b = runs[j][0]
            if a.tag == b.tag and a.mark == b.mark and a.name in (b.name, ANY):
                s = below[j + 1] + 4 + (a.same is not None and a.same == b.same) + (_alike(a, b) if a.groups or b.groups else 1.0)
                best = s if s > best else best
            row[j] = best
    out, i, j = [], 0, 0
    while i < n and j < m:
        a, b = known[i], runs[j][0]
        if _fits(a, b) and score[i][j] == score[i + 1][j + 1] + 4 + (a.same is not None and a.same == b.same) + (_alike(a, b) if a.groups or b.groups else 1.0):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif score[i + 1][j] >= score[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(wrapper: Group, page: Group, learn: bool) -> dict[int, Group]:
    """Aligns a page, or another wrapper, with a wrapper, which with learn takes it in. Gives for each group of the page, by
    identity, that of the wrapper which it meets; what meets none is left out."""
    met = {id(page): wrapper}
    todo = [(wrapper, page)]
    if learn:
        wrapper.take([page])
    while todo:
        known, new = todo.pop()
        runs = _runs(new.groups)
        pairs = _anchors(known.groups, runs)
        partner: dict[int, Group] = {j: known.groups[i] for i, j in pairs}
        taken = {i for i, _ in pairs}
        at = low = 0  # in known: after the last anchor, and after the last that was met
        inserted: list[tuple[int, Group]] = []
        bounds = iter([*pairs, (len(known.groups), len(runs))])
        upto, until = next(bounds)
        for j, run in enumerate(runs):
            while until < j:
                at = low = upto + 1
                upto, until = next(bounds)
            if j in partner:
                continue
            b = run[0]
            gap = [i for i in range(low, upto) if i not in taken]
            near = [g for g in known.groups[max(0, at - 1) : upto + 1] if _fits(g, b) and (not b.anonymous() or _alike(g, b) >= 0.5)]
            far = near or [g for g in known.groups if _fits(g, b) and (not b.anonymous() or _alike(g, b) >= 0.5)]
            other = next((i for i in gap if known.groups[i].tag == b.tag and known.groups[i].mark == b.mark and not b.anonymous() and _alike(known.groups[i], b) >= 0.5), None)
            if far:
                partner[j] = far[0]  # a repetition
            elif other is not None:
                partner[j] = known.groups[other]  # of another name
                taken.add(other)
                low = other + 1
            elif learn:
                partner[j] = Group(*b.stands_by())
                inserted.append((low, partner[j]))
        counted: dict[int, int] = {}
        for j, run in enumerate(runs):
            group = partner.get(j)
            if group is None:
                continue
            for b in run:
                met[id(b)] = group
                todo.append((group, b))
            if learn:
                group.take(run)
                again = id(group) in counted
                counted[id(group)] = counted.get(id(group), 0) + sum(b.most for b in run)
                group.most = max(group.most, counted[id(group)])
                group.parents = group.parents + (0 if again else max(1, run[0].parents))
        for place, made in reversed(inserted):
            known.groups.insert(place, made)
    return met


def expression(group: Group, parents: int = 1) -> str:
    """A wrapper as a union-free regular expression: ( )? optional, ( )+ repeated, #PCDATA a text slot."""
    out = []
    if group.same is not None:
        out.append("#PCDATA" if group.same == -1 else "text")
    for g in group.groups:
        stands = ".".join(filter(None, (g.tag, g.name)))
        inner = f"<{stands}>{expression(g, g.times)}</{stands}>"
        optional, repeated = g.parents < parents, g.most > 1
        out.append(f"({inner}){'*' if optional and repeated else '+' if repeated else '?'}" if optional or repeated else inner)
    return "".join(out)


Blocks = list[list[tuple[Group, str]]]


def parse(page: str) -> tuple[Group, Blocks]:
    """A page as nested groups, and its blocks in order, each as the groups and texts in it."""
    root = Group()
    root.times = root.parents = 1
    stack: list[tuple[str, Group]] = [("", root)]
    blocks: Blocks = []
    held: list[tuple[Group, str]] = []
    dropped = 0  # depth at which an element without text began
    code = 0  # open <pre> and <code>: what stands in them by class is highlighting

    def flush() -> None:
        if held:
            blocks.append(held.copy())
            held.clear()

    def end(i: int) -> None:
        nonlocal dropped, code
        while len(stack) > i:
            tag, _ = stack.pop()
            if tag in BLOCK:
                flush()
            if tag in CODE:
                code -= 1
            if dropped > len(stack):
                dropped = 0

    opened: dict[str, int] = {}  # how often each tag is open, at least

    for kind, what, attributes in tokens(page):
        if kind == "text":
            if not dropped:
                held.append((stack[-1][1], what))
        elif kind == "open":
            if what in BLOCK:
                flush()
            if what in VOID:
                continue
            if what in ENDS_P:  # ends an open <p>, through what is open in it
                i = len(stack) - 1
                while i and stack[i][0] not in BLOCK:
                    i -= 1
                if stack[i][0] == "p":
                    end(i)
            if what in ENDS:  # ends an open one of its kind, through what is open in it
                kinds, bounds = ENDS[what]
                i = len(stack) - 1
                while i and stack[i][0] not in kinds and stack[i][0] not in bounds:
                    i -= 1
                if stack[i][0] in kinds:
                    end(i)
            name, mark = _kind(what, attributes)
            above = stack[-1][1]
            if what not in BLOCK and (not mark or code and what not in DROPPED):
                stack.append((what, above))  # belongs to its block's text
            else:
                group = Group(what, name, mark)
                group.times = group.parents = 1
                above.groups.append(group)
                stack.append((what, group))
            opened[what] = opened.get(what, 0) + 1
            if what in CODE:
                code += 1
            if what in RAW and what in DROPPED and not dropped:
                dropped = len(stack)
        else:
            if what in opened:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == what:
                        end(i)
                        break
                else:
                    del opened[what]
            if what not in opened and what in BLOCK:
                flush()
    end(1)
    flush()
    return root, blocks


def _measured(page: str) -> tuple[Group, Blocks]:
    """parse, with each group's text and, of hints, whether they lead and have the heading."""
    root, blocks = parse(page)
    digest = [int.from_bytes(hashlib.blake2s(page.encode("utf-8", "replace"), digest_size=6).digest())]
    own: dict[int, int] = {}
    for block in blocks:
        for group in {id(g): g for g, _ in block}.values():
            text = _joined(x for g, x in block if g is group)
            if text:
                group.text(zlib.crc32(text.encode("utf-8", "replace")), len(text), digest)
                own[id(group)] = own.get(id(group), 0) + len(text)
    order = list(root.preorder())
    if any(g.mark in HINTS for g in order):
        size, titled = {}, {}
        for g in reversed(order):  # children before their parent
            size[id(g)] = 0 if g.mark == "drop" else own.get(id(g), 0) + sum(size[id(c)] for c in g.groups)
            titled[id(g)] = g.mark != "drop" and (g.tag == "h1" or any(titled[id(c)] for c in g.groups))
        for g in order:
            if g.mark in HINTS:
                g.held, g.leads, g.titled = 1, int(size[id(g)] * 2 > size[id(root)]), int(titled[id(g)])
    return root, blocks


def _joined(texts: Iterable[str]) -> str:
    return " ".join(html_lib.unescape("".join(texts)).split())


def learn(pages: list[str | None], into: Group | None = None) -> Group:
    """The wrapper of these pages, or of these and those before."""
    root = into or Group()
    for page in pages:
        align(root, _measured(page or "")[0], True)
    return root


def articles(root: Group) -> tuple[set[int], set[int], set[int]]:
    """The groups (by identity) whose own text belongs to the article: on pages with a marked group, on those without, and
    on those without where that leaves no text."""
    order = list(root.preorder())
    slots: dict[int, int] = {}
    for g in reversed(order):
        slots[id(g)] = 0 if g.mark == "drop" else (0 if g.constant() else g.chars) + sum(slots[id(c)] for c in g.groups)

    def dropped(g: Group, inside: bool) -> bool:
        """By mark; a hint is overruled as the module says. A header within an article belongs to it."""
        if g.mark not in HINTS:
            return g.mark == "drop"
        if g.mark == "head" and inside:
            return False
        if g.mark != "head" and g.titled * 2 > g.held:
            return False
        return g.mark == "after" or g.leads * 2 <= g.held and slots[id(g)] * 2 <= slots[id(root)]

    marked: set[int] = set()
    stack = [(root, False)]
    while stack:
        g, inside = stack.pop()
        if inside:
            marked.add(id(g))
        for sub in g.groups:
            if sub.mark == "article":
                stack.append((sub, True))
            elif not dropped(sub, inside) and (inside or sub.tag != "header"):  # a page's own header
                stack.append((sub, inside))
    inferred: set[int] = set()
    unmarked: set[int] = set()
    todo = [(root, True, False)]
    while todo:
        g, top, hinted = todo.pop()
        if not hinted:
            unmarked.add(id(g))
        if not g.constant():
            inferred.add(id(g))
        for sub in g.groups:
            if sub.mark != "article" and not dropped(sub, False) and not (top and sub.tag == "header"):
                todo.append((sub, top and sub.tag in ("html", "body"), hinted or sub.mark in HINTS))
    return marked, inferred, unmarked


def main_text(page: str | None, root: Group, kept: tuple[set[int], set[int], set[int]]) -> str:
    """The text of a page's marked groups; of a page that has none, that of the groups inferred from the host."""
    own, blocks = parse(page or "")
    met = align(root, own, False)
    groups = {k: id(g) for k, g in met.items()}
    marked, inferred, unmarked = kept
    text = lambda chosen: " ".join(filter(None, (_joined(x for g, x in block if groups.get(id(g)) in chosen) for block in blocks)))
    return text(inferred) or text(unmarked) if marked.isdisjoint(groups.values()) else text(marked)


def _host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1), F.lit("")))


_WRAPPER = "host string, salt int, wrapper string"


def wrappers(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> host, wrapper (its counts as JSON)."""

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt, held = TaskContext.get().partitionId() % SALTS, {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"host": pa.array(list(held), pa.string()), "salt": pa.array([salt] * len(held), pa.int32()), "wrapper": pa.array([json.dumps(g.to_json()) for g in held.values()], pa.string())})
            held.clear()
            return made

        for rows in it:
            for host, page in zip(rows.column("host").to_pylist(), rows.column("html"), strict=True):
                if host not in held and len(held) >= HOSTS:
                    yield out()
                held[host] = learn([page.as_py()], held.get(host))
        yield out()

    def merge(group: pa.Table) -> pa.Table:
        root = Group()
        for x in sorted(group.column("wrapper").to_pylist()):  # in an order of their own: the same at every run
            align(root, Group.from_json(json.loads(x)), True)
        return pa.table({"host": [group.column("host")[0].as_py()], "salt": pa.array([0], pa.int32()), "wrapper": [json.dumps(root.to_json())]})

    parts = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(fold, _WRAPPER)
    some = parts.groupBy("host", "salt").applyInArrow(merge, _WRAPPER)
    return some.groupBy("host").applyInArrow(merge, _WRAPPER).select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text: a row for each row of pages."""
    spark = pages.sparkSession
    small_batches(spark)
    known = written(wrappers(pages), "wrappers")
    size = known.agg(F.sum(F.octet_length("wrapper") + 64).alias("n")).first()["n"] or 0
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host"))
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"
    # a checked size: few wrappers go to all tasks once
    shared = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in known.collect()}) if size <= BROADCAST_BYTES else None

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Group, tuple[set[int], set[int], set[int]]]] = {}

        def hold(host: str, wrapper: str) -> None:
            if len(held) >= HOSTS:
                held.clear()
            root = Group.from_json(json.loads(wrapper))
            held[host] = root, articles(root)

        for batch in it:
            texts, at = [], []
            wrapper_of = batch.column("wrapper") if shared is None else None
            for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"), strict=True)):
                if wrapper_of is not None and wrapper_of[i].is_valid:
                    hold(host, wrapper_of[i].as_py())  # comes before its pages
                    continue
                if host not in held:
                    hold(host, shared.value[host])
                texts.append(main_text(page.as_py(), *held[host]))
                at.append(i)
            took = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([took.column("page_id"), took.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    if shared is not None:
        return rows.mapInArrow(read, schema)
    # a host's pages are dealt into SALTS parts, and its wrapper is sorted in front of each
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    salted = rows.select("*", none("wrapper", "string"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    first = known.select(none("page_id", kind), none("url", "string"), none("html", "string"), "host", "wrapper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = salted.unionByName(first).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("wrapper").isNull())
    return dealt.mapInArrow(read, schema)


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
