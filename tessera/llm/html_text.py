"""Main text of web pages by wrapper induction.

Every page becomes a small DOM tree (labels, text hashes, text lengths). A host's references are one page of each of its
most common layouts (a layout is a set of label paths). Every page is aligned with its host's references by simple tree
matching, the largest order-preserving matching of equally labelled nodes, and votes for the reference that matches
best: aligned nodes whose text is the same on most pages are the reference's template, nodes whose text varies are its
slots. The slot that carries the text (an article or main element, else the innermost one that holds most of the varying
text) is the content slot.

A page's text is what stands in the node that is aligned with the content slot (in all of its siblings with the same
label, if these are articles), without template nodes (within an article those that many pages share), without headers
that hold no heading of it, and without elements that are never part of an article: menus, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments, told by element, role or class.

A host is never gathered: pages meet their host's references by a join that is either broadcast (if the references'
size, which is computed first, is at most MOST_BYTES) or dealt to SALTS tasks for each host, votes are counted within
each task and summed by node. A node's votes are kept as Misra-Gries counters, so their number is bounded.

Defined results: null or empty html has no text; a url without host (or null) is a host of its own, "";
a host with few pages has no template, so only element names and classes decide; repeated rows are each returned, their
tree votes once; trees of any depth and any number of children are aligned whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import written

#: Bytes of references or wrappers that are sent to every task; beyond it they meet the pages by a shuffle.
MOST_BYTES = 32 << 20
SALTS = 16
#: References of a host: a page of each of its most common layouts.
REFERENCES = 3
#: A node is template if its text is the same on this share of at least LEAST_PAGES distinct pages.
SAME, LEAST_PAGES = 0.75, 3
#: Within an article or main element a node is only template if it was aligned on this many distinct pages.
LEAST_INSIDE = 6
#: Counters of a node's text hashes in one task, and nodes that a task counts before it hands its counts on.
COUNTERS, MOST_NODES = 4, 100_000
#: Cells of one table of the alignment; larger ones are halved.
MOST_CELLS = 1 << 20

# An attribute is a name and a value in double, single or no quotes; a quote within an unquoted value is part of it.
_ATTRIBUTES = r"(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe|textarea)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES})(?:>|$)|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINER = {"article", "body", "div", "html", "main", "section", "table", "tbody", "td", "tr"}
NEVER = {"head", "title", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "canvas", "input"}
NEVER_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "paywall", "popup", "promo", "promoted", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Words that may stand beside them in a compound name; any other word says that the name means something else.
BESIDE_WORDS = {"area", "bar", "block", "bottom", "box", "container", "content", "footer", "form", "global", "header", "item", "items", "left", "link", "links", "list", "main", "page", "post", "posts", "primary", "reader", "right", "secondary", "section", "site", "slot", "thread", "top", "unit", "user", "wrap", "wrapper"}
NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}
#: An opening tag ends these open elements, up to the nearest of the bounds.
_P_ENDERS = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption"}
_P_BOUNDS, _NO_BOUNDS = BLOCK - {"p"}, frozenset()
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_known_names: dict[str, bool] = {}


def never_name(name: str) -> bool:
    """Whether a class or id names something that is no article: all of its parts say so or add nothing."""
    if name not in _known_names:
        if len(_known_names) > 100_000:
            _known_names.clear()
        parts = [p for p in re.split(r"[-_]+", name) if p]
        _known_names[name] = any(p in NEVER_WORDS for p in parts) and all(p in NEVER_WORDS or p in BESIDE_WORDS or p.isdigit() for p in parts)
    return _known_names[name]


class Node:
    __slots__ = ("tag", "label", "never", "items", "at")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.items, self.label, self.never, self.at = tag, [], tag, tag in NEVER, -1
        if "=" in attributes:
            found = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            names = found.get("class", "").split()
            if names:
                self.label = f"{tag}.{names[0]}"
            self.never = self.never or found.get("role") in NEVER_ROLES or any(map(never_name, names)) or any(map(never_name, found.get("id", "").split()))


def parse(source: str) -> Node:
    root = Node("#root")
    stack, at = [root], 0

    def close(tags, bounds) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in bounds:
                return

    open_tags: dict[str, int] = {}  # how many of each are open at most: spares looking through deep stacks for none
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            stack[-1].items.append(source[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if m[2]:
            if not open_tags.get(name):
                if name == "p":
                    stack[-1].items.append(Node("p"))
                continue
            before = len(stack)
            close({name}, _NO_BOUNDS if name in BLOCK else BLOCK)
            if len(stack) < before:
                open_tags[name] -= 1
            continue
        if name in _P_ENDERS and open_tags.get("p"):
            before = len(stack)
            close({"p"}, _P_BOUNDS)
            if len(stack) < before:
                open_tags["p"] -= 1
        if name in _ENDS:
            close(*_ENDS[name])
        node = Node(name, m[4])
        stack[-1].items.append(node)
        if name not in VOID and not m[4].endswith("/"):
            stack.append(node)
            open_tags[name] = open_tags.get(name, 0) + 1
    if at < len(source):
        stack[-1].items.append(source[at:])
    return root


def blocks(node: Node, drop=None) -> list[str]:
    """Texts of the blocks under node in order; drop(node) says what to leave out. No recursion: trees can be deep."""
    out, now = [], []

    def flush() -> None:
        if now and (text := " ".join(html.unescape("".join(now)).split())):
            out.append(text)
        now.clear()

    todo = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x is node or not (drop and drop(x)):
            if x.tag == "br":
                now.append(" ")
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.items))
    flush()
    return out


def holds_block(node: Node) -> bool:
    todo = [node]
    while todo:
        for x in todo.pop().items:
            if isinstance(x, Node):
                if x.tag in BLOCK and x.tag != "hr":
                    return True
                todo.append(x)
    return False


def skeleton(root: Node) -> list[list]:
    """[label, parent, text hash, characters, never, count] of block nodes in document order.

    A run of equally labelled childless siblings is one node that counts them. Each Node gets the number of its node
    in `at`. A node's hash is made of its own texts and its children's hashes, so the work grows with the page.
    """
    out: list[list] = []
    texts: list[list] = []
    todo: list = [(root, -1)]
    while todo:
        node, parent = todo.pop()
        here = node.at = len(out)
        out.append([node.label, parent, 0, 0, node.never, 1])
        texts.append([])
        # The block children of a node, and its own texts: those of inline elements are the node's.
        kids, inside = [], [iter(node.items)]
        while inside:
            x = next(inside[-1], None)
            if x is None:
                inside.pop()
            elif isinstance(x, str):
                if text := " ".join(x.split()):
                    texts[here].append(text)
            elif x.tag in BLOCK and x.tag != "hr":
                kids.append(x)
            else:
                inside.append(iter(x.items))
        leaf = {id(k): not holds_block(k) for k in kids}
        runs = [(leaf[id(k)] and k.label, k) for k in kids]
        groups = [list(g) for _, g in groupby(runs, key=lambda r: r[0] or id(r[1]))]
        for group in reversed(groups):
            if len(group) == 1 or not group[0][0]:
                todo.extend((k, here) for _, k in reversed(group))
            else:
                todo.append((group, here))
        while todo and isinstance(todo[-1][0], list):
            group, parent = todo.pop()
            first = group[0][1]
            said = ["\n".join(blocks(k)) for _, k in group]
            for _, k in group:
                k.at = len(out)
            out.append([first.label, parent, 0, 0, all(k.never for _, k in group), len(group)])
            texts.append(said)
    for i in range(len(out) - 1, -1, -1):
        said = "\n".join(texts[i])
        out[i][2] = xxhash.xxh64_intdigest(f"{out[i][2]}\n{said}".encode()) >> 1
        out[i][3] += len(said)
        if out[i][1] >= 0:
            up = out[out[i][1]]
            up[2] = (up[2] * 1000003 + out[i][2]) & (2**63 - 1)
            up[3] += out[i][3]
    return out


def layout(tree: list[list]) -> int:
    """A hash of the set of label paths."""
    paths: list[int] = []
    for label, parent, *_ in tree:
        paths.append(xxhash.xxh64_intdigest(f"{paths[parent] if parent >= 0 else ''}/{label}") >> 1)
    return xxhash.xxh64_intdigest(",".join(map(str, sorted(set(paths))))) >> 1


class Shapes:
    """Trees as numbered shapes: equal labels over equal children in order. Matching sizes depend on shapes alone."""

    def __init__(self):
        self.known: dict = {}
        self.label: list[str] = []
        self.kids: list[tuple] = []
        self.size: list[int] = []
        self.sizes: dict[tuple[int, int], int] = {}

    def of(self, tree: list[list]) -> tuple[list[int], list[list[int]]]:
        """The shape and the children of each node."""
        kids: list[list[int]] = [[] for _ in tree]
        for i, node in enumerate(tree):
            if node[1] >= 0:
                kids[node[1]].append(i)
        shape = [0] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            key = (tree[i][0], tuple(shape[k] for k in kids[i]))
            if key not in self.known:
                self.known[key] = len(self.label)
                self.label.append(key[0]), self.kids.append(key[1]), self.size.append(1 + sum(self.size[k] for k in key[1]))
            shape[i] = self.known[key]
        return shape, kids

    def match(self, a: int, b: int) -> int:
        """Nodes in the largest matching of two shapes."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.sizes:
                todo.pop()
                continue
            if x == y or self.label[x] != self.label[y] or not self.kids[x] or not self.kids[y]:
                self.sizes[x, y] = self.size[x] if x == y else int(self.label[x] == self.label[y])
                todo.pop()
                continue
            one, two = self.trimmed(self.kids[x], self.kids[y])
            need = {(i, j) for i in set(self.kids[x][one]) for j in set(self.kids[y][two]) if (i, j) not in self.sizes}
            if need:
                todo.extend(need)
                continue
            rest = len(self.kids[x]) - (one.stop - one.start)
            same = sum(self.size[k] for k in self.kids[x][: one.start]) + sum(self.size[k] for k in self.kids[x][one.stop :]) if rest else 0
            self.sizes[x, y] = 1 + same + int(self.last_row(self.kids[x][one], self.kids[y][two])[-1])
            todo.pop()
        return self.sizes[a, b]

    @staticmethod
    def trimmed(x, y) -> tuple[slice, slice]:
        """What is left without equal shapes at both ends; a best matching pairs those."""
        a, most = 0, min(len(x), len(y))
        while a < most and x[a] == y[a]:
            a += 1
        b = 0
        while b < most - a and x[-1 - b] == y[-1 - b]:
            b += 1
        return slice(a, len(x) - b), slice(a, len(y) - b)

    def weights(self, x, y) -> np.ndarray:
        xs, xi = np.unique(np.array(x, np.int64), return_inverse=True)
        ys, yi = np.unique(np.array(y, np.int64), return_inverse=True)
        table = np.array([[self.sizes.get((i, j), 0) for j in ys.tolist()] for i in xs.tolist()], np.int64).reshape(len(xs), len(ys))
        return table, xi, yi

    def last_row(self, x, y) -> np.ndarray:
        """Sizes of the best matchings of all of x with each beginning of y."""
        row = np.zeros(len(y) + 1, np.int64)
        if len(x) and len(y):
            table, xi, yi = self.weights(x, y)
            for i in xi:
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + table[i][yi]))
        return row

    def chosen(self, x, y) -> list[tuple[int, int]]:
        """Positions in x and y that a best matching pairs; long lists are halved instead of filling one table."""
        found, todo = [], [(0, len(x), 0, len(y))]
        while todo:
            a, b, c, d = todo.pop()
            one, two = self.trimmed(x[a:b], y[c:d])
            found += [(a + k, c + k) for k in range(one.start)] + [(b - 1 - k, d - 1 - k) for k in range(b - a - one.stop)]
            a, b, c, d = a + one.start, a + one.stop, c + two.start, c + two.stop
            if a >= b or c >= d:
                continue
            if (b - a) * (d - c) > MOST_CELLS and b - a > 1:
                mid = (a + b) // 2
                ahead, behind = self.last_row(x[a:mid], y[c:d]), self.last_row(x[mid:b][::-1], y[c:d][::-1])[::-1]
                cut = c + int((ahead + behind).argmax())
                todo += [(a, mid, c, cut), (mid, b, cut, d)]
                continue
            table, xi, yi = self.weights(x[a:b], y[c:d])
            rows = np.zeros((b - a + 1, d - c + 1), np.int64)
            for i, s in enumerate(xi):
                rows[i + 1, 1:] = np.maximum.accumulate(np.maximum(rows[i, 1:], rows[i, :-1] + table[s][yi]))
            i, j = b - a, d - c
            while i and j:
                own = table[xi[i - 1], yi[j - 1]]
                if own and rows[i, j] == rows[i - 1, j - 1] + own:
                    found.append((a + i - 1, c + j - 1))
                    i, j = i - 1, j - 1
                elif rows[i, j] == rows[i - 1, j]:
                    i -= 1
                else:
                    j -= 1
        return found


def aligned(one: list[list], two: list[list], shapes: Shapes | None = None) -> list[tuple[int, int]]:
    """Pairs of matched nodes of two skeletons: simple tree matching from the roots down."""
    shapes = shapes or Shapes()
    if len(shapes.sizes) > 200_000 or len(shapes.label) > 200_000:
        shapes.__init__()
    (sx, kx), (sy, ky) = shapes.of(one), shapes.of(two)
    pairs, todo = [], [(0, 0)] if shapes.match(sx[0], sy[0]) else []
    while todo:
        a, b = todo.pop()
        pairs.append((a, b))
        x, y = [sx[k] for k in kx[a]], [sy[k] for k in ky[b]]
        if x and y:
            if sx[a] == sy[b]:
                todo.extend(zip(kx[a], ky[b], strict=True))
                continue
            left_x, left_y = shapes.trimmed(x, y)
            for i in set(x[left_x]):
                for j in set(y[left_y]):
                    shapes.match(i, j)
            todo.extend((kx[a][i], ky[b][j]) for i, j in shapes.chosen(x, y))
    return pairs


def best_reference(tree: list[list], references: list[list[list]], shapes: Shapes) -> tuple[int, list[tuple[int, int]]]:
    """The reference that most of both trees' nodes are aligned with (the first of equals), and the pairs."""
    found = [aligned(tree, r, shapes) for r in references]
    at = max(range(len(found)), key=lambda k: (len(found[k]) / (len(tree) + len(references[k]) - len(found[k])), -k))
    return at, found[at]


def wrapper(reference: list[list], votes: dict[int, list]) -> dict:
    """A reference's content slot and, for its template nodes, the text hashes that they have.

    votes: for each node [pages, characters, {text hash: pages}].
    """
    template = {i: [h for h, n in hashes.items() if n >= SAME * pages] for i, (pages, _, hashes) in votes.items() if pages >= LEAST_PAGES}
    template = {i: hs for i, hs in template.items() if hs and votes[i][1]}
    firm = [i for i in template if votes[i][0] >= LEAST_INSIDE]
    out_of = set()  # within what is never an article
    for i, node in enumerate(reference):
        if node[4] or node[1] in out_of:
            out_of.add(i)
    slots = {i: votes[i][1] for i in votes if i not in out_of and i not in template and votes[i][1]}
    for tag in ("article", "main"):
        if named := [i for i in slots if reference[i][0].split(".")[0] == tag]:
            return {"slot": max(named, key=lambda i: (slots[i], -i)), "template": template, "firm": firm}
    slot = 0
    for i in sorted(slots):  # a parent's number is below its children's
        if reference[i][1] == slot and reference[i][0].split(".")[0] in CONTAINER and slots[i] >= 0.8 * slots.get(slot, slots[i]):
            slot = i
    return {"slot": slot, "template": template, "firm": firm}


def _heads(node: Node) -> bool:
    todo = [node]
    while todo:
        node = todo.pop()
        if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return True
        todo += [kid for kid in node.items if isinstance(kid, Node) and not kid.never]
    return False


def main_text(root: Node, tree: list[list], rules: list[dict], shapes: Shapes) -> str:
    """rules: tree, slot, template and its firm nodes of each reference of the page's host; none leave names to decide."""
    slot, fixed, firm = None, set(), set()
    if rules:
        at, pairs = best_reference(tree, [r["tree"] for r in rules], shapes)
        rule, to = rules[at], {b: a for a, b in pairs}
        slot = to.get(rule["slot"]) if rule["slot"] else None
        template = {int(i): set(hs) for i, hs in rule["template"].items()}
        fixed = {a for a, b in pairs if tree[a][2] in template.get(b, ())}
        firm = fixed & {to[b] for b in rule["firm"] if b in to}
    named: dict[str, list[Node]] = {"article": [], "main": [], "slot": []}
    todo = [root]
    while todo:
        node = todo.pop()
        for kid in reversed(node.items):
            if isinstance(kid, Node) and not kid.never:
                todo.append(kid)
        if node.at == slot is not None:
            named["slot"].append(node)
        elif node.tag in named and node is not root:
            named[node.tag].append(node)
    chosen = named["slot"] or named["article"] or named["main"] or [root]
    if chosen[0].tag == "article":
        chosen = [n for n in [*named["slot"], *named["article"]] if tree[n.at][1] == tree[chosen[0].at][1]]
        chosen.sort(key=lambda n: n.at)
    inside = chosen[0].tag in ("article", "main")

    def drop(node: Node) -> bool:
        # A header inside an article is its own if it holds a heading; what is the same on many pages is theirs, not its.
        header = node.tag == "header" and not (inside and _heads(node))
        return node.never or header or node.tag in BLOCK and node.at in (firm if inside else fixed)

    return "\n".join(t for n in chosen for t in blocks(n, drop))


def _trees(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            trees = [skeleton(parse(x)) for x in part.column(2).to_pylist()]
            told = [json.dumps(t, separators=(",", ":"), ensure_ascii=False) for t in trees]
            columns = [part.column(0), part.column(1), pa.array([xxhash.xxh3_128_digest(t.encode()) for t in told], pa.binary()), pa.array([layout(t) for t in trees], pa.int64()), pa.array(told, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "content", "layout", "tree"])


class _Votes:
    """Counts of nodes' text hashes; each node keeps COUNTERS of them, so frequent ones stay (Misra-Gries)."""

    def __init__(self):
        self.nodes: dict = {}

    def add(self, key, chars: int, text: int) -> None:
        v = self.nodes.setdefault(key, [0, 0, {}])
        v[0] += 1
        v[1] += chars
        if text in v[2] or len(v[2]) < COUNTERS:
            v[2][text] = v[2].get(text, 0) + 1
        else:
            v[2] = {h: n - 1 for h, n in v[2].items() if n > 1}

    def taken(self) -> pa.RecordBatch:
        rows = [(*key, pages if not i else 0, chars if not i else 0, h, n) for key, (pages, chars, hashes) in self.nodes.items() for i, (h, n) in enumerate(list(hashes.items()) or [(-1, 0)])]
        self.nodes = {}
        names = ["host", "ref", "node", "pages", "chars", "hash", "n"]
        types = [pa.string(), *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _votes(batches):
    shapes, votes, known = Shapes(), _Votes(), {}
    for batch in batches:
        for host, told, refs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if refs not in known:
                if len(known) > 1000:
                    known.clear()
                known[refs] = json.loads(refs)
            tree = json.loads(told)
            ref, pairs = best_reference(tree, known[refs], shapes)
            for a, b in pairs:
                votes.add((host, ref, b), tree[a][3], tree[a][2])
            if len(votes.nodes) > MOST_NODES:
                yield votes.taken()
    yield votes.taken()


def _wrappers(batches):
    for batch in batches:
        made = []
        for votes, refs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            references, of = json.loads(refs), {}
            for v in votes:
                node = of.setdefault(v["ref"], {}).setdefault(v["node"], [0, 0, {}])
                node[0] += v["pages"]
                node[1] += v["chars"]
                if v["n"]:
                    node[2][v["hash"]] = v["n"]
            made.append(json.dumps([{"tree": r, **wrapper(r, of.get(k, {}))} for k, r in enumerate(references)], separators=(",", ":"), ensure_ascii=False))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["of", "rules"])


def _extract(batches):
    shapes, known = Shapes(), {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out = []
            for source, rules in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if rules not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[rules] = json.loads(rules) if rules else []
                root = parse(source)
                out.append(main_text(root, skeleton(root), known[rules], shapes) if source else "")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _met(pages: DataFrame, by_host: DataFrame, column: str, how: str, most_bytes: int) -> DataFrame:
    """pages with the column that by_host (of, column) has for their host; a host's pages are spread over SALTS tasks unless by_host is sent to all."""
    if (by_host.agg(F.sum(F.octet_length(column) + 64)).first()[0] or 0) <= most_bytes:
        return pages.join(F.broadcast(by_host), F.col("host") == F.col("of"), how)
    pages = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    by_host = by_host.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.join(by_host, (F.col("host") == F.col("of")) & (F.col("salt") == F.col("of_salt")), how)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, url and text (blocks joined by a line feed) of every row of pages."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    trees = pages.select("page_id", "host", "html").mapInArrow(_trees, "page_id long, host string, content binary, layout long, tree string")
    distinct = written(trees.groupBy("host", "content").agg(F.min("page_id").alias("page_id"), F.first("layout").alias("layout"), F.first("tree").alias("tree")), "trees")
    # Of each layout the page with the smallest content hash; of those a host's REFERENCES most common ones.
    layouts = distinct.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("content").alias("content"))
    common = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "layout"))
    layouts = layouts.withColumn("ref", common).where(F.col("ref") <= REFERENCES)
    held = distinct.join(layouts.select(F.col("host").alias("lh"), F.col("content").alias("lc"), "ref"), (F.col("host") == F.col("lh")) & (F.col("content") == F.col("lc")))
    held = held.groupBy("host", "ref").agg(F.min("tree").alias("tree"))
    references = held.groupBy(F.col("host").alias("of")).agg(F.array_sort(F.collect_list(F.struct("ref", "tree"))).alias("r"))  # REFERENCES trees
    references = written(references.select("of", F.concat(F.lit("["), F.array_join("r.tree", ","), F.lit("]")).alias("refs")), "references")

    votes = _met(distinct, references, "refs", "inner", most_bytes).select("host", "tree", "refs").mapInArrow(_votes, "host string, ref long, node long, pages long, chars long, hash long, n long")
    votes = votes.groupBy("host", "ref", "node", "hash").agg(*(F.sum(c).alias(c) for c in ("pages", "chars", "n")))
    # Hashes below the share of template can't be template; of each node at most one row more stays for its pages.
    pages_of = Window.partitionBy("host", "ref", "node")
    votes = votes.withColumns({"all": F.sum("pages").over(pages_of), "top": F.row_number().over(pages_of.orderBy(F.desc("n"), "hash"))})
    votes = votes.withColumn("chars", F.sum("chars").over(pages_of)).where("top = 1")
    per_host = votes.groupBy("host").agg(F.collect_list(F.struct("ref", "node", F.col("all").alias("pages"), "chars", "hash", "n")).alias("votes"))  # a row for each node of its references
    rules = per_host.join(references, F.col("host") == F.col("of")).select("host", "votes", "refs").mapInArrow(_wrappers, "of string, rules string")
    joined = _met(pages, written(rules, "wrappers"), "rules", "left", most_bytes).select("page_id", "url", "html", "rules")
    return joined.mapInArrow(_extract, "page_id long, url string, text string")
