"""Main text of pages by wrapper induction: trees of one host are aligned, what is constant is template, the rest slots."""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, map_arrow, mix64, written

#: Element names by what becomes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
BLOCK = frozenset(
    "html head body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main nav header "
    "footer aside form fieldset figure figcaption blockquote pre address details summary dialog noscript iframe template menu select "
    "button svg object canvas center".split()
)
NEVER = frozenset("head script style textarea title xmp nav aside footer form noscript iframe template menu select button svg object canvas dialog".split())
UNSEEN = frozenset("head script style textarea title xmp template".split())
CONTAINER = frozenset("html body div section article main table tbody tr td center".split())
#: Start tags that end an open element, and what bounds the search for it.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}
#: Words in class, id or role of what is not the article.
NOISE = frozenset(
    "ad ads adbox adslot advert adverts advertisement banner sponsor sponsored promo promotion sidebar sidenav nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer contentinfo cookie cookies consent gdpr notice alert popup modal overlay newsletter "
    "subscribe signup login search searchbox comment comments reply replies respond disqus discussion share sharing social related "
    "recommended widget toolbar pagination pager complementary dialog".split()
)
#: Those of them that count in inline elements, whose names often say what a word is about.
INLINE_NOISE = frozenset("ad ads adbox adslot advert adverts advertisement banner sponsor sponsored promo promotion share sharing social newsletter cookie cookies".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "names", "items", "noise", "holds", "parent", "number", "inline", "plain")

    def __init__(self, tag: str, names: str, parent: Node | None, inline: bool = False) -> None:
        self.tag, self.names, self.parent, self.inline = tag, names, parent, inline
        self.plain = 0  # open elements of the same tag in an inline one that are no nodes
        self.items: list[str | Node] = []
        words = {w.lower() for w in _WORD.findall(names)} if names else ()
        self.noise = tag in NEVER or not (INLINE_NOISE if inline else NOISE).isdisjoint(words)
        self.holds = tag in ("article", "main")
        self.number = -1


def parse(text: str) -> Node:
    """The block elements of a page, and the inline ones with names, as a tree with their text; unclosed and stray tags are tolerated."""
    root = Node("#", "", None)
    at, i = root, 0
    opened: dict[str, int] = defaultdict(int)  # open elements by name

    def close(n: Node) -> Node:
        """Ends n and what is open in it."""
        up: Node | None = at
        while up is not n.parent:
            opened[up.tag] -= 1
            up = up.parent
        return up

    def around(tag: str) -> Node | None:
        """The inline element of that tag that holds the place, within its block."""
        n = at
        while n.inline and n.tag != tag:
            n = n.parent
        return n if n.inline else None

    while i < len(text):
        m = _TAG.search(text, i)
        if not m:
            at.items.append(text[i:])
            break
        if m.start() > i:
            at.items.append(text[i : m.start()])
        i = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK and opened[tag]:
                n = at
                while n.tag != tag:
                    n = n.parent
                at = close(n)
            elif tag not in BLOCK and (n := around(tag)):
                if n.plain:
                    n.plain -= 1
                else:
                    at = close(n)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                at.items.append(" ")
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.IGNORECASE).search(text, i)
            i = end.end() if end else len(text)
            continue
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])) if m[3] else ""
        if tag not in BLOCK:
            if m[3].endswith("/"):
                continue
            if names:
                node = Node(tag, names, at, True)
                at.items.append(node)
                at = node
                opened[tag] += 1
            elif n := around(tag):
                n.plain += 1
            continue
        if tag in ENDS:
            ended, bound = ENDS[tag]
            if any(opened[t] for t in ended):
                n = at
                while n.tag not in ended and n.tag not in bound:
                    n = n.parent
                if n.tag in ended:
                    at = close(n)
        if opened["p"]:
            n = at
            while n.tag != "p" and n.tag not in CONTAINER:
                n = n.parent
            if n.tag == "p":
                at = close(n)
        node = Node(tag, names, at)
        at.items.append(node)
        if node.holds:
            up: Node | None = at
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
        if not m[3].endswith("/") or tag not in ("iframe", "svg", "object"):
            at = node
            opened[tag] += 1
    return root


def dropped(node: Node, inside: bool, by_name: bool = True) -> bool:
    """Whether an element is never part of the article. What holds an article is kept; a header in one is, too."""
    if not by_name:
        return node.tag in UNSEEN
    if node.tag in NEVER:
        return not node.holds or node.tag != "form"
    if node.holds and not inside:
        return False
    if node.tag == "header":
        return not inside
    return node.noise


def blocks(node: Node, template: set[int], inside: bool = False, out: list[str] | None = None, by_name: bool = True) -> list[str]:
    """The texts of a tree's blocks in page order, without template nodes and what is dropped."""
    out = [] if out is None else out
    held: list[str] = []

    def flush() -> None:
        if held:
            if s := " ".join(html.unescape("".join(held)).split()):
                out.append(s)
            held.clear()

    def begun(n: Node, inside: bool) -> tuple[Iterator[str | Node], bool, bool, bool]:
        return iter(n.items), n.number in template, inside or n.tag in ("article", "main"), n.inline

    todo = [begun(node, inside)]
    while todo:
        items, constant, inside, _ = todo[-1]
        for x in items:
            if not isinstance(x, str):
                if not x.inline:
                    flush()
                if not dropped(x, inside, by_name):
                    todo.append(begun(x, inside))
                    break
            elif not constant:
                held.append(x)
        else:
            ended = todo.pop()
            if not ended[3]:
                flush()
    return out


#: Layouts of hosts whose skeleton is broadcast, at most; those over lookup's HOT_BYTES are not.
HOT_HOSTS = 10_000

#: A skeleton: for each node in page order its parent, label, checksum of its own text, and that text's length.
Skeleton = list[list]


def skeleton(root: Node) -> Skeleton:
    """The tree with each run of like siblings (paragraphs, list items, cells) as one node; sets the nodes' numbers."""
    out: Skeleton = []
    todo = [([root], -1)]
    while todo:
        run, parent = todo.pop()
        number = len(out)
        text = " ".join(" ".join("".join(x for x in n.items if isinstance(x, str)).split()) for n in run).strip()
        out.append([parent, "~" * run[0].inline + f"{run[0].tag} {run[0].names}".strip(), zlib.crc32(text.encode()), len(text)])
        for n in run:
            n.number = number
        children = [x for n in run for x in n.items if isinstance(x, Node)]
        runs = [list(g) for _, g in groupby(children, lambda x: (x.tag, x.names))]
        todo += [(g, number) for g in reversed(runs)]
    return out


#: Sibling lists whose product is over this are aligned a row at a time in numpy, with the same result.
BY_ROWS = 1 << 10


def heaviest(left: tuple, right: tuple, weigh: Callable[[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """The greatest weight of an order-keeping alignment of two lists, and its positions; a weight of 0 forbids a pair."""
    n, m = len(left), len(right)
    chosen: list[tuple[int, int]] = []
    if n * m <= BY_ROWS:
        best = [[0] * (m + 1)]
        took = [[False] * (m + 1)]
        for u in left:
            above, row, took_row = best[-1], [0], [False]
            for j, v in enumerate(right, 1):
                w = weigh(u, v)
                w = w + above[j - 1] if w else -1
                row.append(max(w, above[j], row[-1]))
                took_row.append(row[-1] == w)
            best.append(row)
            took.append(took_row)
        i, j = n, m
        while i and j:
            if took[i][j]:
                i, j = i - 1, j - 1
                chosen.append((i, j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return best[-1][-1], chosen[::-1]
    kinds = {v: k for k, v in enumerate(dict.fromkeys(right))}
    where = np.array([kinds[v] for v in right])
    above = np.zeros(m + 1, np.int64)
    weights: dict[int, np.ndarray] = {}
    bits = []  # for each row: whether its cell is a pair, and whether it equals the cell above
    for u in left:
        if u not in weights:
            weights[u] = np.array([weigh(u, v) for v in kinds], np.int64)
        w = weights[u][where]
        w = np.where(w > 0, w + above[:-1], -1)
        row = np.append(0, np.maximum.accumulate(np.maximum(w, above[1:])))
        bits.append((np.packbits(row[1:] == w), np.packbits(row[1:] == above[1:])))
        above = row
    i, j = n, m
    while i and j:
        byte, bit = (j - 1) >> 3, 7 - ((j - 1) & 7)
        if bits[i - 1][0][byte] >> bit & 1:
            i, j = i - 1, j - 1
            chosen.append((i, j))
        elif bits[i - 1][1][byte] >> bit & 1:
            i -= 1
        else:
            j -= 1
    return int(above[-1]), chosen[::-1]


def layout(bones: Skeleton) -> str:
    """A digest of a skeleton's block elements without texts; empty if it has no text."""
    if not any(x[3] for x in bones):
        return ""
    place: dict[int, int] = {-1: -1}
    kept = []
    for i, (parent, label, *_) in enumerate(bones):
        place[i] = place[parent]
        if not label.startswith("~"):
            place[i] = len(kept)
            kept.append((place[parent], label))
    return hashlib.md5(json.dumps(kept).encode()).hexdigest()


def match(a: Skeleton, b: Skeleton) -> dict[int, int]:
    """Simple tree matching: the largest set of node pairs with equal labels that keeps parents and the order of siblings."""
    known: dict[tuple, int] = {}  # equal subtrees have one shape
    kinds: list[tuple[str, tuple[int, ...], int]] = []  # of each shape the label, the shapes below and the nodes
    kids: list[list[list[int]]] = []
    shapes: list[list[int]] = []
    for s in (a, b):
        below: list[list[int]] = [[] for _ in s]
        for i, (parent, *_) in enumerate(s):
            if parent >= 0:
                below[parent].append(i)
        shape = [0] * len(s)
        for i in range(len(s) - 1, -1, -1):  # a node's children come after it
            key = (s[i][1], tuple(shape[k] for k in below[i]))
            if key not in known:
                known[key] = len(kinds)
                kinds.append((*key, 1 + sum(kinds[k][2] for k in key[1])))
            shape[i] = known[key]
        kids.append(below)
        shapes.append(shape)
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    weights: dict[tuple[int, int], int] = {}

    def weigh(x: int, y: int) -> int:
        if x == y:
            return kinds[x][2]
        return weights[x, y] if kinds[x][0] == kinds[y][0] else 0

    if kinds[shapes[0][0]][0] != kinds[shapes[1][0]][0]:
        return {}
    waiting = [(shapes[0][0], shapes[1][0])]
    while waiting:
        x, y = waiting[-1]
        if x == y or (x, y) in weights:
            waiting.pop()
            continue
        left, right = kinds[x][1], kinds[y][1]
        by_label: dict[str, list[int]] = defaultdict(list)
        for v in set(right):
            by_label[kinds[v][0]].append(v)
        missing = [(u, v) for u in set(left) for v in by_label.get(kinds[u][0], ()) if u != v and (u, v) not in weights]
        if missing:
            waiting += missing
            continue
        # equal shapes at either end belong together in some heaviest alignment
        first = 0
        while first < min(len(left), len(right)) and left[first] == right[first]:
            first += 1
        last = 0
        while last < min(len(left), len(right)) - first and left[-1 - last] == right[-1 - last]:
            last += 1
        total, chosen = heaviest(left[first : len(left) - last], right[first : len(right) - last], weigh)
        ends = [(k, k) for k in range(first)], [(len(left) - k, len(right) - k) for k in range(last, 0, -1)]
        pairs[x, y] = [*ends[0], *((i + first, j + first) for i, j in chosen), *ends[1]]
        weights[x, y] = 1 + total + sum(kinds[left[i]][2] for side in ends for i, _ in side)

    found: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        found[x] = y
        u, v = shapes[0][x], shapes[1][y]
        left, right = kids[0][x], kids[1][y]
        todo += zip(left, right) if u == v else ((left[i], right[j]) for i, j in pairs[u, v])
    return found


#: A node is template if its text is the reference's on this share of the other documents that have it.
CONSTANT = 0.6
#: A slot outside the core rotates if so many documents, and this share of them, have a text there that another document has.
ROTATES, LEAST_REPEATS = 0.1, 3
#: The core is the lowest container that holds more than this share of the text that is new with each document.
CORE = 0.5
#: A layout with so many distinct bodies has a reference of its own; rarer ones share that of the host's commonest layout.
OWN_LAYOUT = 4

#: Of a reference's node over the other documents that have it: how many they are, how many have the reference's text,
#: how many have a text that occurs on another document, and the characters of all.
Seen = tuple[int, int, int, int]


@dataclass
class Wrapper:
    """What the documents of one layout of a host say of its reference page."""

    ref: Skeleton
    constant: set[int]  # nodes whose text is the template's
    rotating: set[int]  # slots outside the core whose texts come back: menus, adverts, notices by turns
    core: int  # the lowest container with most of the text that is new with each document; -1 if there is no evidence


def below(bones: Skeleton, node: int) -> set[int]:
    """A node and all under it; they follow it in the order of numbers."""
    found = {node}
    for i in range(node + 1, len(bones)):
        if bones[i][0] in found:
            found.add(i)
    return found


def wrapper(ref: Skeleton, seen: dict[int, Seen]) -> Wrapper:
    """The template, the rotating slots and the core of a reference page."""
    constant = {i for i, (n, same, *_) in seen.items() if same >= CONSTANT * n and ref[i][3]}
    again = {i for i, (n, _, repeats, _) in seen.items() if i not in constant and repeats >= max(LEAST_REPEATS, ROTATES * n)}
    mass = [0] * len(ref)
    for i, (*_, chars) in seen.items():
        if i not in constant and i not in again:
            mass[i] = chars
    for i in range(len(ref) - 1, 0, -1):  # a node's parent comes before it
        mass[ref[i][0]] += mass[i]
    if not seen or not mass[0]:
        return Wrapper(ref, constant, set(), -1)
    core = max(i for i in range(len(ref)) if mass[i] > CORE * mass[0])  # those that hold so much are one path
    while core and ref[core][1].split(" ")[0] not in CONTAINER:
        core = ref[core][0]
    return Wrapper(ref, constant, again - below(ref, core), core)


#: The word triples of a page's text with the least hashes; pages that share so much of them are copies of one document.
SKETCH, COPY = 64, 0.5


def sketch(text: str) -> list[int]:
    """The SKETCH least hashes of a text's word triples (of its words, if there are under three), rising."""
    words = np.array([zlib.crc32(w) for w in text.encode().split()], np.uint64)
    if len(words) > 2:
        words = mix64(mix64(mix64(words[:-2]) + words[1:-1]) + words[2:])
    return (np.unique(mix64(words))[:SKETCH] >> np.uint64(1)).tolist()


def copies(a: list[int], b: list[int]) -> bool:
    """Whether two sketches are of copies or near copies of one text, which are no evidence of a template."""
    least = sorted({*a, *b})[:SKETCH]
    both = {*a} & {*b}
    return sum(x in both for x in least) >= COPY * len(least)


MARKS = 4


def marks(text: list[int]) -> list[int]:
    """The least hash of each class of a sketch; two copies have at least one in common but for a chance of a few percent."""
    out = [0] * MARKS
    for h in reversed(text):
        out[h % MARKS] = h
    return out


def articles_of(tree: Node) -> list[Node]:
    """The outermost article and main elements in page order."""
    todo, found = [tree], []
    while todo:
        n = todo.pop()
        if n.tag in ("article", "main"):
            found.append(n)
        else:
            todo += [x for x in reversed(n.items) if isinstance(x, Node)]
    return found


def body(tree: Node) -> str:
    """The text of the page's articles, or else of the page, template and all."""
    out: list[str] = []
    for n in articles_of(tree) or [tree]:
        blocks(n, set(), False, out)
    return " ".join(out)


def extract(page: str, induced: Wrapper | None, by_name: bool = True) -> str:
    """The text of a page's content: what the wrapper leaves of it, within its articles if the core lies in them.

    Nodes that are aligned with the template and have its text go, and so do those aligned with rotating slots. Names
    of elements and classes then remove what varies with the page but is no article; by_name=False leaves that, and
    the bound by article elements, to the wrapper alone.
    """
    tree = parse(page)
    own = skeleton(tree)
    mine: set[int] = set()
    core = -1
    if induced is not None:
        ref, aligned = induced.ref, match(induced.ref, own)
        mine = {aligned[i] for i in induced.constant if i in aligned and own[aligned[i]][2:] == ref[i][2:]}
        mine |= {aligned[i] for i in induced.rotating if i in aligned}
        core = aligned.get(induced.core, -1)
    found = articles_of(tree) if by_name else []
    if found and core > 0 and not any(core in below(own, n) or n in below(own, core) for n in {n.number for n in found}):
        found = []
    out: list[str] = []
    for n in found or [tree]:
        blocks(n, mine, False, out, by_name)
    return " ".join(out)


def host_of(url) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with a last column for the pages' layouts."""
    for batch in batches:
        made = [layout(skeleton(parse(p or ""))) for p in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "layout"])


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            trees = [parse(p or "") for p in part.column(2).to_pylist()]
            made = [skeleton(t) for t in trees]
            bodies = [body(t) for t in trees]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([layout(b) for b in made], pa.string()),
                    pa.array([json.dumps(b, separators=(",", ":")) for b in made], pa.string()),
                    pa.array([sketch(b) for b in bodies], pa.list_(pa.int64())),
                    pa.array([hashlib.md5(b.encode()).hexdigest() for b in bodies], pa.string()),
                ],
                names=["id", "host", "layout", "skeleton", "sketch", "body"],
            )


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node of a host's references the texts that documents have there: how many, and the least and the greatest of each of their marks.

    Copies of the reference are left out. Documents with a mark in common may be copies of one another.
    """
    kinds = {"host": pa.string(), "kind": pa.string(), "node": pa.int32(), "text": pa.int64(), "chars": pa.int64(), "is_ref": pa.bool_(), "n": pa.int64()}
    kinds |= {f"{x}{i}": pa.int64() for i in range(MARKS) for x in ("low", "high")}
    for batch in batches:
        tally: dict[tuple, list[int]] = {}
        refs: dict[tuple[str, str], Skeleton] = {}
        for host, own, text, kind, ref, ref_text in zip(*(c.to_pylist() for c in batch.columns)):
            if own == ref or copies(text, ref_text):
                continue
            if (host, kind) not in refs:
                refs[host, kind] = json.loads(ref)
            a, b = refs[host, kind], json.loads(own)
            own_marks = marks(text)
            for x, y in match(a, b).items():
                if not a[x][3] and not b[y][3]:
                    continue
                key = (host, kind, x, b[y][2], b[y][3], a[x][2:] == b[y][2:])
                t = tally.setdefault(key, [0, *(m for m in own_marks for _ in range(2))])
                t[0] += 1
                for i, m in enumerate(own_marks):
                    t[1 + 2 * i], t[2 + 2 * i] = min(t[1 + 2 * i], m), max(t[2 + 2 * i], m)
        if tally:
            rows = [(*k, *v) for k, v in tally.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))


def _bytes() -> Column:
    return F.octet_length("ref") + 8 * SKETCH


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, url and text of each page (empty if it has none).

    Pages of a host with equal trees of labels are one layout. The page with the least id of each common layout is a
    reference, for the rest that of the host's commonest; pages without text are none. The pages that are other documents,
    each body once, are aligned with their reference, and counts over them tell template from slots, and slots whose
    texts come back with other documents from those that are new with each. Counts are summed where the pages lie;
    references and wrappers are skeletons without text.

    Null and empty html give an empty text; pages without url are a host of their own; a host of one page is its own
    wrapper; rows repeated with one id each give a row; ties for the reference go by id, then skeleton. Whole pages are
    read at any length. An empty table gives none; other columns, whatever their names, play no part.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kind = pages.schema[id_col].dataType
    thin = T.StructType([T.StructField("id", kind), *(T.StructField(n, T.StringType()) for n in ("host", "layout", "skeleton")), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("body", T.StringType())])
    bones = written(map_arrow(rows.select("id", "host", "html"), _skeletons, thin), "bones")
    total = bones.count()
    bones = bones.where("layout != ''")
    texts = written(bones.groupBy("host", "layout", "body").agg(F.min(F.struct("id", "skeleton", "sketch")).alias("_b"), F.count("*").alias("rows")).select("host", "layout", "_b.*", "rows"), "texts")
    kinds = texts.groupBy("host", "layout").agg(F.min(F.struct("id", "skeleton", "sketch")).alias("_m"), F.count("*").alias("bodies"), F.sum("rows").alias("n"))
    kinds = written(kinds.select("host", "layout", F.col("_m.id").alias("id"), F.col("_m.skeleton").alias("ref"), F.col("_m.sketch").alias("ref_sketch"), "bodies", "n"), "kinds")
    first = F.min(F.struct((-F.col("bodies")).alias("_n"), "id", "layout", "ref", "ref_sketch"))
    main = kinds.groupBy("host").agg(first.alias("_f"), F.count("*").alias("n")).select("host", "n", F.col("_f.layout").alias("kind"), F.col("_f.ref").alias("ref"), F.col("_f.ref_sketch").alias("ref_sketch"))
    own = F.col("bodies") >= OWN_LAYOUT
    refs = lookup(kinds, written(main, "main"), ["host"], "n", total, F.col("layout"), "_m", HOT_HOSTS, _bytes())
    either = [F.when(own, F.col(a)).otherwise(F.col(f"_m.{b}")).alias(b) for a, b in (("layout", "kind"), ("ref", "ref"), ("ref_sketch", "ref_sketch"))]
    refs = written(refs.select("host", "layout", "n", *either), "refs")
    with_ref = lookup(texts, refs, ["host", "layout"], "n", total, F.col("id"), "_r", HOT_HOSTS, _bytes()).select("host", "skeleton", "sketch", "_r.kind", "_r.ref", "_r.ref_sketch")
    tallies = map_arrow(with_ref, _tallies, "host string, kind string, node int, text long, chars long, is_ref boolean, n long, " + ", ".join(f"low{i} long, high{i} long" for i in range(MARKS)))
    values = tallies.groupBy("host", "kind", "node", "text", "chars", "is_ref").agg(
        F.sum("n").alias("n"), *(f(f"{x}{i}").alias(f"{x}{i}") for i in range(MARKS) for f, x in ((F.min, "low"), (F.max, "high")))
    )
    again = F.expr(" and ".join(["chars > 0", *(f"low{i} != high{i}" for i in range(MARKS))]))
    values = values.groupBy("host", "kind", "node").agg(
        F.sum("n").alias("pages"), F.sum(F.when(F.col("is_ref"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.when(again, F.col("n")).otherwise(0)).alias("again"), F.sum(F.col("n") * F.col("chars")).alias("chars")
    )
    seen = values.groupBy("host", "kind").agg(F.sort_array(F.collect_list(F.struct("node", "pages", "same", "again", "chars"))).alias("seen"))
    seen = written(seen.join(refs.groupBy("host", "kind").agg(F.count("*").alias("layouts")), ["host", "kind"]), "seen")
    wrappers = lookup(refs.drop("ref_sketch"), seen, ["host", "kind"], "layouts", total, F.col("layout"), "_t", HOT_HOSTS, 48 * F.size("seen"))
    wrappers = written(wrappers.select("host", "layout", "n", "ref", F.col("_t.seen").alias("seen")), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper | None] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = []
                for page, ref, seen in zip(*(part.column(c).to_pylist() for c in (2, 3, 4))):
                    key = f"{ref}{seen}"
                    if key not in known:
                        if len(known) > 200:
                            known.clear()
                        known[key] = wrapper(json.loads(ref), {s["node"]: (s["pages"], s["same"], s["again"], s["chars"]) for s in seen or []}) if ref else None
                    texts.append(extract(page or "", known[key]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    laid_out = map_arrow(rows, _laid_out, T.StructType([*rows.schema.fields, T.StructField("layout", T.StringType())]))
    full = lookup(laid_out, wrappers, ["host", "layout"], "n", total, F.col("id"), "_w", HOT_HOSTS, F.octet_length("ref") + 48 * F.coalesce(F.size("seen"), F.lit(0))).select("id", "url", "html", F.col("_w.ref").alias("ref"), F.col("_w.seen").alias("seen"))
    return map_arrow(full, run, T.StructType([T.StructField(id_col, kind), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType())]))
