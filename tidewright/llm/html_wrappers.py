"""Main text of web pages by union-free wrappers inferred per host.

A page is a tree of its block elements, labelled by tag and by the role words in class, id and role attributes; text
stands in slots. A wrapper is such a tree read as a regular expression without unions: it is generalised one page at a
time by aligning the children of equal elements; equal neighbours become a repeated group, what one side lacks becomes
optional, runs of flow elements in varying order become a repeated group of optional ones, and differing texts become
slots. Every page of a host takes part: tasks fold their pages into one wrapper per host before anything is shuffled,
and the wrappers of the tasks are aligned in the same way in a tree of bounded groups. Labels come from fixed lists
and long rows of children fold into one group that takes any row, so a wrapper stays small however many pages it has
seen.

A page is then aligned with the finished wrapper of its host, and the slots of its article are chosen among those it
has: those in its article elements, else in main, else in an element whose role says content, else in the element whose
slots hold most text over all pages, less everything that is or stands in a menu, footer, sidebar, notice, advert, form,
script, style or comment section, less (in the last case) texts that are the same on every page, where at
least SAME_PAGES distinct pages have them and others vary. The texts in chosen
slots are the text of the page.

Defined cases: a null html is an empty page with empty text; a null url or one without host belongs to the host ''; repeated
rows each get a row; elements nested deeper than a limit join the element at that depth, with all their text, except the outermost
dropped ones and containers of the article there, which stay elements; unclosed elements end with their parent or the page; an empty table has no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.storage import stored

FAN = 64
MAX_DEPTH = 40
MAX_CHILDREN = 40
SAME_PAGES = 5

#: fixed values: HTML element names by the part they play
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hr address details summary".split())
SECTIONS = frozenset("html body div section article main header footer nav aside form fieldset center noscript template iframe select option textarea dialog menu head title".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
DROPPED = frozenset("script style nav footer aside form fieldset noscript template iframe select option textarea dialog menu head title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: fixed values: role words in class, id and role attributes
BAD_ROLES = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer "
    "masthead topbar cookie cookies consent notice gdpr popup modal newsletter subscribe signup login comment comments reply replies respond disqus share sharing "
    "social related recommended widget toolbar pagination pager copyright legal disclaimer search hidden contentinfo complementary alert".split())
GOOD_ROLES = frozenset("article content main post entry story body maincontent".split())
HEADER_ROLES = frozenset("header head".split())
COMPOUNDS = ("comment", "advert", "sponsor", "cookie", "breadcrumb", "newsletter", "sidebar", "navbar")
HAVING, SIDES = frozenset("has with no without".split()), frozenset("left right".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: labels of groups: a run of flow elements, and a whole row of children
RUN, ROW = GROUPS = ("()", "(*)")
LABEL, CHILDREN, REPEATED, OPTIONAL, PAGES, MASS, TEXT, SEEN = range(8)


def _role(word: str) -> str | None:
    """The role word behind a word of an attribute, compounds such as commentlist by their beginning."""
    if word in BAD_ROLES or word in GOOD_ROLES or word in HEADER_ROLES:
        return word
    return next((p for p in COMPOUNDS if word.startswith(p)), None)


def roles(attributes: str) -> str:
    """Role words of an element's attributes, sorted; what it merely has, or has at a side, is no role of its own."""
    tokens = [[w.lower() for w in _WORD.findall(t)] for _, value in _ATTRIBUTE.findall(attributes) for t in value.strip("\"'").split()]
    plain = any(len(t) == 1 and t[0] in GOOD_ROLES for t in tokens)
    kept = set()
    for words in tokens:
        found = {r for r in map(_role, words) if r}
        if set(words) & HAVING or plain and set(words) & SIDES:
            found &= GOOD_ROLES
        kept |= found
    if attributes and _HIDDEN.search(attributes):
        kept.add("hidden")
    return ".".join(sorted(kept))


def node(label: str) -> list:
    return [label, [], False, False, 1, 0, None, []]


def page_tree(source: str | None) -> list:
    """Tree of the block elements of a page; texts are leaves labelled ``#``, white space folded, references decoded.

    Every leaf knows the page by a digest of its texts, those of dropped elements left out, so that copies are one page."""
    root = node("page")
    leaves: list[list] = []
    stack, names, parts, text = [root], [""], [(0, False)], []

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                leaf = node("#")
                leaf[MASS], leaf[TEXT] = len(words), words
                stack[-1][CHILDREN].append(leaf)
                leaves.append(leaf)

    def close(to: int) -> None:
        flush()
        del stack[to:], names[to:], parts[to:]

    source, at = source or "", 0
    while at < len(source):
        tag = _TAG.search(source, at)
        if tag is None:
            text.append(source[at:])
            break
        text.append(source[at:tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if name in names:
                close(len(names) - 1 - names[::-1].index(name))
            elif name in FLOW or name in SECTIONS or name == "br":
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else len(source)  # the closing tag itself finds nothing to close
            continue
        if name in ("br", "hr"):
            flush()
        marks = roles(tag[3]) if name not in ("html", "body", "main") else ""
        if name in VOID or not (name in FLOW or name in SECTIONS or set(marks.split(".")) & BAD_ROLES):
            continue  # inline markup is no structure
        flush()
        if name in FLOW or name in SECTIONS:
            for ends, by in (("p", None), ("li", {"li"}), ("dt", {"dt", "dd"}), ("dd", {"dt", "dd"}), ("tr", {"tr"}), ("td", {"td", "th", "tr"}), ("th", {"td", "th", "tr"}), ("option", {"option"})):
                if ends in names and (by is None or name in by):
                    place = len(names) - 1 - names[::-1].index(ends)
                    if by is None or not set(names[place + 1:]) & {"ul", "ol", "dl", "table"}:
                        close(place)
        names.append(name)
        label = f"{name}.{marks}" if marks else name
        rank, gone = parts[-1]
        parts.append((max(rank, _rank(label)), gone or _dropped(label, rank > 0)))
        if len(stack) <= MAX_DEPTH or not gone and parts[-1] != (rank, gone):  # deeper ones only where they change the part of their text
            child = node(label)
            stack[-1][CHILDREN].append(child)
            stack.append(child)
        else:
            stack.append(stack[-1])
    flush()
    digest = hashlib.blake2b("\n".join(c[NODE][TEXT] for c in _texts(_met(root, None), False, [])).encode("utf-8", "surrogatepass"), digest_size=6)
    for leaf in leaves:
        leaf[SEEN] = [int.from_bytes(digest.digest(), "little")]
    return root


def _rank(label: str) -> int:
    """The place of an element among the kinds of container, 0 for none."""
    return next((len(KINDS) - k for k, kind in enumerate(KINDS) if kind(label)), 0)


def _flow(label: str) -> bool:
    return label == "#" or label == "()" or label.split(".")[0] in FLOW


def folded(tree: list) -> list:
    """The page as a wrapper of its own: equal neighbours are one repeated group, runs of flow elements one group of options."""
    return [tree[LABEL], _fold([folded(c) for c in tree[CHILDREN]]), *tree[2:]]


def _fold(children: list) -> list:
    out: list = []
    for c in children:
        if _flow(c[LABEL]):
            if not out or out[-1][LABEL] != "()":
                out.append(node("()"))
                out[-1][REPEATED] = True
            _into_group(out[-1], c)
        elif out and out[-1][LABEL] == c[LABEL]:
            out[-1] = merged(out[-1], c)
            out[-1][REPEATED] = True
        else:
            out.append(c)
    return [_row(out)] if len(out) > MAX_CHILDREN else out


def _row(children: list) -> list:
    """One group that stands for a row of any children, in any order."""
    if _is_row(children):
        return children[0]
    group = node(ROW)
    group[REPEATED] = True
    for c in children:
        _into_group(group, c)
    return group


def _is_row(children: list) -> bool:
    return len(children) == 1 and children[0][LABEL] == ROW


def _into_group(group: list, c: list) -> None:
    if c[LABEL] in GROUPS:
        for x in c[CHILDREN]:
            _into_group(group, x)
        return
    for k, x in enumerate(group[CHILDREN]):
        if x[LABEL] == c[LABEL]:
            group[CHILDREN][k] = merged(x, c)
            break
    else:
        c = list(c)
        group[CHILDREN].append(c)
        group[CHILDREN].sort(key=lambda x: x[LABEL])
    for x in group[CHILDREN]:
        x[OPTIONAL] = True


def merged(a: list, b: list) -> list:
    """The least general wrapper of the kind that covers two wrappers of one label."""
    same = a[TEXT] if a[TEXT] == b[TEXT] else None
    seen = a[SEEN] if a[SEEN] == b[SEEN] else sorted({*a[SEEN], *b[SEEN]})[:SAME_PAGES]  # distinct pages, as far as they matter
    children = []
    if a[LABEL] in GROUPS:
        group = node(a[LABEL])
        for x in (*a[CHILDREN], *b[CHILDREN]):
            _into_group(group, x)
        children = group[CHILDREN]
    elif _is_row(a[CHILDREN]) or _is_row(b[CHILDREN]):  # a row stays one, whatever it meets
        children = [merged(_row(a[CHILDREN]), _row(b[CHILDREN]))]
    else:
        for x, y in aligned(a[CHILDREN], b[CHILDREN]):
            if x is not None and y is not None:
                children.append(merged(x, y))
            else:
                only = list(x if x is not None else y)
                only[OPTIONAL] = True
                children.append(only)
        if len(children) > MAX_CHILDREN:
            children = _fold(children)
    return [a[LABEL], children, a[REPEATED] or b[REPEATED], a[OPTIONAL] or b[OPTIONAL], a[PAGES] + b[PAGES], a[MASS] + b[MASS], same, seen]


def aligned(x: list, y: list) -> list[tuple]:
    """Pairs of children in order, by a longest common subsequence of labels; None where one side has no partner."""
    if [c[LABEL] for c in x] == [c[LABEL] for c in y]:
        return list(zip(x, y))
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][LABEL] == y[j][LABEL] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i][LABEL] == y[j][LABEL]:
            out.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((x[i], None))
            i += 1
        else:
            out.append((None, y[j]))
            j += 1
    return out


def expression(wrapper: list) -> str:
    """The wrapper written as a regular expression over tags and text slots."""
    label = wrapper[LABEL]
    inner = "".join(expression(c) for c in wrapper[CHILDREN])
    body = (re.escape(wrapper[TEXT]) if wrapper[TEXT] and wrapper[PAGES] > 1 else "(TEXT)") if label == "#" else inner if label in GROUPS else f"<{label}>{inner}</{label.split('.')[0]}>"
    mark = {(False, False): "", (True, False): "+", (False, True): "?", (True, True): "*"}[wrapper[REPEATED], wrapper[OPTIONAL]]
    return f"({body}){mark}" if mark else body


def _dropped(label: str, inside: bool) -> bool:
    """Whether an element is none of the article; ``inside`` an article element its own header is."""
    tag, *marks = label.split(".")
    if tag in DROPPED or set(marks) & BAD_ROLES:
        return True
    return not inside and (tag == "header" or bool(set(marks) & HEADER_ROLES and not set(marks) & GOOD_ROLES and tag not in HEADINGS))


def _mass(w: list, inside: bool = False) -> int:
    """Characters in the slots below that could be of an article."""
    if w[LABEL] == "#":
        return w[MASS]
    return sum(_mass(c, inside) for c in w[CHILDREN] if not _dropped(c[LABEL], inside))


def choose(wrapper: list) -> None:
    """Mark the slots whose text varies or is on too few distinct pages to say: their OPTIONAL field becomes "keep"."""
    for c in wrapper[CHILDREN]:
        if c[LABEL] != "#":
            choose(c)
        elif c[TEXT] is None or len(c[SEEN]) < SAME_PAGES:
            c[OPTIONAL] = "keep"


def _role_label(label: str) -> bool:
    return bool(set(label.split(".")[1:]) & GOOD_ROLES)


#: containers of the article, best first
KINDS = (lambda x: x.split(".")[0] == "article", lambda x: x.split(".")[0] == "main", _role_label)
NODE, SLOT, BELOW = range(3)


def _met(page: list, w: list | None) -> tuple:
    """(node, slot, children of that kind): a page aligned with its wrapper; no slot where the wrapper has none."""
    kids = page[CHILDREN]
    runs: list[list] = []  # children as the fold groups them
    for c in kids:
        label = RUN if _flow(c[LABEL]) else c[LABEL]
        if runs and runs[-1][LABEL] == label:
            runs[-1][CHILDREN].append(c)
        else:
            runs.append([label, [c]])
    if w and _is_row(w[CHILDREN]):
        runs = [[ROW, kids]]
    below = []
    for run, slot in aligned(runs, w[CHILDREN] if w else []):
        if run is None:
            continue
        options = {x[LABEL]: x for x in slot[CHILDREN]} if slot and slot[LABEL] in GROUPS else None
        below += [_met(c, slot if options is None else options.get(c[LABEL])) for c in run[CHILDREN]]
    return page, w, below


def _containers(met: tuple, kind) -> list:
    """Outermost elements of a kind that are not dropped and hold text, on this page or on others."""
    found = []
    for c in met[BELOW]:
        label = c[NODE][LABEL]
        if _dropped(label, False):
            continue
        if kind(label) and (_mass(c[NODE], True) or c[SLOT] and _mass(c[SLOT], True)):
            found.append(c)
        else:
            found += _containers(c, kind)
    return found


def _texts(met: tuple, inside: bool, out: list, wanted=lambda c: True) -> list:
    """Text leaves in page order, less what is dropped."""
    for c in met[BELOW]:
        if c[NODE][LABEL] == "#":
            if wanted(c):
                out.append(c)
        elif not _dropped(c[NODE][LABEL], inside):
            _texts(c, inside, out, wanted)
    return out


def _varies(c: tuple) -> bool:
    return c[SLOT] is None or c[SLOT][OPTIONAL] == "keep"


def _total(mets: list, wanted) -> int:
    """Characters, over all pages, in the slots that these elements of a page have texts in."""
    slots = {id(c[SLOT] or c[NODE]): (c[SLOT] or c[NODE])[MASS] for m in mets for c in _texts(m, False, [], wanted)}
    return sum(slots.values())


def _heaviest(met: tuple) -> list:
    """Texts of the element that still holds nearly all of the mass in the slots of the page."""
    vary = any(c[SLOT] and c[SLOT][TEXT] is None for c in _texts(met, False, []))  # else the host has one text, however often
    here, wanted = [met], _varies if vary else lambda c: True
    while True:
        total = _total(here, wanted)
        groups: dict[int, list] = {}  # elements of one slot
        for c in (c for m in here for c in m[BELOW]):
            if not _flow(c[NODE][LABEL]) and not _dropped(c[NODE][LABEL], False):
                groups.setdefault(id(c[SLOT] or c[NODE]), []).append(c)
        below = [g for g in groups.values() if 10 * _total(g, wanted) >= 9 * total > 0]
        if not below:
            return [c for m in here for c in _texts(m, False, [], wanted)]
        here = below[0]


def extract(tree: list, wrapper: list) -> list[str]:
    """The texts of a page in the chosen slots of its wrapper, in page order."""
    met = _met(tree, wrapper)
    listed = [_containers(met, kind) for kind in KINDS]
    for chosen in listed:
        if texts := [c for m in chosen for c in _texts(m, True, [])]:
            break
    else:
        texts = [] if any(listed) else _heaviest(met)  # a container that holds text on other pages is empty here
    return [c[NODE][TEXT] for c in texts]


def _fold_pages(batches):
    held: dict[str, list] = {}
    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = folded(page_tree(source))
            held[host] = merged(held[host], w) if host in held else w
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array([json.dumps(w) for w in held.values()], pa.string())],
        names=["host", "part", "wrapper"])


def _align_group(group: pd.DataFrame) -> pd.DataFrame:
    total = None
    for w in group.sort_values("part")["wrapper"]:
        total = json.loads(w) if total is None else merged(total, json.loads(w))
    head = group.iloc[:1].copy()
    head["wrapper"] = [json.dumps(total)]
    return head


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host, from all of its pages; ``wrapper`` is the tree as JSON."""
    kind = "host string, part long, wrapper string"
    parts = _hosted(pages).select("host", "html").mapInArrow(_fold_pages, kind)
    for _ in range(2):
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("host", "part").applyInPandas(_align_group, kind)
    return parts.groupBy("host").applyInPandas(_align_group, kind).select("host", "wrapper")


def expressions(pages: DataFrame) -> DataFrame:
    """(host, expression): the inferred wrappers as regular expressions."""
    def write(batches):
        for batch in batches:
            written = [expression(json.loads(w)) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(written, pa.string())], names=["host", "expression"])

    return wrappers(pages).mapInArrow(write, "host string, expression string")


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    known = stored(wrappers(pages), "wrappers")

    def read(batches):
        ready: dict[str, list] = {}
        for batch in batches:
            ids, urls, sources, trees = batch.columns
            texts = []
            for source, tree in zip(sources.to_pylist(), trees.to_pylist()):
                if tree not in ready:
                    if len(ready) > 1000:
                        ready.clear()
                    ready[tree] = json.loads(tree)
                    choose(ready[tree])
                texts.append("\n".join(extract(page_tree(source), ready[tree])))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    met = _hosted(pages).join(known, "host").select("page_id", "url", "html", "wrapper")
    return met.mapInArrow(read, "page_id long, url string, text string, n_chars long")
