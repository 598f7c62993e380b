"""Main text of web pages by equivalence-class template deduction.

1. Every page is walked once. Its tokens are its elements, told apart by their path from the root (tag, role, class and
   id of each step, or place among its like for divisions and lists without any), and its runs of text, told apart by
   element and content. A token's occurrence vector is the number
   of times it occurs on each page of the host; it is kept as the exclusive or of a hash of (page, count) over the pages,
   which merges in any order, so a host of any size is aggregated without being gathered.
2. Tokens of a host with one occurrence vector form an equivalence class. The class of the page's root, and classes of
   two or more tokens that enough of the host's pages have, are valid if they nest: all their outermost elements lie in
   slots of one class that is in the template already. Valid classes, the most frequent first, make the host's template.
3. A run of text in a valid class belongs to the template; that of a heading, paragraph, list or table cell only where
   its element never comes without it (same vector), or never holds any other text. All other text is in slots; every
   template element knows how much varying text its slot holds over the host's pages, and how much of that is links.
4. A page's main slot is found by descending from the root into the template element that holds nearly all of the
   varying text, as long as what is left behind holds no heading or paragraph. An element that says it is the article
   (by tag or role) is taken first. All text of the slot is returned, as blocks, less the template's text and less
   menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments: these are told by
   tag or role; by a class or id name that says nothing else; and, outside an article, by being a slot of links.

Inside an article the template takes no text of a heading, paragraph, list or table cell, as small hosts repeat
sentences. Names never drop an article, nor one inside a wrapper they drop if the page has no other; names that an
article's part may bear too ("related") count there only if its text is mostly links.

Cases: null, empty or textless html gives an empty text; pages without a host share one; text that only copies of one
page share isn't the template's, nor is any on hosts with fewer than LEAST_PAGES pages; repeated rows are pages of their
own; a page cut off anywhere, with unclosed elements or stray signs is read as far as it goes; an empty table gives an
empty table; other columns are never looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, written

#: A class is valid if at least so many pages, and this share of the host's pages, have it.
LEAST_PAGES, LEAST_SHARE = 3, 0.02
#: Part of an element's varying text that its main slot holds, and part of a slot's text in links that makes it a menu.
DOMINANT, LINKS = 0.85, 0.8
#: Bytes of templates sent to every executor at most; more go through a shuffle, a host's pages over SALTS tasks.
BROADCAST_BYTES, SALTS = 32 << 20, 32
#: Tokens whose counts a task holds before it hands them on.
HELD_TOKENS = 50_000
#: Elements without end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that a block's start looks back to: a p, or one of its own kind among the second, ends there.
SCOPES = frozenset("p li td th dd dt tr option ul ol dl table button article section div nav aside".split())
ENDS_ITSELF = frozenset("li td th tr dd dt option".split())
#: Elements that hold an article's own sentences.
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dd dt td th figcaption caption".split())
#: Elements that are told apart by their place among their like, up to MOST_PLACES, if nothing names them.
PLACED, MOST_PLACES = frozenset("div section ul ol table".split()), 9
TELLING = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
RAW = frozenset(["script", "style", "noscript", "template", "iframe", "svg", "textarea", "title"])
DROPPED_TAGS = RAW | frozenset(["head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video", "search"])
DROPPED_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "note"])
#: Words of class and id names that tell what an element is, words that an article's part may bear too, and words that
#: add nothing to them. A name tells what an element is if all its words are among these.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo cookie cookies consent gdpr sidebar navbar nav navigation menu breadcrumb breadcrumbs topbar toolbar masthead footer "
    "comment comments commentlist disqus replies respond share sharing newsletter subscribe subscription signup login popup modal overlay pagination pager skip".split()
)
DOUBTFUL = frozenset("banner notice notices notification notifications alert social related recommended recommendations widget widgets side rail".split())
AFFIXES = frozenset(
    "site page main top bottom left right primary secondary global app web reader readers user post article entry blog section area wrapper wrap box list block container bar panel link links button buttons form thread inner content posts articles stories slot unit title text row col item items".split()
)
#: Names of a site's header; that of an article belongs to it.
HEADER_NAMES = re.compile(r"(?:^|\s)(?:(?:site|page|top|main|global|app|web)[_-]?)?header(?:[_-]?(?:bar|wrap|wrapper|container|inner))?(?:$|\s)", re.I)
MAIN = ("article", "main")
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|$)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[\s_-]+")
ROOT = 0


def _noise(names: str) -> int:
    """2 if one of an element's names says that it isn't main text, 1 if it may say so, else 0."""
    found = 0
    for name in names.split():
        words = set(filter(None, _WORDS.split(name)))
        if words & (NOISE | DOUBTFUL) and words <= NOISE | DOUBTFUL | AFFIXES:
            found = max(found, 2 if words & NOISE else 1)
    return found


class Step:
    """What a tag says of its element: its label in paths, if it is dropped (2 by kind, 1 by name), if its name is doubtful, if it says it is the article, and if it is a header."""

    __slots__ = ("tag", "label", "dropped", "doubtful", "main", "header")

    def __init__(self, tag: str, attributes: str):
        found = {k.lower(): entities.unescape(a or b or c).strip().lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        names = " ".join(filter(None, (found.get("class"), found.get("id"))))
        role = found.get("role", "")
        self.tag = tag
        self.label = tag + "".join(f"{mark}{_SPACE.sub('.', found[k])}" for k, mark in (("role", "@"), ("class", "."), ("id", "#")) if found.get(k))
        self.main = tag in MAIN or role in MAIN or found.get("itemprop") == "articlebody"
        noise = _noise(names) if names and not self.main and tag not in ("html", "body") else 0
        self.dropped = 2 if tag in DROPPED_TAGS or role in DROPPED_ROLES or "hidden" in found else int(noise > 0)
        self.doubtful = self.dropped == 1 and noise == 1
        self.main = self.main and not self.dropped
        self.header = tag == "header" or bool(names and HEADER_NAMES.search(names))


class Element:
    """An element path of a page: its parent, what its tag says, how often it occurs, and the characters of text and of links below it and of its own, without what is dropped."""

    __slots__ = ("parent", "step", "label", "count", "chars", "links", "own", "kept")

    def __init__(self, parent: int, step: Step | None, label: str = ""):
        self.parent, self.step, self.label, self.count, self.chars, self.links, self.own, self.kept = parent, step, label, 0, 0, 0, 0, False


class Page:
    """elements by token, outer before inner; blocks of text as (token of the element, level, doubt, token of the text, text).

    A block's level is 0 if it is kept, 1 if it is in an article whose wrapper is dropped by name, 2 if it is dropped;
    doubt is the outermost element around it, inside an article, that has a doubtful name. Text is decoded, its white space is single blanks.
    """

    def __init__(self, html: str | None):
        self.elements: dict[int, Element] = {ROOT: Element(ROOT, None)}
        self.elements[ROOT].count = 1
        self.blocks: list[tuple[int, int, int, int, str]] = []
        self._walk(html or "")
        for token in reversed(self.elements):
            e = self.elements[token]
            if token:
                above = self.elements[e.parent]
                above.chars += e.chars
                above.links += e.links

    def below(self, top: int) -> set[int]:
        """The tokens of an element and of all elements in it."""
        found = {top}
        for token, e in self.elements.items():
            if token != ROOT and e.parent in found:
                found.add(token)
        return found

    def inside(self, tags: frozenset[str]) -> set[int]:
        """The tokens of elements with such tags and of all elements in them."""
        found: set[int] = set()
        for token, e in self.elements.items():
            if e.step and (e.step.tag in tags or e.parent in found):
                found.add(token)
        return found

    def _walk(self, html: str) -> None:
        # Of each open element: tag, token, how far it is dropped (3: by the name of a wrapper only), if it is in the article, doubt.
        stack: list[tuple[str, int, int, bool, int]] = [("", ROOT, 0, False, 0)]
        places: list[dict[str, int]] = [{}]
        scopes: list[int] = []
        open_: Counter[str] = Counter()
        pieces: list[str] = []
        steps: dict[tuple[str, str], Step] = {}
        linked = 0
        elements = self.elements

        def end_block() -> None:
            nonlocal linked
            if not pieces:
                return
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            pieces.clear()
            in_links, linked = linked, 0
            if text:
                _, token, dropped, _, doubt = stack[-1]
                level = min(dropped, 2)
                known = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), token & 0xFFFFFFFFFFFFFFFF) - 2**63
                self.blocks.append((token, level, doubt, known, text))
                if level < 2:
                    own = elements[token]
                    own.chars += len(text)
                    own.own += len(text)
                    own.links += min(in_links, len(text))

        def cut(k: int) -> None:
            for x in stack[k:]:
                open_[x[0]] -= 1
            del stack[k:]
            del places[k:]
            while scopes and scopes[-1] >= k:
                scopes.pop()

        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() < at:
                continue
            text = m[7]
            if text is not None:
                pieces.append(entities.unescape(text) if "&" in text else text)
                if open_["a"]:
                    linked += len(text.strip())
                continue
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
            if closing:
                if open_[tag]:
                    k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
                    if any(x[0] in BLOCK for x in stack[k:]):
                        end_block()
                    cut(k)
                continue
            if tag in ("br", "wbr", "hr", "img"):
                pieces.append(" " if tag != "wbr" else "")
                if tag == "hr":
                    end_block()
                continue
            if tag in RAW:  # nothing inside is markup; a piece cut off takes the rest of the page
                skip = re.compile(rf"</{tag}\s*>", re.I).search(html, m.end())
                at = skip.end() if skip else len(html)
                if not pieces or tag == "title":
                    end_block()
                continue
            if tag in BLOCK:
                end_block()
                if scopes and (stack[scopes[-1]][0] == "p" or stack[scopes[-1]][0] == tag and tag in ENDS_ITSELF):
                    cut(scopes[-1])
            if tag in VOID or attributes.endswith("/"):
                continue
            step = steps.get((tag, attributes))
            if step is None:
                step = steps[tag, attributes] = Step(tag, attributes)
            _, parent, above, inside, doubt = stack[-1]
            label = step.label
            if tag in PLACED and label == tag:
                places[-1][tag] = place = places[-1].get(tag, 0) + 1
                label = f"{tag}[{min(place, MOST_PLACES)}]"
            token = xxhash.xxh3_64_intdigest(label.encode("utf-8", "replace"), parent & 0xFFFFFFFFFFFFFFFF) - 2**63 or 1
            dropped = step.dropped
            if not dropped and step.header and not (inside or step.main):
                dropped = 1
            if dropped == 1 and inside and step.doubtful:
                dropped, doubt = 0, doubt or token
            if above == 2 or dropped == 2 or dropped and inside:
                dropped = 2
            elif above == 3 and step.main:
                dropped = 1
            elif above or dropped:
                dropped = 1 if above == 1 and not dropped else 3
            e = elements.get(token)
            if e is None:
                e = elements[token] = Element(parent, step, label)
            e.count += 1
            e.kept = e.kept or dropped < 2
            if tag in SCOPES:
                scopes.append(len(stack))
            open_[tag] += 1
            stack.append((tag, token, dropped, inside or step.main, doubt))
            places.append({})
        end_block()


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to the tokens of their hosts, merged over the rows of a task as far as memory stays small."""
    names = ["host", "token", "parent", "label", "vector", "pages", "total", "chars", "own", "links", "low", "high"]
    held: dict[tuple, list[int]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        keys, values = list(held), list(held.values())
        held.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([k[i] for k in keys], kinds[i]) for i in range(4)] + [pa.array([v[i] for v in values], pa.int64()) for i in range(8)]
        yield pa.RecordBatch.from_arrays(columns, names)

    def count(key: tuple, name: str, whole: int, times: int, chars: int, own: int, links: int) -> None:
        vector = xxhash.xxh3_64_intdigest(f"{name}{times}") - 2**63
        have = held.get(key)
        if have is None:
            held[key] = [vector, 1, times, chars, own, links, whole, whole]
            return
        have[0] ^= vector
        for k, more in enumerate((1, times, chars, own, links), 1):
            have[k] += more
        have[6], have[7] = min(have[6], whole), max(have[7], whole)

    for batch in batches:
        for key, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            host, name, page = host_of(url), f"{key}\0{url}\0", Page(html)
            whole = xxhash.xxh3_64_intdigest((html or "").encode("utf-8", "replace")) - 2**63
            for token, e in page.elements.items():
                count((host, token, e.parent, e.label), name, whole, e.count, e.chars, e.own, e.links)
            texts = Counter((b[0], b[3]) for b in page.blocks if b[1] < 2)
            sizes = {b[3]: len(b[4]) for b in page.blocks}
            for (parent, token), times in texts.items():
                count((host, token, parent, None), name, whole, times, times * sizes[token], 0, 0)
            if len(held) > HELD_TOKENS:
                yield from flush()
    if held:
        yield from flush()


def token_table(pages: DataFrame) -> DataFrame:
    """host, token, parent, label (null for text) and what the host's pages have of it, for tokens that may be in the template; all: the host's pages."""
    narrow = pages.select(pages["page_id"].cast("string").alias("page"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    parts = in_arrow(narrow, _tokens, "host string, token long, parent long, label string, vector long, pages long, total long, chars long, own long, links long, low long, high long")
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "chars", "own", "links")]
    tokens = parts.groupBy("host", "token", "parent", "label").agg(F.bit_xor("vector").alias("vector"), *sums, F.min("low").alias("low"), F.max("high").alias("high"))
    tokens = written(tokens.where(f"label is not null or pages >= {LEAST_PAGES}"), "page-tokens")  # text on fewer pages is in slots
    roots = tokens.where(f"token = {ROOT} and label = ''").select(F.col("host").alias("of"), F.col("vector").alias("root"), F.col("pages").alias("all"))
    told = tokens.join(roots, tokens["host"] == F.col("of")).drop("of")
    return told.where((F.col("vector") == F.col("root")) | (F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), F.col("all") * LEAST_SHARE)))


def deduced(tokens: list[dict]) -> tuple[list[list[dict]], set[int], dict[int, tuple[int, int, int]]]:
    """Of a host's tokens: the valid nested classes, outermost first; the tokens of the template's text; and of each
    template element its pages, its varying characters, and those of them in links."""
    classes: dict[tuple[int, int], list[dict]] = defaultdict(list)
    for t in tokens:
        classes[t["vector"], t["pages"]].append(t)
    parent = {t["token"]: t["parent"] for t in tokens if t["label"] is not None}
    by_token = {t["token"]: t for t in tokens if t["label"] is not None}
    root = by_token[ROOT]
    class_of: dict[int, int] = {}
    valid: list[list[dict]] = []

    def anchor(token: int, own: set[int]) -> int:
        """The nearest element at or above a token's parent that is in the template, or in own."""
        while token != ROOT and token not in class_of and token not in own:
            token = parent.get(token, ROOT)
        return token

    for (vector, pages), members in sorted(classes.items(), key=lambda x: (x[0] != (root["vector"], root["pages"]), -x[0][1], x[0][0])):
        first = (vector, pages) == (root["vector"], root["pages"])
        elements = {t["token"] for t in members if t["label"] is not None}
        if not first:
            if len(members) < 2 or pages < max(LEAST_PAGES, LEAST_SHARE * root["pages"]):
                continue
            around = {anchor(t["parent"], elements) for t in members}
            if len({class_of.get(a, 0) for a in around - elements}) > 1:
                continue
        for token in elements:
            class_of[token] = len(valid)
        valid.append(sorted(members, key=lambda t: (t["label"] is None, t["token"])))
    steady: Counter[int] = Counter()  # characters of text that every page with the element has
    texts = [t for members in valid for t in members if t["label"] is None and t["pages"] >= LEAST_PAGES and t["low"] != t["high"]]
    for t in texts:
        if (e := by_token.get(t["parent"])) and t["pages"] == e["pages"]:
            steady[t["parent"]] += t["chars"]
    sentences: dict[int, bool] = {ROOT: False}

    def in_sentences(token: int) -> bool:
        """Whether an element is, or is in, a heading, paragraph, list or table cell."""
        way = []
        while token not in sentences:
            way.append(token)
            token = parent.get(token, ROOT)
        known = sentences[token]
        for token in reversed(way):
            known = sentences[token] = known or re.split(r"[@.#[]", by_token[token]["label"])[0] in CONTENT
        return known

    fixed = set()
    varying = {token: by_token[token]["chars"] for token in class_of}
    for t in texts:
        e = by_token.get(t["parent"])
        if e and (e["vector"] == t["vector"] or steady[t["parent"]] == e["own"] and t["pages"] == e["pages"] or not in_sentences(t["parent"])):
            fixed.add(t["token"])
            at = t["parent"]
            while True:
                if at in varying:
                    varying[at] -= t["chars"]
                if at == ROOT:
                    break
                at = parent.get(at, ROOT)
    return valid, fixed, {token: (by_token[token]["pages"], varying[token], min(by_token[token]["links"], varying[token])) for token in class_of}


class Template:
    """A host's template, as far as extraction needs it."""

    def __init__(self, fixed: set[int] | frozenset[int] = frozenset(), slots: dict[int, tuple[int, int, int]] | None = None):
        self.fixed, self.slots = fixed, slots or {}

    def packed(self) -> bytes:
        rows = np.array([(k, *v) for k, v in self.slots.items()], "<i8").reshape(-1, 4)
        return len(rows).to_bytes(8, "little") + rows.tobytes() + np.array(sorted(self.fixed), "<i8").tobytes()

    @classmethod
    def unpacked(cls, raw: bytes | None) -> Template:
        if not raw:
            return cls()
        n = int.from_bytes(raw[:8], "little")
        numbers = np.frombuffer(raw, "<i8", offset=8).tolist()
        return cls(frozenset(numbers[4 * n :]), {numbers[k]: tuple(numbers[k + 1 : k + 4]) for k in range(0, 4 * n, 4)})

    def text_per_page(self, token: int, page: Page) -> tuple[float, float]:
        """Varying characters of an element's slot, on average of the host's pages that have it, and those outside links."""
        if token in self.slots:
            pages, varying, links = self.slots[token]
            return varying / pages, (varying - links) / pages
        e = page.elements[token]
        return float(e.chars), float(e.chars - e.links)


def templates(pages: DataFrame) -> DataFrame:
    """host and template (packed) of every host."""
    fields = ("token", "parent", "label", "vector", "pages", "total", "chars", "own", "links", "low", "high")

    def deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for tokens in batch.column(1):
                _, fixed, slots = deduced(tokens.as_py())
                packed.append(Template(fixed, slots).packed())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["host", "template"])

    # A host's frequent tokens are at most LEAST_PAGES-th or LEAST_SHARE-th parts of what its pages hold.
    grouped = token_table(pages).groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("tokens"))
    return in_arrow(grouped, deduce, "host string, template binary")


def _main_slot(page: Page, template: Template) -> tuple[int, bool]:
    """The element whose slot holds the page's main text, and if it says so itself."""
    elements = page.elements
    best: dict[int, int] = {}  # of elements with text: the least level of a block below
    for token, level, *_ in page.blocks:
        while best.get(token, 2) > level:
            best[token] = level
            if token == ROOT:
                break
            token = elements[token].parent
    mains = [t for t, e in elements.items() if e.step and e.step.main and best.get(t, 2) < 2]
    if mains:
        level = min(best[t] for t in mains)
        return max((t for t in mains if best[t] == level), key=lambda t: (elements[t].step.tag == "article", template.text_per_page(t, page)[0], elements[t].chars)), True
    anchor: dict[int, int] = {ROOT: ROOT}
    inner: dict[int, list[int]] = defaultdict(list)
    for token, e in elements.items():
        if token == ROOT:
            continue
        above = anchor[e.parent]
        anchor[token] = token if token in template.slots and e.count == 1 else above
        if anchor[token] == token and e.kept and e.chars:
            inner[above].append(token)
    now = ROOT
    told = page.inside(TELLING)
    while inner[now]:
        child = max(inner[now], key=lambda t: template.text_per_page(t, page)[1])
        if elements[child].chars < elements[now].chars:  # else nothing is left behind
            whole = template.text_per_page(now, page)[1]
            if template.text_per_page(child, page)[1] < DOMINANT * whole or not whole:
                break
            left = page.below(now) - page.below(child)
            if any(level < 2 and token in left and text not in template.fixed and token in told for token, level, _, text, _ in page.blocks):
                break
        now = child
    return now, False


def main_text(html: str | None, template: Template = Template()) -> str:  # noqa: B008  immutable
    """The blocks of the main slot, joined by line ends."""
    page = Page(html)
    slot, says_so = _main_slot(page, template)
    inside = page.below(slot)
    blocks = [b for b in page.blocks if b[0] in inside and b[1] < 2]
    if any(level == 0 for _, level, *_ in blocks) or not says_so:
        blocks = [b for b in blocks if b[1] == 0]
    doubts = {d for _, _, d, _, _ in blocks if d}
    menus = {d for d in doubts if 2 * page.elements[d].links >= page.elements[d].chars}
    blocks = [b for b in blocks if b[2] not in menus]
    if says_so:
        sentences = page.inside(CONTENT)
        kept = [b for b in blocks if b[3] not in template.fixed or b[0] in sentences]
    else:
        whole = template.text_per_page(slot, page)[0]
        told, lists = page.inside(TELLING), set()
        for token, e in page.elements.items():
            if token in inside and token != slot and e.parent in lists:
                lists.add(token)
            elif token in inside and token != slot and token in template.slots and token not in told:
                text, plain = template.text_per_page(token, page)
                if text and text - plain >= LINKS * text and 2 * text <= whole:
                    lists.add(token)
        kept = [b for b in blocks if b[3] not in template.fixed and b[0] not in lists]
    return "\n".join(b[4] for b in kept or blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template] = {}
    for batch in batches:
        out = []
        for host, html, packed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            if host not in known:
                if len(known) > 1_000:
                    known.clear()
                known[host] = Template.unpacked(packed.as_py())
            out.append(main_text(html, known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = written(templates(pages), "templates")
    size = found.agg(F.sum(F.length("template") + F.octet_length("host") + 64)).head()[0] or 0
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), pages["html"].cast("string").alias("html")).withColumn("host", host)
    if size <= BROADCAST_BYTES:
        told = rows.join(F.broadcast(found), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        told = rows.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    told = told.select("page_id", "url", "host", "html", "template")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return in_arrow(told, _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
