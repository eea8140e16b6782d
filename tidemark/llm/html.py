"""Main text of web pages by two passes over blocks: stop-word density, length and link density decide
clear blocks; ambiguous ones then take the label of the nearest decided neighbours."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import STOP_WORDS

#: Elements that start a block, elements without main text, elements that most often have none,
#: elements whose content is no markup, and elements without an end tag.
BLOCK = set("address article aside blockquote body br button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
OUTSIDE = set("button select textarea noscript template iframe svg canvas object title head".split())
ASIDE = set("nav header footer aside form menu dialog".split())
RAW = ("script", "style", "noembed", "xmp")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class, id and role names of elements with prose of another kind: adverts, notices,
#: comments, teasers. Then those of a page's layout; they say nothing against blocks of good prose.
FOREIGN = set("ad ads cookie cookies consent gdpr notice notices alert alerts popup modal newsletter subscribe signup login comment comments disqus replies respond related recommended teaser teasers".split())
FOREIGN_STARTS = ("advert", "sponsor", "promo")
LAYOUT = set("banner overlay sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer share sharing social tags pagination pager complementary contentinfo search".split())
#: Parts of names that tell what an element has or lacks, and what a header belongs to, if it is
#: the head of an article.
_HAS, _LACKS, _OWNERS = {"has", "with", "without", "no", "not"}, {"off", "free", "none", "closed", "disabled"}, {"article", "post", "entry", "content", "story", "page", "section"}
#: A tag up to its end; quotes hide a ">" only after "=". The second takes the first ">".
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>", re.S)
_SHORT_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>", re.S)
_OTHER = re.compile(r"<[!?/][^>]*+>", re.S)
#: Tags without an end are looked for at the cost of so many whole pages; after that the first ">" ends a tag.
PATIENCE = 8
_NAME = re.compile(r"</?[A-Za-z]")
_RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
_MARKED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*+:\s*+none|aria-hidden\s*+=\s*+[\"']?true", re.I)
_STOP = frozenset(STOP_WORDS)
_WORD = re.compile(r"\w+")
#: Ends of sentences in many scripts. Letters that are words of their own count for several.
_SENTENCE = re.compile(r"[.!?…。！？؟۔।॥։።](?:[\s\"'»”)\]]|$)|[。！？]")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0002ffff]")


def kind_of_names(said: str) -> str:
    """What the names in class, id and role say of an element: foreign, layout or nothing."""
    found = ""
    for name in said.lower().split():
        parts = re.split("[_-]+", name)
        if any(p in _HAS for p in parts[:-1]) or any(p in _LACKS for p in parts[1:]) or (parts[-1] == "header" and len(parts) > 1 and parts[-2] in _OWNERS):
            continue
        if any(p in FOREIGN or p.startswith(FOREIGN_STARTS) for p in parts):
            return "foreign"
        if any(p in LAYOUT for p in parts):
            found = "layout"
    return found


@dataclass
class Rules:
    short: int = 70  # characters below which a block says little
    long: int = 200
    stop_low: float = 0.1
    stop_high: float = 0.3
    link_high: float = 0.4
    dense: int = 3  # what a letter that is a word counts for
    holds: float = 0.5  # share of the good text above which a marked element may not count
    rest: float = 0.1  # and what may be outside of it, compared with that


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    inside: bool  # in an article or main element
    outside: bool  # in a button, list of choices and the like by its elements, or hidden
    layout: int = 0  # innermost element around it that layout words mark
    foreign: int = 0  # innermost element around it that is a menu, header, form and the like, or marked by words for other prose
    heading: bool = False


class Marks:
    """Marked elements by number, each knowing the marked element around it (0: none)."""

    def __init__(self):
        self.around = [0]
        self.void = {0}  # those that do not count
        self.named = {0}  # those that are marked by their names alone
        self.firm: set[int] = set()  # those that count whatever they hold

    def add(self, around: int, named: bool = True, firm: bool = False) -> int:
        self.around.append(around)
        if named:
            self.named.add(len(self.around) - 1)
        if firm:
            self.firm.add(len(self.around) - 1)
        return len(self.around) - 1

    def climb(self, mark: int, seen: set[int]) -> None:
        """Adds mark and all marked elements around it to seen, which holds those of each member."""
        while mark and mark not in seen:
            seen.add(mark)
            mark = self.around[mark]


def blocks(page: str) -> tuple[list[Block], Marks, Marks]:
    """The blocks of a page in order, references decoded and white space squeezed, its layout and foreign marks."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int, int]] = []  # name, outside, article or main, marks around it
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = outside = inside = links = layout = foreign = headings = 0
    plain, other = Marks(), Marks()
    headed: set[int] = set()  # foreign marks around a first heading

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, inside > 0, outside > 0, layout, foreign, headings > 0))
        parts.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text)

    def leave() -> str:
        nonlocal outside, inside, links, layout, foreign, headings
        top, marked, main, plain_, other_ = stack.pop()
        open_[top] -= 1
        if marked or main or plain_ != layout or other_ != foreign:
            flush()
        outside, inside, links, layout, foreign = outside - marked, inside - main, links - (top == "a"), plain_, other_
        headings -= top in HEADINGS
        return top

    at, last, spent = 0, page.rfind(">"), 0
    while at < len(page):
        sign = page.find("<", at)
        if sign < 0:
            add(page[at:])
            break
        add(page[at:sign])
        if page.startswith("<!--", sign):
            end = page.find("-->", sign + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        m = None
        if sign < last:
            if spent <= PATIENCE * len(page):
                m = _TAG.match(page, sign)
                spent += 0 if m else len(page) - sign
            m = m or _SHORT_TAG.match(page, sign) or _OTHER.match(page, sign)
        if m is None:  # a tag without an end hides the rest; any other sign is text
            if sign > last and _NAME.match(page, sign):
                break
            add("<")
            at = sign + 1
            continue
        at, name = m.end(), m[2].lower() if m.re is not _OTHER else ""
        if not name:
            continue
        if name in RAW and not m[1]:
            end = _RAW_END[name].search(page, at)
            if end is None:
                break
            close = page.find(">", end.end())
            at = close + 1 if close >= 0 else len(page)
            continue
        if name in BLOCK:
            flush()
        if m[1]:
            if open_.get(name):
                while leave() != name:
                    pass
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            if name == "p" and stack and stack[-1][0] == "p":
                leave()
            said = " ".join(a or b or c for a, b, c in _MARKED.findall(m[3])) if m[3] else ""
            if name == "main":  # what is around the main element or a first heading is no foreign prose
                other.climb(foreign, other.void)
            if name == "h1":
                other.climb(foreign, headed)
            hidden = bool(m[3] and _HIDDEN.search(m[3]))
            whole = name in ("html", "body", "article", "main")
            marked = not whole and (name in OUTSIDE or hidden)
            said_ = kind_of_names(said) if said and name not in ("html", "body", "main") else ""
            by_name = said_ == "foreign"
            is_other = by_name or (not whole and name in ASIDE and not (name == "header" and inside))
            is_plain = said_ == "layout" and not is_other and name != "article"
            article = name == "main" or name == "article" and not by_name
            if (marked or is_other or is_plain) and name not in BLOCK:
                flush()
            stack.append((name, marked, article, layout, foreign))
            open_[name] = open_.get(name, 0) + 1
            layout = plain.add(layout) if is_plain else layout
            foreign = other.add(foreign, by_name and name not in ASIDE, name in ASIDE and name != "form") if is_other else foreign
            headings += name in HEADINGS
            outside, inside, links = outside + marked, inside + article, links + (name == "a")
    flush()
    other.void |= headed & other.named
    return out, plain, other


def _stops(b: Block) -> float:
    words = _WORD.findall(b.text.lower())
    return sum(w in _STOP for w in words) / max(1, len(words))


def _length(b: Block, rules: Rules) -> int:
    return len(b.text) + (0 if b.text.isascii() else (rules.dense - 1) * len(_DENSE.findall(b.text)))


def _rules(items: list[Block], rules: Rules) -> list[bool | None]:
    """Good, bad or open by length, links and stop words. Where long blocks with ends of sentences but without
    stop words hold more text than those with them, the page's language is none of those listed; then ends of
    sentences count for stop words, as they always do in other scripts."""
    stops, long = [_stops(b) for b in items], [_length(b, rules) for b in items]
    ends = [len(_SENTENCE.findall(b.text)) if s < rules.stop_low and n >= rules.short else 0 for b, s, n in zip(items, stops, long, strict=True)]
    known = other = 0
    for b, s, n, e in zip(items, stops, long, ends, strict=True):
        if n >= rules.short and b.linked <= rules.link_high * len(b.text):
            known, other = known + (n if s >= rules.stop_low else 0), other + (n if e else 0)
    out: list[bool | None] = []
    for b, s, n, e in zip(items, stops, long, ends, strict=True):
        density = b.linked / len(b.text)
        script = not b.text.isascii() and sum(c > "\u024f" for c in b.text if c.isalpha()) > len(b.text) / 4
        if e and (other > known or script):
            s = rules.stop_high if e * rules.long >= n / 2 else rules.stop_low
        if b.inside:
            out.append(True if n >= rules.short and density <= rules.link_high and s >= rules.stop_low else None)
        elif density > rules.link_high:
            out.append(False)
        elif n < rules.short:
            out.append(False if b.linked else None)
        elif s >= rules.stop_high or (s >= rules.stop_low and n >= rules.long):
            out.append(True)
        else:
            out.append(None if s >= rules.stop_low or script else False)
    return out


def _open_wrappers(items: list[Block], first: list[bool | None], marks: Marks, rules: Rules) -> set[int]:
    """Marked elements that hold most good text of the page, with hardly any outside of marks, so that their mark
    cannot be right: of such elements around each other the outer ones, till text is outside of marks."""
    n = len(marks.around)
    held = [0] * n
    for b, x in zip(items, first, strict=True):
        if x and not b.outside:
            held[b.foreign] += len(b.text)
    for m in range(n - 1, 0, -1):
        held[marks.around[m]] += held[m]
    chain = [m for m in range(1, n) if m not in marks.void and m not in marks.firm and held[m] > rules.holds * held[0]]
    if not chain:
        return set()
    place = {m: i + 1 for i, m in enumerate(chain)}
    deepest, barred = [0] * n, [False] * n
    for m in range(1, n):
        up = marks.around[m]
        deepest[m] = place.get(m, deepest[up])
        barred[m] = barred[up] or (m not in place and m not in marks.void)
    free = [0] * (len(chain) + 1)  # text, headings left out, outside of marks once so many of the chain are open
    for b, x in zip(items, first, strict=True):
        if x is not False and not b.outside and not b.heading and not barred[b.foreign]:
            free[deepest[b.foreign]] += len(b.text)
    opened, so_far = 0, free[0]
    while opened < len(chain) and so_far < rules.rest * held[chain[opened]]:
        opened += 1
        so_far += free[opened]
    return set(chain[:opened])


def labels(items: list[Block], marks: Marks, other: Marks, rules: Rules = Rules()) -> list[bool]:
    """First pass: good, bad or open by length, stop words and links, and bad by place. Menus, headers, footers
    and the like count; forms and words for other prose do unless hardly any good text is outside of them; a layout mark counts only around no
    good block; text outside of articles is bad only where articles hold at least half of the good text.
    Second pass: an open block is good if its nearest decided neighbour is, at a tie that before it; without
    any it is good only inside an article."""
    first = _rules(items, rules)
    void, foreign = other.void | _open_wrappers(items, first, other, rules), [False] * len(other.around)
    for m in range(1, len(foreign)):
        foreign[m] = foreign[other.around[m]] or m not in void
    first = [False if b.outside or foreign[b.foreign] else x for b, x in zip(items, first, strict=True)]
    held: set[int] = {0}
    for b, x in zip(items, first, strict=True):
        if x:
            marks.climb(b.layout, held)
    off = [bool(b.outside or foreign[b.foreign] or b.layout not in held) for b in items]
    good = [0, 0]
    for b, x in zip(items, first, strict=True):
        good[b.inside] += len(b.text) if x else 0
    article = any(b.inside for b in items) and good[1] >= good[0]
    off = [o or (article and not b.inside) for b, o in zip(items, off, strict=True)]
    first = [False if o else x for x, o in zip(first, off, strict=True)]
    before: list[tuple[int, bool] | None] = []
    last = None
    for i, x in enumerate(first):
        before.append(last)
        if x is not None and not off[i]:
            last = (i, x)
    out, last = [False] * len(items), None
    for i in range(len(items) - 1, -1, -1):
        b, x = items[i], first[i]
        if x is None:
            near = [(abs(i - k), v) for k, v in filter(None, (before[i], last))]
            least = min((d for d, _ in near), default=0)
            out[i] = next((v for d, v in near if d == least), b.inside)  # the one before comes first
        else:
            out[i] = x
            if not off[i]:
                last = (i, x)
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    items, marks, other = blocks(page or "")
    return " ".join(b.text for b, good in zip(items, labels(items, marks, other, rules), strict=True) if good)


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", rules: Rules = Rules()) -> DataFrame:
    """page_id (from key), text for each row of pages, from the whole html. NULL, empty and text-free
    pages give ''; broken markup is read as far as it goes, in time that grows with the page, however long;
    an open block between equally near ones follows the one before it; repeated rows are read each for
    itself; other columns are not read; an empty table gives an empty result."""
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{html}`").alias("html"))

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([main_text(p.as_py(), rules) for p in b.column(1)], pa.string())], ["page_id", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["page_id"], T.StructField("text", T.StringType())]))
