"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and text slots. Groups of tokens that repeat at once become repeated groups; the
streams of one host are aligned one after the other, and what does not align becomes optional. A wrapper is the
resulting list of tokens with, for each text slot, whether its text is the same on all pages (template) or varies
(data). Workers fold their own pages, and partial wrappers of a host are folded in two rounds, so a host with a
third of all pages is many small folds, and a heterogeneous one has a wrapper of bounded length. The wrapper then tells
whether article or main holds the host's text, and which slots outside of them are template, by equal texts
of any length on nearly all pages of many different articles.

Null and empty pages give an empty text. Pages without a host are one host, a null url too. Null and repeated page_ids
are rows as any other, an empty table gives an empty one, and further columns, whatever their names, are not looked at.
Unclosed and cut markup is closed where HTML closes it. Repeated pages give repeated results. No page or text is cut.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

#: Wrappers of all hosts together are sent to every executor up to this size; beyond it they are joined.
BROADCAST_BYTES = 4 << 20
LONGEST_GROUP = 12
ROUNDS = 32

#: A quote opens a value only behind an equals sign; everything from <! or <? that is no comment ends at >, CDATA too.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/)?(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|=)*)(?:>|\Z)", re.S)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp")}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of the first closes an open one of the second.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPES = frozenset("ul ol dl table select div section article main body aside nav footer header form".split())
_KEEPS_P = _INLINE | _VOID - {"hr"} | frozenset(["option", "li", "td"])
#: Elements, and names (class, id or role), of what isn't main text. A name counts as a whole: joined words only if
#: they are all of these or of the neutral ones.
_OUTSIDE = frozenset("head nav header footer aside form button select option input label fieldset dialog svg math canvas object audio video map menu figure".split()) - {"figure"}
_OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promotion related reply replies respond response responses search share sharing sidebar signup skip social sponsor sponsored sponsor subscribe subscription tags toolbar topbar widget widgets alert alerts contentinfo complementary".split()
)
_NEUTRAL_NAMES = frozenset("area bar block bottom box button buttons col column container global group inner item items left link links list main outer page primary right secondary section site slot top unit wrap wrapper".split())


@dataclass
class Block:
    """A text slot: the open elements around it, its text and how much of that is in links."""

    path: tuple[str, ...]
    text: str
    linked: int
    token: int = 0


@dataclass
class Page:
    tokens: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    repeated: set[int] = field(default_factory=set)


def _label(tag: str, rest: str) -> str:
    """The tag and its whole names, without those of their words that hold digits."""
    whole = (w for m in _NAME.finditer(rest) for w in (m[2] or m[3] or m[4] or "").lower().split()) if "=" in rest else ()
    names = sorted({x for w in whole if (x := "-".join(y for y in re.split(r"[_.-]+", w) if y and not any(c.isdigit() for c in y)))})
    return ".".join([tag, *names])


@lru_cache(1 << 14)
def _names_outside(label: str) -> bool:
    """Whether one of an element's names says as a whole that it isn't main text."""
    words = (name.split("-") for name in label.split(".")[1:])
    return any(not _OUTSIDE_NAMES.isdisjoint(w) and all(x in _OUTSIDE_NAMES or x in _NEUTRAL_NAMES for x in w) for w in words)


def parse(source: str | None) -> Page:
    """A page's tokens, with groups that repeat at once folded, and its text blocks in page order."""
    page, stack, buffer, source = Page(), [], [], source or ""
    state = {"link": 0, "linked": 0}
    by_token: dict[int, list[Block]] = {}

    def put(token: str) -> None:
        tokens = page.tokens
        tokens.append(token)
        n = len(tokens)
        for g in range(1, min(LONGEST_GROUP, n // 2) + 1):
            if tokens[n - 1 - g] == token and tokens[n - g :] == tokens[n - 2 * g : n - g]:
                for k in range(n - g, n):
                    for b in by_token.pop(k, ()):
                        b.token = k - g
                        by_token.setdefault(k - g, []).append(b)
                    page.repeated.discard(k)
                page.repeated.update(range(n - 2 * g, n - g))
                del tokens[n - g :]
                break

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                own = Block(tuple(stack), text, min(state["linked"], len(text)), len(page.tokens))
                by_token.setdefault(len(page.tokens), []).append(own)
                page.blocks.append(own)
                put("#" + (stack[-1] if stack else ""))
        state["linked"] = 0

    def close(k: int) -> None:
        while len(stack) > k:
            put(">" + stack.pop())

    def text(part: str) -> None:
        if part:
            buffer.append(part)
            if state["link"]:
                state["linked"] += len(part)

    at = 0
    while m := _TOKEN.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "a":
            state["link"] = 0 if m["close"] else 1
        if tag in _INLINE:
            if tag == "br":
                text(" ")
            continue
        flush()
        names = [x.partition(".")[0] for x in stack]
        if m["close"]:
            if tag in names:
                close(len(names) - 1 - names[::-1].index(tag))
            continue
        if tag in _RAW and not m["rest"].rstrip().endswith("/"):
            end = _RAW[tag].search(source, at)
            at = end.end() if end else len(source)
            continue
        if "p" in names[-1:] and tag not in _KEEPS_P:
            close(len(stack) - 1)
            names.pop()
        if tag == "body" and "head" in names:
            close(names.index("head"))
            names = names[: names.index("head")]
        if tag in _CLOSES:
            for k in range(len(names) - 1, -1, -1):
                if names[k] in _CLOSES[tag]:
                    close(k)
                    names = names[:k]
                elif names[k] in _SCOPES:
                    break
        if tag not in _VOID:
            stack.append(_label(tag, m["rest"]))
            put("<" + stack[-1])
    text(source[at:])
    flush()
    close(0)
    return page


VARIES = 1
#: A wrapper with more tokens leaves out those that fewer than RARE of its pages have. What is on nearly all pages of a
#: host stays, and only that can become template: a page's text at a token left out is data.
MOST_TOKENS, RARE = 2000, 0.1
#: Distinct articles that a wrapper counts.
ARTICLES = 32


@dataclass
class Wrapper:
    """Tokens; for each: [optional, repeated, pages, text (a string or its hash, VARIES or None)]; text by region; and the least
    ARTICLES hashes of the pages' longest texts, which tell how many articles there are."""

    pages: int = 0
    tokens: list[str] = field(default_factory=list)
    slots: list[list] = field(default_factory=list)
    regions: dict[str, int] = field(default_factory=dict)
    articles: list[int] = field(default_factory=list)
    cache: dict = field(default_factory=dict, repr=False)

    def places(self, tokens: list[str]) -> list[int | None]:
        """For each of a page's tokens its place in the wrapper."""
        key = tuple(tokens)
        if key not in self.cache:
            if len(self.cache) > 1000:
                self.cache.clear()
            out: list[int | None] = [None] * len(tokens)
            if tokens == self.tokens:
                out = list(range(len(tokens)))
            else:
                for a, b, n in SequenceMatcher(None, self.tokens, tokens, autojunk=False).get_matching_blocks():
                    out[b : b + n] = range(a, a + n)
            self.cache[key] = out
        return self.cache[key]

    def fold(self, other: Wrapper) -> None:
        """Generalise to what other stands for too."""
        places = self.places(other.tokens)
        if None in places or len(places) != len(self.tokens):
            tokens, slots, k = [], [], 0
            for token, slot, place in zip(other.tokens, other.slots, places, strict=True):
                if place is None:
                    tokens.append(token)
                    slots.append([1 if self.pages else slot[0], *slot[1:]])
                    continue
                while k < place:
                    tokens.append(self.tokens[k])
                    slots.append([1, *self.slots[k][1:]])
                    k += 1
                tokens.append(token)
                slots.append(_joined(self.slots[k], slot))
                k += 1
            for j in range(k, len(self.tokens)):
                tokens.append(self.tokens[j])
                slots.append([1, *self.slots[j][1:]])
            self.tokens, self.slots = tokens, slots
            self.cache.clear()
        else:
            self.slots = [_joined(a, b) for a, b in zip(self.slots, other.slots, strict=True)]
        self.pages += other.pages
        if len(self.tokens) > MOST_TOKENS:
            seen = [s[2] >= RARE * self.pages for s in self.slots]
            self.tokens, self.slots = ([x for x, keep in zip(xs, seen, strict=True) if keep] for xs in (self.tokens, self.slots))
            self.cache.clear()
        self.articles = sorted({*self.articles, *other.articles})[:ARTICLES]
        for k, n in other.regions.items():
            self.regions[k] = self.regions.get(k, 0) + n

    def region(self) -> str:
        """article or main where the host has one, else all of the page."""
        for name in ("article", "main"):
            if any(name in k.split("/") for k in self.regions):
                return name
        return ""

    def template(self) -> set[int]:
        """Text slots in no repeated group with the same text on nearly all pages, if the pages hold many articles: at
        least three, and one for every two pages as far as they are counted. Copies of a page are no evidence."""
        if len(self.articles) < max(3, min(ARTICLES, self.pages / 2)):
            return set()
        return {k for k, (t, s) in enumerate(zip(self.tokens, self.slots, strict=True)) if t[0] == "#" and not re.match(r"#h[1-6]\b", t) and not s[1] and s[2] >= 0.9 * self.pages and isinstance(s[3], str)}

    def dump(self) -> str:
        return json.dumps([self.pages, self.tokens, self.slots, self.regions, self.articles])


def _joined(a: list, b: list) -> list:
    text = b[3] if a[3] is None else a[3] if b[3] is None or a[3] == b[3] else VARIES
    return [a[0] | b[0], a[1] | b[1], a[2] + b[2], text]


def load(text: str) -> Wrapper:
    return Wrapper(*json.loads(text))


def in_article(path: tuple[str, ...]) -> bool:
    return any(x.partition(".")[0] in ("article", "main") for x in path)


def outside(path: tuple[str, ...]) -> bool:
    """Whether a block's elements say that it isn't main text. A header inside an article belongs to it. Names don't
    count on the outermost article or main and around it."""
    tags = [label.partition(".")[0] for label in path]
    top = next((k for k, tag in enumerate(tags) if tag in ("article", "main")), -1)
    for k, (label, tag) in enumerate(zip(path, tags, strict=True)):
        if tag in _OUTSIDE and not (tag == "header" and -1 < top < k):
            return True
        if k > top and tag not in ("body", "html") and _names_outside(label):
            return True
    return False


def _container(path: tuple[str, ...]) -> str:
    """The containers of a block, without the block elements that hold the text itself."""
    kept = [x for x in path if x.partition(".")[0] in _SCOPES]
    return "/".join([x.partition(".")[0] if x.partition(".")[0] in ("article", "main") else x for x in kept])


def _digest(text: str, size: int) -> bytes:
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=size).digest()


def wrapper_of(page: Page) -> Wrapper:
    """The wrapper that stands for one page."""
    texts: dict[int, object] = {}
    regions: dict[str, int] = {}
    for b in page.blocks:
        own = b.text if len(b.text) <= 32 else "#" + _digest(b.text, 16).hex()
        texts[b.token] = own if texts.get(b.token, own) == own else VARIES
        if not outside(b.path):
            key = _container(b.path)
            regions[key] = regions.get(key, 0) + len(b.text) - b.linked
    longest = max((b.text for b in page.blocks if not outside(b.path)), key=len, default="")
    article = int.from_bytes(_digest(longest, 6))
    return Wrapper(1, list(page.tokens), [[0, int(k in page.repeated), 1, texts.get(k)] for k in range(len(page.tokens))], regions, [article])


def extract(page: Page, wrapper: Wrapper, region: str, template: set[int]) -> str:
    """The page's main text: its blocks in the host's region that are no template. All text of an article or main is data."""
    places = wrapper.places(page.tokens)
    free = [b for b in page.blocks if not outside(b.path)]

    if region:
        kept = [b for b in free if any(x.partition(".")[0] == region for x in b.path)] or free
    else:  # lists of links are no text
        kept = [b for b in free if b.linked < 0.8 * len(b.text)]
    data = [b for b in kept if in_article(b.path) or places[b.token] not in template]
    return "\n".join(b.text for b in data)


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of every host of pages (url, html)."""

    def fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([w.dump() for w in held.values()], pa.string())], ["host", "wrapper"])

        for batch in batches:
            for h, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                own = wrapper_of(parse(source))
                if h in held:
                    held[h].fold(own)
                else:
                    held[h] = own
            if len(held) > 5000:
                yield out()
                held.clear()
        if held:
            yield out()

    def fold_wrappers(table: pa.Table) -> pa.Table:
        total: Wrapper | None = None
        for text in sorted(table.column("wrapper").to_pylist()):
            if total is None:
                total = load(text)
            else:
                total.fold(load(text))
        return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([total.dump()])})

    rows = arrow_map(pages.select(host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string")), fold_pages, "host string, wrapper string")
    first = rows.groupBy("host", (F.spark_partition_id() % ROUNDS).alias("salt")).applyInArrow(fold_wrappers, "host string, wrapper string")
    return first.groupBy("host").applyInArrow(fold_wrappers, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""
    found = written(infer(pages), "wrappers")
    total = found.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), host(F.col("url").cast("string")).alias("host"))
    joined = rows.join(F.broadcast(found) if total <= BROADCAST_BYTES else found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            wrapper, out = batch.column("wrapper").dictionary_encode(), []
            plans = []
            for text in wrapper.dictionary.to_pylist():
                if text not in known:
                    if len(known) > 500:
                        known.clear()
                    w = load(text)
                    known[text] = (w, w.region(), w.template())
                plans.append(known[text])
            for k, source in zip(wrapper.indices.to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = parse(source)
                out.append(extract(page, *plans[k]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return arrow_map(joined.select(F.col("page_id").cast("long"), "url", "html", "wrapper"), run, "page_id long, url string, text string")
