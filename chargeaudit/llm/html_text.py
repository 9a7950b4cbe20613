"""Main text of web pages by template deduction over equivalence classes of tokens.

A token is an element in its place, the path of tags and class words that leads to it, or a word in such a place.  Numbers in
class words count where a host has the numbered word on at least half of its pages (columns, but no numbers of entries).  A token's
occurrence vector has the number of its occurrences on each page of a host; a sum of random numbers, one for each page
times the occurrences, stands for the vector and is merged by addition.

1. One pass sums for every host and element: pages, occurrences, vector, and the characters of text and of link text
   below it.  A word that is on half of a host's pages is on half of them in some stretch of pages that a task reads; such
   words are candidates, and a second pass sums these alone.  Hosts with too few pages have no candidates of their own.
2. Per host, tokens on at least half of the pages form equivalence classes, those with one vector.  A class is valid if it
   has several tokens or is on every page, and classes nest by their places.  The elements of valid classes are the
   template, their words are its fixed text, and what lies under each element is a slot.  A host's list is bounded by the
   size of its pages, for few tokens can be on half of them.
3. Slots are judged once per host.  The container is the article or main element, or else what is reached from the
   top by following the slot that holds most of the text that is neither fixed nor in links.  What is outside is no
   text.  Inside, lists of links are no text unless they hold most of the container, and neither are records: named elements
   that repeat on a page, more often on some pages than on others, have no heading, and each begin with a short line of its own, such
   as the name of who wrote a comment.  In a container that no element marks as article or main, named slots of fixed text are
   notices.  All else stays, also paragraphs and named parts that recur on many pages.
4. A last pass extracts the blocks of the slots of text.  Places outside the template follow the nearest slot above
   them.  Hosts with too few pages to compare use the template of all hosts together.

Elements that are a menu, footer, sidebar, form control or script by their tag or role are never text.  Class and id words
such as "ad" decide only where the template cannot: for small slots inside the container, for places outside the template,
and for pages without one; there they never count for html, body and main, or for what holds most of the page's text.

Defined cases: a null or empty html gives the empty text; a page in which no slot of text has any gives what is
outside boilerplate elements; a null url counts as the empty host; repeated rows are extracted each; elements may nest
as deep as they like; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, has_columns, join_small, slices, table

#: Hosts of fewer pages use the common template.
LEAST_PAGES = 4
#: Templates of at most so many hosts are broadcast.
BROADCAST_HOSTS = 2000
#: Words of a stretch of pages, about.
HELD = 300_000
#: Elements nested deeper stand beside each other in the template.
DEEPEST = 500
#: The share of the text that a slot must hold to be followed down to the container.
FOLLOWED = 0.6
#: The host of the template of all hosts.
COMMON = -1
HARD, SOFT, MAIN, NAMED, WORD, HEADING = 1, 2, 4, 8, 16, 32
#: Characters of a record's first line, at most.
BYLINE = 24

# Element names and class or id words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select canvas audio video xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav footer aside menu dialog button label fieldset legend".split()) | RAW
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSED_BY_BLOCKS = BLOCKS - {"html", "body", "head"}
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense banner sponsor sponsored sponsors promo promotion promotions sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login signin search searchbox share sharing social related recommended recommendations trending comment comments commentlist reply replies respond disqus discussion pagination pager toolbar skip widget widgets copyright taboola outbrain".split()
)
HEADERS = frozenset("header topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NUMBER = re.compile(r"[-_]?\d+$")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBERED = re.compile(r"[A-Za-z]+[-_]?[0-9]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(slots=True)
class Place:
    """An element in its place; ``noise``, ``main`` and ``hard`` hold for all below it.

    ``mark``: its own words, or that it is a form, make it noise unless its key is in ``lifted``; ``pure``: a name of it
    is such a word alone; ``hard``: noise whatever it holds; ``soft``: it is noise by its own words; ``named``: it has class
    or id words; ``kind``: article or main, if it is one.
    """

    key: int
    tag: str
    noise: bool = False
    main: bool = False
    link: bool = False
    above: Place | None = None
    below: dict[tuple[str, str], Place] = field(default_factory=dict)
    lifted: frozenset[int] = frozenset()
    mark: bool = False
    pure: bool = False
    hard: bool = False
    depth: int = 0
    soft: bool = False
    named: bool = False
    kind: str = ""
    variants: dict[frozenset[int], Place] | None = None
    numbered: frozenset[str] = frozenset()

    def child(self, tag: str, attributes: str) -> Place:
        found = self.below.get((tag, attributes))
        if found is None:
            words, role, hidden, pure = named(attributes, self.numbered) if attributes else ((), "", False, False)
            kind = tag if tag in ("article", "main") else role if role in ("article", "main") else ""
            main = self.main or kind != ""
            hard = self.hard or tag in DROPPED or hidden or role in ROLES or (not main and tag == "header")
            named_noise = not NOISE.isdisjoint(words) or (not main and tag != "h1" and not HEADERS.isdisjoint(words))
            mark = tag == "form" or (named_noise and tag not in ("html", "body") and kind != "main" and (pure or kind != "article"))
            key = xxhash.xxh3_64_intdigest(f"{self.key} {tag} {' '.join(sorted(words))}") >> 1
            soft = mark and key not in self.lifted
            noise = self.noise or hard or soft
            found = Place(key, tag, noise, main and not noise, self.link or tag == "a", self, lifted=self.lifted, mark=mark, pure=pure, hard=hard, soft=soft, named=bool(words), kind=kind, depth=self.depth + 1, numbered=self.numbered)
            if self.depth >= DEEPEST:
                found.above, found.depth = self.above, self.depth
            if len(self.below) < 10_000:
                self.below[tag, attributes] = found
        return found

    def line(self) -> Iterator[Place]:
        place: Place | None = self
        while place is not None:
            yield place
            place = place.above


def named(attributes: str, numbered: frozenset[str] = frozenset()) -> tuple[tuple[str, ...], str, bool, bool]:
    """Words of class and id, those of ``numbered`` with their numbers too, the role, whether the element is hidden, and whether a name is a noise word alone."""
    words, role, hidden, pure = [], "", False, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words += [w.lower() for w in _WORD.findall(value)]
            if numbered:
                words += numbered.intersection(map(str.lower, _NUMBERED.findall(value)))
            pure = pure or any(_NUMBER.sub("", w) in NOISE for w in value.lower().split())
        elif name == "role":
            role = value.lower()
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return tuple(words), role, hidden, pure


def wrappers(found: list[tuple[Place, str, int, Place | None]]) -> frozenset[int]:
    """Keys of marked elements that are no noise on this page, for they hold its article or most of its text."""
    soft = [(p, t, n) for p, t, n, opened in found if opened is None and p.noise and not p.hard]
    if not soft:
        return frozenset()
    clean = [(p, t, n) for p, t, n, opened in found if opened is None and not p.noise]
    kinds = {p.kind for p, _, _, opened in found if opened is not None and not p.noise}
    places: dict[int, Place] = {}
    chars: dict[int, int] = {}
    links: dict[int, int] = {}
    for p, t, n in soft:
        for x in p.line():
            places[x.key] = x
            chars[x.key] = chars.get(x.key, 0) + len(t)
            links[x.key] = links.get(x.key, 0) + n
    lifted: set[int] = set()
    inside = not kinds.isdisjoint(("article", "main"))
    total = sum(len(t) - n for _, t, n in [*clean, *soft])
    held = [x for x in places.values() if x.kind]
    if held and "article" not in kinds:
        best = max(held, key=lambda x: (x.kind == "article", chars[x.key], -x.key))
        marks = [x for x in best.line() if x.mark]
        if not any(x.pure for x in marks) or (not inside and 2 * chars[best.key] > total):
            lifted.update(x.key for x in [*marks, *held] if x.mark)
            inside = True
    for k, x in places.items():
        if x.mark and not (x.pure and inside) and 2 * links[k] <= chars[k] and chars[k] - links[k] > total * (0.9 if x.pure or inside else 0.5):
            lifted.add(k)
    return frozenset(lifted)


def read(page: str, root: Place) -> list[tuple[Place, str, int, Place | None]]:
    """What ``blocks`` yields, without the marks of wrappers."""
    found = list(blocks(page, root))
    if lifted := wrappers(found):
        root.variants = root.variants or {}
        if lifted not in root.variants and len(root.variants) >= 16:
            root.variants.clear()
        found = list(blocks(page, root.variants.setdefault(lifted, Place(0, "", lifted=lifted, numbered=root.numbered))))
    return found


def blocks(page: str, root: Place) -> Iterator[tuple[Place, str, int, Place | None]]:
    """(place, text, characters in links, None) of each block, and (place, "", 0, place) of each element that opens, in page order."""
    stack = [root]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    where: Place | None = None
    links = at = 0

    def flush() -> tuple[Place, str, int, None] | None:
        nonlocal links, where
        text = " ".join("".join(pieces).split())
        out = (where, text, links, None) if text and where is not None else None
        pieces.clear()
        links, where = 0, None
        return out

    def add(text: str) -> None:
        nonlocal links, where
        text = entities.unescape(text) if "&" in text else text
        pieces.append(text)
        top = stack[-1]
        if not text.isspace():
            if where is None:
                where = next((p for p in reversed(stack) if p.tag in BLOCKS), root) if not top.noise else top
            if top.link:
                links += len(text)

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if opened[tag]:
                inside = False
                while True:
                    p = stack.pop()
                    opened[p.tag] -= 1
                    inside = inside or p.tag in BLOCKS or p.noise
                    if p.tag == tag:
                        break
                if inside and (b := flush()):
                    yield b
            continue
        if tag in VOID:
            if tag == "hr":
                if b := flush():
                    yield b
            else:
                pieces.append(" " if tag == "br" else "")
            continue
        block = tag in BLOCKS
        if block:
            if b := flush():
                yield b
            shut = CLOSES.get(tag, {"p"})
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    opened.subtract(p.tag for p in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in CLOSED_BY_BLOCKS and stack[i].tag not in ("p", "td", "th", "dt", "dd", "li") or tag == "p" and stack[i].tag in ("td", "th", "dd", "li"):
                    break
        place = stack[-1].child(tag, m.group(3).strip().rstrip("/").rstrip() if m.group(3) else "")
        yield place, "", 0, place
        if tag in RAW:
            shut_at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(page, at)
            at = shut_at.end() if shut_at else n
            continue
        if place.noise and not stack[-1].noise and not block and (b := flush()):
            yield b  # text before an inline element that is dropped
        stack.append(place)
        opened[tag] += 1
    if b := flush():
        yield b


def host_column(url: Column) -> Column:
    """The host of a url in lower case, as a number."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")) & (F.regexp_replace(url, r"^.*?://", "") != ""), F.regexp_replace(url, r"^.*?://", "")).otherwise(url)
    return F.shiftrightunsigned(F.xxhash64(F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", ""))), 1)


TOKENS = "host long, token long, above long, flags int, pages long, count long, vector long, chars long, links long"
NAMES = [x.split()[0] for x in TOKENS.split(", ")]


def flags_of(place: Place) -> int:
    return HARD * place.hard | SOFT * place.soft | MAIN * place.main | NAMED * place.named | HEADING * (place.tag in _HEADINGS)


def page_tokens(page: str, root: Place) -> tuple[dict[int, list[int]], Counter[tuple[int, str]]]:
    """Each element's place -> above, flags, occurrences, characters, characters in links; and how often each word stands in each place outside hard noise."""
    own: dict[int, list[int]] = {}
    words: Counter[tuple[int, str]] = Counter()
    for place, text, links, opened in read(page, root):
        if opened is not None:
            x = own.get(place.key)
            if x is None:
                own[place.key] = [place.above.key if place.above else 0, flags_of(place), 1, 0, 0]
            else:
                x[2] += 1
        elif not place.hard:
            for p in place.line():
                if p.tag:
                    x = own[p.key]
                    x[3] += len(text)
                    x[4] += links
            key = place.key
            words.update([(key, w) for w in text.split()])
    return own, words


def word_token(place: int, word: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{place} {word}") >> 1


def drawn(page: str) -> int:
    """The random number of a page; equal pages have the same."""
    return xxhash.xxh3_64_intdigest(page) & ((1 << 40) - 1)


class Roots(dict):
    """A root of places for each list of numbered words."""

    def of(self, numbered: list[str] | None) -> Place:
        key = frozenset(numbered or ())
        if key not in self:
            if len(self) >= 64:
                self.clear()
            self[key] = Place(0, "", numbered=key)
        return self[key]


def rows_of(sums: dict[tuple[int, int], list[int]]) -> pa.RecordBatch:
    """(host, token) -> above, flags, pages, count, vector, chars, links as rows."""
    keys = np.array(list(sums), np.int64).reshape(-1, 2)
    values = np.array([[*x[:4], x[4] & ((1 << 62) - 1), *x[5:]] for x in sums.values()], np.int64).reshape(-1, 7)
    columns = [keys[:, 0], keys[:, 1], values[:, 0], values[:, 1].astype(np.int32), *values[:, 2:].T]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=NAMES)


def elements(pages: DataFrame) -> DataFrame:
    """Sums for each host and element, and candidates among the words (rows of no pages), one row for each that a stretch of pages holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}
        seen: dict[int, Counter[tuple[int, str]]] = {}
        number: Counter[int] = Counter()

        def rows() -> pa.RecordBatch:
            every: Counter[tuple[int, str]] = Counter()
            for host, words in seen.items():
                every.update(words)
                if host in small:
                    continue
                for (key, word), n in words.items():
                    if 2 * n >= number[host]:
                        sums[host, word_token(key, word)] = [key, WORD, 0, 0, 0, 0, 0]
            whole = number.total()
            for (key, word), n in every.items():
                if 2 * n >= whole:
                    sums[COMMON, word_token(key, word)] = [key, WORD, 0, 0, 0, 0, 0]
            out = rows_of(sums)
            for x in (sums, seen, number, small):
                x.clear()
            return out

        small: set[int] = set()
        for batch in slices(batches, "html"):
            roots = Roots()
            for host, few, page, numbered in zip(*(batch.column(c).to_pylist() for c in ("_host", "_few", "html", "_numbered")), strict=True):
                page, root = page or "", roots.of(numbered)
                draw = drawn(page)
                own, words = page_tokens(page, root)
                number[host] += 1
                if few:
                    small.add(host)
                seen.setdefault(host, Counter()).update(words.keys())
                for key, (above, flags, n, chars, links) in own.items():
                    x = sums.setdefault((host, key), [above, flags, 0, 0, 0, 0, 0])
                    x[2] += 1
                    x[3] += n
                    x[4] += n * draw
                    x[5] += chars
                    x[6] += links
            if sum(map(len, seen.values())) > HELD:
                yield rows()
        if number:
            yield rows()

    return pages.select("_host", "_few", "html", "_numbered").mapInArrow(work, TOKENS)


def words(pages: DataFrame) -> DataFrame:
    """Sums for each host and candidate word; ``pages`` has the candidates of its host and of all as ``_own`` and ``_all``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}
        wanted: dict[int, frozenset[int]] = {}
        known: dict[tuple[int, str], int] = {}
        for batch in slices(batches, "html"):
            roots = Roots()
            hosts, pages_in, numbered = (batch.column(c).to_pylist() for c in ("_host", "html", "_numbered"))
            for i, (host, page) in enumerate(zip(hosts, pages_in, strict=True)):
                root = roots.of(numbered[i])
                if host not in wanted:
                    if len(wanted) >= 256:
                        wanted.clear()
                    wanted[host] = frozenset(batch.column("_own")[i].as_py() or ()) | frozenset(batch.column("_all")[i].as_py() or ())
                if not wanted[host]:
                    continue
                page = page or ""
                draw, mine = drawn(page), wanted[host]
                for at, n in page_tokens(page, root)[1].items():
                    token = known.get(at)
                    if token is None:
                        if len(known) >= HELD:
                            known.clear()
                        token = known[at] = word_token(*at)
                    if token in mine:
                        x = sums.setdefault((host, token), [at[0], WORD, 0, 0, 0, 0, 0])
                        x[2] += 1
                        x[3] += n
                        x[4] += n * draw
                        x[5] += n * (len(at[1]) + 1)
            if len(sums) > HELD:
                yield rows_of(sums)
                sums.clear()
        if sums:
            yield rows_of(sums)

    return pages.select("_host", "html", "_own", "_all", "_numbered").mapInArrow(work, TOKENS)


def with_numbered(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """``pages`` with the class and id words with numbers that stand on at least half of their host's pages, as ``_numbered``."""
    # a value ends at ">" or "=" at the latest, so that no place of a page is read again and again
    values = F.regexp_extract_all("html", F.lit(r"""(?i)\b(?:class|id)\s*+=\s*+("[^"=>]*+"|'[^'=>]*+'|[^\s"'=>]++)"""), F.lit(1))
    found = F.regexp_extract_all(F.lower(F.array_join(values, " ")), F.lit(r"[a-z]+[-_]?[0-9]+"), F.lit(0))
    asked = pages.filter(F.col("html").rlike(r"""(?i)\b(?:class|id)\s*+=\s*+["']?[^"'=>]*[0-9]"""))
    each = asked.select(host_column(F.col("url")).alias("_h"), F.explode(F.array_distinct(found)).alias("_w")).groupBy("_h", "_w").agg(F.count("*").alias("_n"))
    often = join_small(each, totals, each["_h"] == totals["_host"]).filter(2 * F.col("_n") >= F.col("of"))
    listed = cut(often.groupBy(F.col("_h").alias("_numbered_host")).agg(F.sort_array(F.collect_set("_w")).alias("_numbered")))  # a page's words, at most twice
    if listed.isEmpty():
        return pages.withColumn("_numbered", F.lit(None).cast("array<string>"))
    return join_small(pages, listed, host_column(F.col("url")) == F.col("_numbered_host"), "left", BROADCAST_HOSTS).drop("_numbered_host")


def tokens(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """Sums for each host and token: all elements, and the words that may be on half of its pages.  ``totals``: the hosts with pages enough."""
    pages = pages if "_numbered" in pages.columns else pages.withColumn("_numbered", F.lit(None).cast("array<string>"))
    rows = pages.select(host_column(F.col("url")).alias("_host"), "html", "_numbered")
    large = totals.select(F.col("_host").alias("_l"))
    asked = join_small(rows, large, rows["_host"] == large["_l"], "left", BROADCAST_HOSTS).select("_host", "html", "_numbered", F.col("_l").isNull().alias("_few"))
    parts = cut(merged(elements(asked), "host", "token"))
    listed = parts.filter(F.col("pages") == 0).groupBy("host").agg(F.collect_set("token").alias("tokens"))
    own = cut(listed)
    common = own.filter(F.col("host") == COMMON).select(F.col("host").alias("_c"), F.col("tokens").alias("_all"))
    own = own.filter(F.col("host") != COMMON).select(F.col("host").alias("_h"), F.col("tokens").alias("_own"))
    joined = join_small(rows, own, rows["_host"] == own["_h"], "left", BROADCAST_HOSTS)
    joined = joined.withColumn("_any", F.lit(COMMON).cast("long")).join(common.hint("broadcast"), F.col("_any") == F.col("_c"), "left")  # one row
    return parts.filter(F.col("pages") > 0).unionByName(merged(words(joined), "host", "token"))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    # vectors are sums modulo 2**62, taken apart so that adding them cannot overflow
    low, high = F.sum(F.col("vector").bitwiseAND((1 << 31) - 1)), F.sum(F.shiftright("vector", 31))
    vector = (F.pmod(high + F.shiftright(low, 31), F.lit(1 << 31)) * (1 << 31) + F.pmod(low, F.lit(1 << 31))).alias("vector")
    once = [F.min(c).alias(c) for c in ("above", "flags")]
    return parts.groupBy(*keys).agg(*once, *[F.sum(c).alias(c) for c in ("pages", "count", "chars", "links")], vector)


def deduced(rows: list[dict]) -> dict[int, bool]:
    """Elements of one host's template and whether their slots are text.  rows: tokens on half of the pages, with ``of``, the number of pages."""
    size = Counter(r["vector"] for r in rows)
    tags = {r["token"]: r for r in rows if not r["flags"] & WORD}
    places = {t: r for t, r in tags.items() if size[r["vector"]] > 1 or r["pages"] == r["of"]}
    above: dict[int, int] = {}
    for t in places:
        up = places[t]["above"]
        while up and up not in places:
            up = tags[up]["above"] if up in tags else 0
        above[t] = up
    below: dict[int, list[int]] = {}
    for t, up in above.items():
        below.setdefault(up, []).append(t)
    order, turn = [], list(below.get(0, []))
    while turn:  # from the top down
        order.append(t := turn.pop())
        turn += below.get(t, [])
    fixed = dict.fromkeys(places, 0)
    for r in rows:
        if r["flags"] & WORD and r["above"] in fixed and (size[r["vector"]] > 1 or r["pages"] == r["count"] == r["of"]):
            fixed[r["above"]] += r["chars"]
    for t in reversed(order):
        if above[t]:
            fixed[above[t]] += fixed[t]
    held = {t: max(r["chars"] - r["links"] - fixed[t], 0) for t, r in places.items()}
    clean = [t for t in order if not places[t]["flags"] & HARD]
    mains = {t for t in clean if places[t]["flags"] & MAIN}
    containers = {t for t in mains if above[t] not in mains}
    if not containers:
        top, at = sum(held[t] for t in below.get(0, []) if not places[t]["flags"] & HARD), 0
        while top:
            best = max((t for t in below.get(at, []) if not places[t]["flags"] & HARD and places[t]["count"] == places[t]["pages"]), key=lambda t: (held[t], -t), default=0)
            if not best or held[best] < FOLLOWED * top:
                break
            at = best
        containers = {at} if at else {t for t in clean if not above[t]}
    whole = sum(places[t]["chars"] for t in containers)
    named = Counter(r["vector"] for r in places.values() if r["flags"] & NAMED)

    def record(t: int) -> bool:
        """Several named elements, their number another from page to page, each with a short first line and none with a heading."""
        r, up = places[t], places.get(above[t])
        if not r["flags"] & NAMED or named[r["vector"]] < 2 or 2 * r["count"] <= 3 * r["pages"] or up is None:
            return False
        if r["count"] % up["count"] == 0 and (r["count"] // up["count"] * up["vector"] - r["vector"]) % (1 << 62) == 0:
            return False
        inner, turn = [], list(below.get(t, []))
        while turn:
            inner.append(x := turn.pop())
            turn += below.get(x, [])
        if any(places[x]["flags"] & HEADING for x in inner):
            return False
        own = r["chars"] - sum(places[x]["chars"] for x in below.get(t, []))  # text of inline elements counts as their block's
        lines = [own, r["links"], *(places[x]["chars"] for x in inner if places[x]["vector"] == r["vector"])]
        return any(0 < n <= BYLINE * r["count"] and n < r["chars"] for n in lines)

    out: dict[int, bool] = {}
    for t in order:
        r = places[t]
        if r["flags"] & HARD or (t not in containers and not out.get(above[t], False)):
            out[t] = False
            continue
        small = t not in containers and 2 * r["chars"] < whole
        lists = small and 2 * r["links"] > r["chars"]
        told = small and r["flags"] & NAMED and not r["flags"] & MAIN and r["chars"] > 0 and 10 * fixed[t] >= 9 * (r["chars"] - r["links"])
        out[t] = not (lists or told or (small and r["flags"] & SOFT) or (t not in containers and record(t)))
    return out


def totals_of(pages: DataFrame) -> DataFrame:
    """_host and its number of pages ``of``, for hosts with pages enough and all together."""
    counts = pages.groupBy(host_column(F.col("url")).alias("_host")).agg(F.count("*").alias("of"))
    return cut(counts.union(counts.agg(F.lit(COMMON).cast("long"), F.sum("of"))).filter(F.col("of") >= LEAST_PAGES))


def templates(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """host, number of pages and slots (element -> is it text): one row per host, and one for all together."""
    parts = cut(tokens(pages, totals))
    every = merged(parts, "token").withColumn("host", F.lit(COMMON).cast("long"))
    both = parts.unionByName(every.select(*parts.columns))
    held = join_small(both, totals, both["host"] == totals["_host"]).filter(2 * F.col("pages") >= F.col("of")).drop("_host")

    def group(data: pa.Table) -> pa.Table:
        rows = data.to_pylist()
        slots = deduced(rows)
        return pa.table([pa.array([rows[0]["host"]]), pa.array([rows[0]["of"]]), pa.array([list(slots)], pa.list_(pa.int64())), pa.array([list(slots.values())], pa.list_(pa.bool_()))], names=["host", "of", "tokens", "keep"])

    return held.groupBy("host").applyInArrow(group, "host long, of long, tokens array<long>, keep array<boolean>")


def main_text(page: str, root: Place, slots: dict[int, bool]) -> str:
    """The blocks of a page that lie in slots of text, by the nearest place that decides."""
    verdicts: dict[int, bool] = {}

    def keep(place: Place) -> bool:
        passed = []
        for p in place.line():
            if p.key in verdicts:
                break
            passed.append(p.key)
            if p.hard or p.key in slots:
                verdicts[p.key] = not p.hard and slots[p.key]
            elif p.soft or (p.kind and not p.noise):
                verdicts[p.key] = not p.soft
            elif not p.tag:
                verdicts[p.key] = False
            else:
                continue
            break
        verdict = verdicts[p.key]
        verdicts.update(dict.fromkeys(passed, verdict))
        return verdict

    found = [(p, t, n) for p, t, n, opened in read(page, root) if opened is None]
    kept = [t for p, t, _ in found if keep(p)] or [t for p, t, n in found if not p.noise and 2 * n <= len(t)]
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html)."""
    has_columns(pages, "page_id", "url", "html")
    totals = totals_of(pages)
    pages = with_numbered(pages.select("page_id", "url", "html"), totals)
    found = cut(templates(pages, totals))
    rows = pages.select("page_id", "url", "html", "_numbered", host_column(F.col("url")).alias("_host"))
    common = found.filter(F.col("host") == COMMON).select(F.col("host").alias("_c"), F.struct("tokens", "keep").alias("_all"))
    own = found.filter(F.col("host") != COMMON).select(F.col("host").alias("_h"), F.struct("tokens", "keep").alias("_own"))
    joined = join_small(rows, own, rows["_host"] == own["_h"], "left", BROADCAST_HOSTS)
    joined = joined.withColumn("_any", F.lit(COMMON).cast("long")).join(common.hint("broadcast"), F.col("_any") == F.col("_c"), "left")  # one row

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, dict[int, bool]] = {}
        for batch in slices(batches, "html"):
            roots, texts = Roots(), []
            hosts, pages_in, numbered = (batch.column(c).to_pylist() for c in ("_host", "html", "_numbered"))
            for i, (host, page) in enumerate(zip(hosts, pages_in, strict=True)):
                if host not in memo:
                    if len(memo) >= 256:
                        memo.clear()
                    t = batch.column("_own")[i].as_py() or batch.column("_all")[i].as_py()
                    memo[host] = dict(zip(t["tokens"], t["keep"], strict=True)) if t else {}
                texts.append(main_text(page or "", roots.of(numbered[i]), memo[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "_host", "_own", "_all", "_numbered").mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_text": op3_html_text}
ORACLE_SQL: dict[str, str] = {}
