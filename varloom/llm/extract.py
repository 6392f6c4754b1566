"""Main text of web pages by nearest-URL page differencing, with structure where differencing leaves a choice.

Each page is cut into text blocks, its lines. Within each host pages are ordered by URL path, and a page is paired with the
nearest page in that order whose lines differ from its own. The two lists of lines are aligned by longest common subsequence,
and what both share is template. Structure decides what alignment cannot:

* a line that no pair shares goes where its markup is that of a menu, header, footer, sidebar, notice, advert, form, script or
  reader comment, or where the page marks an article and the line stands outside it;
* a shared line stays where it is flow text (a paragraph, heading, list item and the like) of a marked article, since two
  articles may quote the same sentence, and goes anywhere else.

A pair that shares more than NEAR of a page's text may be a near copy; then the next nearest of up to four neighbours (two
on either side) is tried, and if all share as much, the one that shares least is the pair. A page of which nothing would be
left keeps its lines.

Pages are dealt by ranges of (host, path, hash of the id), so a host, or a URL, with a third of all pages spreads over many
tasks; the last and first page of a range visit its neighbour, so that ranges part no pairs. The ranges follow from the table,
not from session settings. Rows equal in URL and id lie in one range. Only hashes of lines meet and the text that may stay,
compressed.

Nulls and edges: null or empty html gives an empty text. A null url pairs with nothing. Repeated rows come back each; pages
that tie in URL are ordered by the hash of their id, then by content. Parsing takes time in proportion to the html and the
alignment memory in proportion to the lines, whatever the markup is. A page alone on its host is read by structure only. An
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import boundaries, by_bucket

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "aside button canvas dialog footer form head iframe input menu nav noscript object option script select style svg template "
    "textarea title video audio".split()
)
RAW = frozenset("script style textarea title".split())
#: A start tag of the right-hand names closes an open element of the left-hand name.
CLOSES = {
    "p": BLOCKS - {"br", "body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
#: Elements whose text in an article is the article's own, even if another page has it too.
FLOW = frozenset("article main p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption".split())
WALLS = frozenset("article aside body div footer form header main nav ol section table td th ul dl".split())
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disclaimer discussion disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
NOT_ARTICLES = frozenset("ad ads advert advertisement comment comments promo related replies reply sidebar sponsored teaser".split())
NEAR = 0.9  # of a page's text; a pair that shares more may be a near copy
#: Pages of a range, and ranges at most (a range is streamed, so it may be long).
RANGE, RANGES = 2000, 10_000
BITS, SMALL = 8192, 1024  # places compared at a time, and cells of a table that is filled plainly
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Each alternative ends at the next < or >, quotes apart, and gives nothing back: tags cost what they are long.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:((?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+)>|([^<>]*+)>)|<[!?/][^<>]*+>", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]++)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
NAMES = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words = NAMES.findall(CAMEL.sub(" ", value).lower())
            own = tag in ("main", "h1") or tag == "article" and not in_article  # names of the article itself say little
            if not (NOT_ARTICLES if own else UNWANTED).isdisjoint(words):
                return True
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Open:
    """The open elements, with the places of each name, so that none has to be searched for."""

    def __init__(self):
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.blocks: list[int] = []

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in WALLS:
            self.walls.append(len(self.names))
        if name in BLOCKS:
            self.blocks.append(len(self.names))
        self.names.append(name)

    def cut(self, depth: int) -> list[str]:
        gone = self.names[depth:]
        del self.names[depth:]
        for name in gone:
            self.places[name].pop()
        while self.walls and self.walls[-1] >= depth:
            self.walls.pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        return gone

    def flows(self) -> bool:
        return bool(self.blocks) and self.names[self.blocks[-1]] in FLOW

    def last(self, name: str) -> int:
        found = self.places.get(name)
        return found[-1] if found else -1

    def ended_by(self, tag: str) -> int:
        """Depth of the element that an end tag closes, -1 for none: an inline or paragraph end doesn't close its container."""
        depth = self.last(tag)
        return -1 if tag not in WALLS and self.walls and depth < self.walls[-1] else depth

    def pushed_out_by(self, tag: str) -> int:
        """Depth of the nearest element within its container that a start tag closes, -1 for none."""
        depth = max((self.last(name) for name, by in CLOSES.items() if tag in by), default=-1)
        return -1 if self.walls and depth < self.walls[-1] else depth


def page_blocks(html: str | None) -> list[tuple[str, bool, bool, bool]]:
    """(text, wanted, in article, flow text) of every block in page order; white space is one space, references are decoded."""
    html = html or ""
    out: list[tuple[str, bool, bool, bool]] = []
    stack = _Open()
    cut: int | None = None  # depth of the dropped element that holds what follows
    article = 0
    inside: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(inside)).split())
        inside.clear()
        if text:
            out.append((text, cut is None, article > 0, stack.flows()))

    def close(depth: int) -> None:
        nonlocal cut, article
        gone = stack.cut(depth)
        article -= gone.count("article") + gone.count("main")
        if cut is not None and depth <= cut:
            cut = None

    at = 0
    while (m := TOKEN.search(html, at)) is not None:
        inside.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3] if m[3] is not None else m[4]
        if m[1]:
            if tag in BLOCKS or tag in DROPPED:
                flush()
            depth = stack.ended_by(tag)
            if depth >= 0:
                if tag in BLOCKS or cut is None or depth <= cut:
                    flush()
                close(depth)
            continue
        if tag in BLOCKS or tag in DROPPED:
            flush()
            depth = stack.pushed_out_by(tag)
            if depth >= 0:
                close(depth)
        bad = _unwanted(tag, attributes, article > 0)
        if bad and cut is None and tag not in BLOCKS:
            flush()
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if bad and cut is None:
            cut = len(stack.names)
        article += tag in ("article", "main")
        stack.push(tag)
    inside.append(html[at:])
    flush()
    return out


def _scores(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b, by bits in blocks of b's places."""
    out, carry, base = [np.zeros(1, np.int64)], bytearray(len(a)), 0
    for start in range(0, len(b), BITS):
        part = b[start : start + BITS]
        full, v, places = (1 << len(part)) - 1, (1 << len(part)) - 1, {}
        for k, y in enumerate(part):
            places[y] = places.get(y, 0) | 1 << k
        for i, x in enumerate(a):
            m = places.get(x)
            if m is None and not carry[i]:
                continue
            u = v & (m or 0)
            total = v + u + carry[i]
            carry[i] = total >> len(part)
            v = (total & full) | (v - u)
        kept = np.unpackbits(np.frombuffer(v.to_bytes(BITS // 8, "little"), np.uint8), bitorder="little")[: len(part)]
        out.append(base + np.cumsum(1 - kept.astype(np.int64)))
        base = int(out[-1][-1])
    return np.concatenate(out)


def _table(a: list[int], b: list[int]) -> list[int]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    keep, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            keep.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return keep


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a on a longest common subsequence with b. Memory grows with the lines: halves of a are aligned apart."""
    lead, low = 0, min(len(a), len(b))
    while lead < low and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < low - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    keep = [*range(lead), *range(len(a) - tail, len(a))]
    common = set(a[lead : len(a) - tail]) & set(b[lead : len(b) - tail])  # lines of one page only align with nothing
    at = [k for k in range(lead, len(a) - tail) if a[k] in common]
    work = [([a[k] for k in at], at, [y for y in b[lead : len(b) - tail] if y in common])]
    while work:
        x, at, y = work.pop()
        if not x or not y:
            continue
        if len(x) * len(y) <= SMALL or len(x) == 1:
            keep += [at[k] for k in _table(x, y)] if len(x) > 1 else at if x[0] in y else []
            continue
        half = len(x) // 2
        split = int((_scores(x[:half], y) + _scores(x[half:][::-1], y[::-1])[::-1]).argmax())
        work += [(x[:half], at[:half], y[:split]), (x[half:], at[half:], y[split:])]
    return sorted(keep)


def _scores(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b, by bits in blocks of b's places."""
    out, carry, base = [np.zeros(1, np.int64)], bytearray(len(a)), 0
    for start in range(0, len(b), BITS):
        part = b[start : start + BITS]
        full, v, places = (1 << len(part)) - 1, (1 << len(part)) - 1, {}
        for k, y in enumerate(part):
            places[y] = places.get(y, 0) | 1 << k
        for i, x in enumerate(a):
            m = places.get(x)
            if m is None and not carry[i]:
                continue
            u = v & (m or 0)
            total = v + u + carry[i]
            carry[i] = total >> len(part)
            v = (total & full) | (v - u)
        kept = np.unpackbits(np.frombuffer(v.to_bytes(BITS // 8, "little"), np.uint8), bitorder="little")[: len(part)]
        out.append(base + np.cumsum(1 - kept.astype(np.int64)))
        base = int(out[-1][-1])
    return np.concatenate(out)


def _table(a: list[int], b: list[int]) -> list[int]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    keep, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            keep.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return keep


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a on a longest common subsequence with b. Memory grows with the lines: halves of a are aligned apart."""
    lead, low = 0, min(len(a), len(b))
    while lead < low and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < low - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    keep = [*range(lead), *range(len(a) - tail, len(a))]
    common = set(a[lead : len(a) - tail]) & set(b[lead : len(b) - tail])  # lines of one page only align with nothing
    at = [k for k in range(lead, len(a) - tail) if a[k] in common]
    work = [([a[k] for k in at], at, [y for y in b[lead : len(b) - tail] if y in common])]
    while work:
        x, at, y = work.pop()
        if not x or not y:
            continue
        if len(x) * len(y) <= SMALL or len(x) == 1:
            keep += [at[k] for k in _table(x, y)] if len(x) > 1 else at if x[0] in y else []
            continue
        half = len(x) // 2
        split = int((_scores(x[:half], y) + _scores(x[half:][::-1], y[::-1])[::-1]).argmax())
        work += [(x[:half], at[:half], y[:split]), (x[half:], at[half:], y[split:])]
    return sorted(keep)


def site_of(url: str | None) -> tuple[str, str]:
    """Host and path with query; odd URLs are their own path on an empty host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


#: What structure says of a line: it goes, it stays unless a pair shares it, it stays.
GOES, OPEN, STAYS = 0, 1, 2


@dataclass
class Page:
    """The lines of a page, as hashes, with what structure says of each and its length."""

    keys: list[int]
    says: bytes
    sizes: list[int]

    @classmethod
    def of(cls, html: str | None) -> tuple[Page, list[str]]:
        """The page and its lines that may stay."""
        blocks = page_blocks(html)
        marked = any(inside and wanted for _, wanted, inside, _ in blocks)
        says = bytes((STAYS if marked and flow else OPEN) if wanted and (inside or not marked) else GOES for _, wanted, inside, flow in blocks)
        keys = [xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t, *_ in blocks]
        lines = [t for (t, *_), s in zip(blocks, says, strict=True) if s]
        return cls(keys, says, [len(t) if s else 0 for (t, *_), s in zip(blocks, says, strict=True)]), lines

    def pair(self, near: list[Page]) -> tuple[int | None, list[int]]:
        """Which of the neighbours, nearest first, is the pair, and the lines shared with it."""
        best, whole = (2.0, None, []), sum(self.sizes)
        for k, other in enumerate(near):
            shared = shared_lines(self.keys, other.keys)
            share = sum(self.sizes[i] for i in shared) / whole if whole else 0.0
            if share <= NEAR:
                return k, shared
            if share < best[0]:
                best = share, k, shared
        return best[1], best[2]

    def kept(self, shared: list[int]) -> list[int]:
        """Places among the lines that may stay of those that do."""
        gone = {i for i in shared if self.says[i] == OPEN}
        may = [i for i, s in enumerate(self.says) if s]
        left = [n for n, i in enumerate(may) if i not in gone]
        return left or list(range(len(may)))


def _common(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@dataclass
class Run:
    """Neighbouring pages of a host with the same lines."""

    host: str | None
    content: int
    site: str
    page: Page
    lines: bytes
    rows: list[tuple]

    def text(self, around: list[Run]) -> tuple[str, int | None, int]:
        """The main text, the id of the pair, and the number of lines shared with it."""
        near: dict[int, Run] = {}
        for run in around:
            if self.host is not None and run.host == self.host and run.content != self.content:
                near.setdefault(run.content, run)
        order = sorted(near.values(), key=lambda r: -_common(r.site, self.site))
        at, shared = self.page.pair([r.page for r in order])
        lines = zlib.decompress(self.lines).decode().split("\n") if self.lines else []
        return " ".join(lines[k] for k in self.page.kept(shared)), None if at is None else order[at].rows[0][0], len(shared)


ROWS = "page_id long, url string, host string, site string, place string, bucket int, visit boolean, content long, keys array<long>, says binary, sizes array<int>, lines binary"
TEXTS = "page_id long, url string, text string, pair_id long, n_shared long"


def _placed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host, site (host and path) and place, the order of pages. A null url has a place of its own."""
    url = F.col("url").cast("string")
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(url, scheme + r"(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1))
    path = F.when(url.rlike(scheme), F.regexp_extract(url, scheme + "[^/?#]*([^#]*)", 1)).otherwise(url)
    tie = F.lpad(F.hex(F.xxhash64(F.col("page_id").cast("long"))), 16, "0")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), F.concat(host, F.lit("\x01"), path).alias("site"))
    return rows.withColumn("place", F.concat(F.coalesce("site", F.lit("")), F.lit("\x01"), tie))


def _parsed(rows: DataFrame, cuts: list[str], visits: dict[str, list[int]]) -> DataFrame:
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("site", pa.string()), ("place", pa.string()), ("bucket", pa.int32()),
        ("visit", pa.bool_()), ("content", pa.int64()), ("keys", pa.list_(pa.int64())), ("says", pa.binary()), ("sizes", pa.list_(pa.int32())), ("lines", pa.binary()),
    ])

    def parse(batches):
        for batch in batches:
            out: list[tuple] = []
            for page_id, url, html, host, site, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, lines = Page.of(html)
                digest = xxhash.xxh64(np.array(page.keys, "<i8").tobytes())
                digest.update(page.says)
                own = (digest.intdigest() - (1 << 63), page.keys, page.says, page.sizes)
                text = zlib.compress("\n".join(lines).encode("utf-8", "replace"), 1) if lines else b""
                out.append((page_id, url, host, site, place, bisect_right(cuts, place), False, *own, text))
                out += [(page_id, None, host, site, place, to, True, *own, b"") for to in visits.get(place, ())]
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.select("page_id", "url", "html", "host", "site", "place").mapInArrow(parse, ROWS)


def _paired(batches):
    """Texts of the pages of a range, which come in order of place. Two runs on either side of a run are held."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("pair_id", pa.int64()), ("n_shared", pa.int64())])
    runs: list[Run] = []  # up to two runs before the one to be told, itself, and up to two behind
    told, bucket = 0, None  # how many of them have been told

    def tell(upto: int):
        nonlocal told
        while told < upto:
            run = runs[told]
            own = [r[:2] for r in run.rows if not r[2]]
            if own:
                text, pair, shared = run.text(runs[max(0, told - 2) : told][::-1] + runs[told + 1 : told + 3])
                for begin in range(0, len(own), 100):
                    part = own[begin : begin + 100]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string()), pa.array([text] * len(part)), pa.array([pair] * len(part), pa.int64()), pa.array([shared] * len(part), pa.int64())], schema=schema)
            told += 1
        while told > 2:
            runs.pop(0)
            told -= 1

    for batch in batches:
        for page_id, url, host, site, _, now, visit, content, keys, says, sizes, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != bucket:
                yield from tell(len(runs))
                runs, told, bucket = [], 0, now
            last = runs[-1] if runs else None
            if last is None or (last.host, last.content) != (host, content) or host is None:
                yield from tell(len(runs) - 2)
                runs.append(Run(host, content, site or "", Page(keys, says, sizes), lines, []))
            runs[-1].rows.append((page_id, url, visit))
            runs[-1].lines = runs[-1].lines or lines  # a visitor comes without
    yield from tell(len(runs))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page; pair_id and n_shared say which page it was paired with, and the lines they share."""
    rows = _placed(pages)
    buckets = min(-(-rows.count() // RANGE), RANGES)
    cuts = boundaries(rows.select("page_id", "place"), "place", buckets, "page_id")

    @F.pandas_udf("int")
    def bucket(place: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, p) for p in place], dtype="int32")

    visits: dict[str, list[int]] = {}
    if cuts:  # a row for each range
        ends = rows.groupBy(bucket("place").alias("b")).agg(F.min("place").alias("first"), F.max("place").alias("last")).collect()
        ends.sort(key=lambda r: r["b"])
        for a, b in zip(ends, ends[1:], strict=False):
            visits.setdefault(a["last"], []).append(b["b"])
            visits.setdefault(b["first"], []).append(a["b"])
    dealt = by_bucket(_parsed(rows, cuts, visits), "bucket", len(cuts) + 1)
    return dealt.sortWithinPartitions("bucket", "place", "content").mapInArrow(_paired, TEXTS)
