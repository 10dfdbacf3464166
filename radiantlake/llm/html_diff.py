"""Main text of web pages by differencing each page with its nearest URL."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpointed, steps
from .urls import url_host_path

#: A tag whose attributes are written as they should be; it never looks beyond the next < or >.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/<>]*)((?:[^<>"'=]|=\s*"[^"<>]*"|=\s*'[^'<>]*'|=(?!\s*["']))*+)>""")
TAG_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
VALUE = re.compile(r"[>=]")
NOT_SPACE = re.compile(r"\S")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|style|hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title select object canvas".split())
# Elements that are never main text.
APART = frozenset("nav footer aside form menu dialog button head search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words that say the same where they are the head of a class, an id or a role: all of them outside an article, ADVERT_WORDS also within.
ADVERT_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion replies reply sidebar signup sponsor sponsored subscribe subscription toolbar".split()
)
APART_WORDS = ADVERT_WORDS | frozenset("alert alerts banner commentary contentinfo complementary disclaimer discussion footer hidden login modal notification notifications recommended related respond responses search share sharing social widget widgets".split())
COMMENT_WORDS = frozenset("comment comments replies reply disqus".split())
# What a class name may end in without saying more, and what it may begin with to say the opposite.
HOLDERS = frozenset("area banner bar block body box col column container content group holder inner item items label list outer panel row section slot text unit widget wrap wrapper".split())
NEGATIONS = frozenset("has is no not non with without".split())
# Words of a class or an id that name the part of a page with the main text, if nothing better does.
MAIN_WORDS = frozenset("articlebody articlecontent articletext content contentmain entry entrycontent main maincontent maintext pagecontent post postbody postcontent story storybody".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# How sure a block's surroundings make it main text.
NAMED, MAIN, ARTICLE = 1, 2, 3
#: Named parts count only if they hold at least so much of the text.
MOST = 0.5
#: Pages that share at least so much of the shorter one's text, but for lines common on the host, are copies, not a template.
COPY = 0.8
#: A line is common on a host if so much of the host's different pages has it, and there are so many.
COMMON_SHARE, COMMON_PAGES = 0.8, 10
#: Elements are nested no deeper than browsers nest them; what is deeper is read as if beside.
DEPTH = 512
#: Hosts with common lines (some hundred bytes each) that are broadcast at most.
BROADCAST_SITES = 100_000
#: Pages that lose lines (about 200 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_MARKS = 200_000
#: Bits that one alignment keeps at most; beyond, the alignment is halved.
CELLS = 1 << 28


class Tags:
    """The tags of a page, one after the other, in time linear in its length.

    Quotes count only where a value begins, as in browsers; a value whose quote never
    ends has none. A comment, script or tag that never ends takes the rest of the page."""

    def __init__(self, page: str):
        self.page = page
        self.unpaired: set[str] = set()

    def _end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at at; -1 if none."""
        page = self.page
        while m := VALUE.search(page, at):
            if m[0] == ">":
                return m.start()
            value = NOT_SPACE.search(page, at := m.end())
            if value and value[0] in "\"'" and value[0] not in self.unpaired:
                end = page.find(value[0], value.end())
                if end < 0:
                    self.unpaired.add(value[0])
                at = end + 1 if end >= 0 else value.end()
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """Start, end, name (none for a comment), attributes and whether it closes; of the first tag from at on."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if m := TAG.match(page, start):
                return start, m.end(), m[2].lower(), m[3], bool(m[1])
            if m := TAG_NAME.match(page, start):
                end = self._end(m.end())
                return (start, end + 1, m[2].lower(), page[m.end() : end], bool(m[1])) if end >= 0 else (start, len(page), "", "", False)
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", "", False
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                return start, end + 1 if end >= 0 else len(page), "", "", False
            at = start + 1
        return None

    def skip(self, tag: str, at: int) -> int:
        """Where the raw content of an element ends, past its end tag."""
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
        end = self.page.find(">", m.end()) if m else -1
        return end + 1 if end >= 0 else len(self.page)


def heads(value: str) -> set[str]:
    """The word that each name of a class says what the element is: its last one, but for words like box or list; none if the first one denies it."""
    out = set()
    for name in value.split():
        words = [t.lower() for t in TOKEN.findall(name)]
        whole = "".join(words)
        while len(words) > 1 and words[-1] in HOLDERS:
            words.pop()
        if words and not (len(words) > 1 and words[0] in NEGATIONS):
            out |= {words[-1], "".join(words), whole}
    return out


def parse(html: str | None) -> tuple[list[str], bool]:
    """Blocks that may be main text in page order, and whether an article (or main) element holds them.

    Blocks of article elements if there are any, else of main, else of parts whose
    class or id says so if those hold most of the text, else all that is left. Unclosed elements end where their parent does; p and li end where the next begins.
    An article or main element is read also where a class word sets what is around it apart."""
    page = html or ""
    tags = Tags(page)
    stack: list[tuple[str, int, int]] = []  # tag, apart (1: by a word, 2: for good), how sure
    held: dict[str, int] = {}  # open elements by tag
    apart = level = deeper = 0
    runs: list[tuple[str, int]] = []
    own: list[str] = []
    low = at = 0

    def flush() -> None:
        if own:
            text = " ".join("".join(own).split())
            if text:
                runs.append((text, level))
            own.clear()

    def close(i: int) -> None:
        nonlocal apart, level
        for tag, _, _ in stack[i:]:
            held[tag] -= 1
        del stack[i:]
        apart, level = stack[-1][1:] if stack else (0, 0)

    def close_last(tag: str, bounds: tuple[str, ...] = ()) -> None:
        if held.get(tag):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    return close(i)
                if stack[i][0] in bounds:
                    return None
        return None

    while found := tags.next(at):
        start, at, tag, attributes, closes = found
        if start > low and not apart:
            own.append(unescape(page[low:start]))
        low = at
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br" and not apart:
            own.append(" ")
        if closes:
            if deeper and tag in BLOCKS:
                deeper -= 1
            else:
                close_last(tag)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            at = low = tags.skip(tag, at)
            continue
        if tag in BLOCKS and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            close_last(tag, ("ul", "ol", "dl", "table", "menu"))
        words, named, role, hidden = set(), set(), "", False
        if attributes and not attributes.isspace():
            for a in ATTRIBUTE.finditer(attributes):
                value = a[2] or a[3] or a[4] or ""
                name = a[1].lower()
                if name in ("role", "itemprop"):
                    role += f" {value}"
                elif name == "hidden" or name == "style" and HIDDEN.search(value):
                    hidden = True
                if name in ("class", "id", "role"):
                    words |= heads(value)
                if name in ("class", "id"):
                    named |= {re.sub("[^a-z]", "", t.lower()) for t in value.split()}
        inside = level
        if tag == "article" or "articleBody" in role:
            inside = ARTICLE
        elif tag == "main" or " main" in role:
            inside = max(MAIN, level)
        elif named & MAIN_WORDS and tag not in ("html", "body"):
            inside = max(NAMED, level)
        off = 2 if hidden or tag in APART or tag == "header" and level < MAIN else 0
        if words and not off and tag not in ("html", "body", "main") and tag not in HEADINGS:
            if words & COMMENT_WORDS:
                off = 2
            elif tag != "article" and (words & (APART_WORDS if level < MAIN else ADVERT_WORDS) or "header" in words and level < MAIN):
                off = 1
        if tag in BLOCKS or off or apart:
            if off and tag not in BLOCKS:
                flush()
            if len(stack) >= DEPTH:
                deeper += tag in BLOCKS
                continue
            before = 0 if apart == 1 and inside >= MAIN and inside > level else apart
            apart, level = max(before, off), inside
            stack.append((tag, apart, level))
            held[tag] = held.get(tag, 0) + 1
    if low < len(page) and not apart:
        own.append(unescape(page[low:]))
    flush()
    best = max((x for _, x in runs), default=0)
    if best == NAMED and sum(len(t) for t, x in runs if x) < MOST * sum(len(t) for t, _ in runs):
        best = 0
    return [t for t, x in runs if x >= best], best >= MAIN


def _row(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a with b[:0], b[:1], ..."""
    size = len(b)
    full = (1 << size) - 1
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((size + 7) // 8, "little"), dtype=np.uint8), bitorder="little")[:size]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by bit-parallel dynamic
    programming; a table over CELLS bits is halved at its best split."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(i, i) for i in range(head)]
    last = [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y or not set(x) & set(y):
        return ends + last
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2
        cut = int(np.argmax(_row(x[:half], y) + _row(x[half:][::-1], y[::-1])[::-1]))
        middle = common_lines(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in common_lines(x[half:], y[cut:])]
    else:
        full = (1 << len(y)) - 1
        where: dict[int, int] = {}
        for j, t in enumerate(y):
            where[t] = where.get(t, 0) | 1 << j
        rows = [full]
        for t in x:
            u = rows[-1] & where.get(t, 0)
            rows.append((rows[-1] + u | rows[-1] - u) & full)
        i, j, middle = len(x), len(y), []
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                middle.append((i, j))
        middle.reverse()
    return ends + [(i + head, j + head) for i, j in middle] + last


def template_lines(own: list[int], own_sizes: list[int], other: list[int], other_sizes: list[int], common: frozenset[int]) -> tuple[list[int], bool]:
    """Indexes of own lines that the other page shares, and whether the pages are copies but for common lines."""
    shared = [i for i, _ in common_lines(own, other)]
    rest = min(sum(n for x, n in zip(*page, strict=True) if x not in common) for page in ((own, own_sizes), (other, other_sizes)))
    return shared, sum(own_sizes[i] for i in shared if own[i] not in common) >= COPY * max(1, rest)


def _signed(data: bytes | str) -> int:
    x = xxhash.xxh64_intdigest(data)
    return x - (1 << 64) if x >> 63 else x


def _key(page_id: int | None, url: str | None, blocks: list[str]) -> int:
    """What a page and its equals have in common."""
    return _signed(repr((page_id, url, blocks)))


Line = tuple[str, str, list[int], list[int]]


def _nearness(row: Line, other: Line | None) -> int:
    """Characters of path in common; -1 for a page of another host."""
    if other is None or other[0] != row[0]:
        return -1
    n = 0
    for x, y in zip(row[1], other[1], strict=False):
        if x != y:
            break
        n += 1
    return n


def deleted_lines(row: Line, before: Line | None, after: Line | None, inside: bool, common: frozenset[int]) -> list[int]:
    """Indexes of the lines that a page loses: those it shares with the nearer neighbour, or if the two are copies with the other.

    Of copies on both sides, and inside an article, only lines that are common on the host go."""
    near = [(-n, k, x) for k, x in enumerate((before, after)) if (n := _nearness(row, x)) >= 0]
    lines: list[int] = []
    for _, _, x in sorted(near, key=lambda t: t[:2]):
        shared, copies = template_lines(row[2], row[3], x[2], x[3], common)
        if not copies:
            return [i for i in shared if row[2][i] in common] if inside else shared
        lines = lines or [i for i in shared if row[2][i] in common]
    return lines


def _outlines(batches):
    """The narrow form of pages with text: no text, only line hashes and sizes."""
    for batch in (x for whole in batches for x in steps(whole)):
        ids, urls, hosts, paths, pages = (c.to_pylist() for c in batch.columns)
        rows = []
        for page_id, url, host, path, html in zip(ids, urls, hosts, paths, pages, strict=True):
            blocks, inside = parse(html)
            if blocks:
                rows.append((_key(page_id, url, blocks), page_id, host, path, [_signed(b) for b in blocks], [len(b) for b in blocks], inside, _signed(host or "")))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_(), pa.int64()), strict=True)], names=["key", "page_id", "host", "path", "hashes", "sizes", "inside", "site"])


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _ends(batches):
    """The first and the last row of a partition."""
    first = last = None
    for row in _rows(batches):
        first, last = first or row, row
    if first:
        part = TaskContext.get().partitionId()
        cols = list(zip(*((part, at, *row[2:6]) for at, row in enumerate((first, last))), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)], names=["part", "at", "host", "path", "hashes", "sizes"])


def _differ(table):
    """For each row of a sorted partition that loses lines: those.

    Neighbours are the nearest rows of other lines in the whole order; rows of one
    partition that are copies of each other one after the other wait for the next."""

    def run(batches):
        before, after = (t.get(TaskContext.get().partitionId()) for t in table.value)
        run, found = [], []

        def judge(following):
            for row in run:
                lines = deleted_lines(row[2:6], before, following, row[6], frozenset(row[8] or ()))
                if lines:
                    found.append((row[1], row[0], lines))

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 3, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["of_page", "of_key", "template"])
            found.clear()
            return batch

        for row in _rows(batches):
            if run and (row[4] != run[0][4] or row[2] != run[0][2]):
                judge(row[2:6])
                before = run[-1][2:6]
                run.clear()
            run.append(row)
            if len(found) >= 4096:
                yield out()
        judge(after)
        yield out()

    return run


def common_on_hosts(lines: DataFrame) -> DataFrame:
    """site, common: the line hashes that COMMON_SHARE of a host's different pages have, of hosts with COMMON_PAGES or more.

    Pages of one host with the same lines count once. Counted map-side first; a host
    has no more common lines than a page has lines on average, over COMMON_SHARE."""
    pages = lines.select("site", "hashes", F.xxhash64("hashes").alias("content")).dropDuplicates(["site", "content"])
    counts = pages.select("site", F.explode(F.array_distinct("hashes")).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_SHARE * COMMON_PAGES)
    many = pages.groupBy(F.col("site").alias("_site")).agg(F.count("*").alias("pages")).where(F.col("pages") >= COMMON_PAGES)
    found = counts.join(many, F.col("site") == F.col("_site")).where(F.col("n") >= COMMON_SHARE * F.col("pages"))
    return checkpointed(found.groupBy("site").agg(F.sort_array(F.collect_list("line")).alias("common")))


def _texts(batches):
    """All pages with their blocks."""
    for batch in (x for whole in batches for x in steps(whole)):
        ids, urls, pages = (c.to_pylist() for c in batch.columns)
        blocks = [parse(html)[0] for html in pages]
        keys = [_key(*x) for x in zip(ids, urls, blocks, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, type=pa.int64()), pa.array(blocks, type=pa.list_(pa.string()))], names=["page_id", "url", "key", "blocks"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_template for every row of pages.

    Each page is paired with its neighbours by URL path within its host: line hashes
    (never texts) are range-partitioned and sorted by (host, path), so a hot host
    spreads over many tasks; the outermost rows of partitions (two each) go through
    the driver, so a page's neighbours do not depend on how rows were dealt. Text
    lines are aligned with the nearer neighbour's (longer common path; the one before
    if equal) by longest common subsequence. Lines in common are template and go
    (n_template tells how many), with two exceptions, where they go only if most of the
    host's pages have them too: between pages that are copies but for such lines, if no
    other neighbour decides; and inside an article or main element, since articles
    quote one another.

    Null html gives an empty text; a null or odd url has empty host and path and is
    paired with its like; repeated rows count once as neighbours and stay in the
    result; equal paths are ordered by page_id, then content; a very long page is read
    whole, in linear time; an empty table gives no rows; other columns are ignored.
    Pages are parsed twice rather than kept: texts are shuffled only where more than
    BROADCAST_MARKS pages lose lines."""
    host, path = url_host_path()
    lines = pages.select("page_id", "url", host.alias("host"), path.alias("path"), "html").mapInArrow(_outlines, "key bigint, page_id bigint, host string, path string, hashes array<bigint>, sizes array<int>, inside boolean, site bigint")
    lines = checkpointed(lines.dropDuplicates(["page_id", "key"]))
    common = common_on_hosts(lines)
    common = F.broadcast(common) if bounded(common, BROADCAST_SITES) else common
    order = ("host", "path", "page_id", "key")
    dealt = lines.join(common.withColumnRenamed("site", "_site"), F.col("site") == F.col("_site"), "left").drop("_site")
    dealt = checkpointed(dealt.repartitionByRange(*order).sortWithinPartitions(*order))
    ends = sorted(dealt.mapInArrow(_ends, "part int, at int, host string, path string, hashes array<bigint>, sizes array<int>").collect())
    before, after = {}, {}
    for x, y in zip(ends, ends[1:], strict=False):
        if x.part != y.part:
            before[y.part], after[x.part] = tuple(x)[2:], tuple(y)[2:]
    table = pages.sparkSession.sparkContext.broadcast((before, after))
    marks = checkpointed(dealt.mapInArrow(_differ(table), "of_page bigint, of_key bigint, template array<int>"))
    marks = F.broadcast(marks) if bounded(marks, BROADCAST_MARKS) else marks
    texts = pages.select("page_id", "url", "html").mapInArrow(_texts, "page_id bigint, url string, key bigint, blocks array<string>")
    joined = texts.join(marks, texts.page_id.eqNullSafe(marks.of_page) & (texts.key == marks.of_key), "left")
    kept = F.when(F.size("template") > 0, F.filter("blocks", lambda _, i: ~F.array_contains("template", i))).otherwise(F.col("blocks"))
    text = F.array_join(kept, "\n\n")
    return joined.select("page_id", "url", text.alias("text"), F.char_length(text).cast("bigint").alias("n_chars"), F.coalesce(F.size("template"), F.lit(0)).cast("bigint").alias("n_template"))
