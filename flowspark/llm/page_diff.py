"""HTML extraction by differencing pages with their nearest URL on the same host.

A page is cut into lines (the texts of its blocks). Lines in scripts, styles, menus,
headers, footers, sidebars, notices, adverts, forms and reader comments never count; a class
name says so as a whole (`ad-box`, not `ad-free`) and never of html, body, main or article.
Elements end as in a browser: with implied end tags and with their parent.
If the page marks its article (`article`, `main`), the lines in it are the text,
otherwise all lines. Every page is compared with the page whose URL path is nearest on
its host among those with another line-up: lines are aligned by longest common
subsequence, shared lines are the site's template and go. A neighbour that shares
more than half of a marked article's characters (four fifths of an unmarked page's) is a copy, and
the neighbour on the other side is asked; if both are copies, all lines stay.

Hashes of the lines are range-partitioned and sorted by (host, path, id), so a page's neighbours are the rows
beside it and a host of any size is spread over tasks. Neighbouring pages of one line-up form
a run; runs at the ends of a partition are settled in a second small step, which looks
through any number of partitions. Only numbers of lines to drop come back to the pages.

Defined cases: a null or empty html has the empty text; a null url is of the empty host;
a page alone on its host, or among copies only, loses nothing to differencing; repeated rows are pages of their own;
an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import html as entities
import os.path
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import save
from flowspark.llm.host_reputation import host_and_path

#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template head iframe svg math canvas object audio video select option button textarea".split())
#: Elements that hold no part of an article.
CHROME = frozenset("nav footer aside form dialog menu".split())
#: Words in class, id or role that say the same of any element.
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "cookie cookies consent notice popup modal newsletter subscribe signup login "
    "comment comments reply replies disqus share sharing social related recommended".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: A neighbour that shares more than this part of the text's characters is a copy, not a template.
COPY_ARTICLE, COPY_PAGE = 0.5, 0.8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?][^>]*>?", re.DOTALL | re.IGNORECASE)
_NAMES = re.compile(r"(?:^|(?<=[\s\"'/]))(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z0-9]+")
#: Parts of a class name that say where or how, not what: `ad-box` is an advert, `ad-free` and `no-sidebar` are none.
PLACES = frozenset(
    "box bar block container wrapper wrap inner outer area section list item items link links widget panel slot unit row col column "
    "top bottom left right main site page global primary secondary header head form message button buttons text".split())
#: Parts that say whose comments or links an element holds.
OWNERS = frozenset("post entry article blog user reader".split())
#: Elements that hold the page, and are never chrome by name.
FRAME = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_PARTS = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: Start tags that end an open element of the same family, unless one of the others lies between.
_SIBLINGS = {
    **dict.fromkeys(["li"], (frozenset(["li"]), frozenset("ul ol menu dir table".split()))),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset("dl table".split()))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["table"]))),
    **dict.fromkeys(["tr"], (frozenset(["tr", "td", "th"]), frozenset(["table"]))),
    **dict.fromkeys(["thead", "tbody", "tfoot"], (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"]))),
    **dict.fromkeys(["option"], (frozenset(["option"]), frozenset("select optgroup datalist".split()))),
    **dict.fromkeys(["optgroup"], (frozenset(["option", "optgroup"]), frozenset(["select"]))),
}
_CELLS = frozenset("td th caption table html".split())
_TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption colgroup".split())


def _is_chrome(tag: str, rest: str, in_article: bool) -> bool:
    if tag in FRAME:
        return False
    if tag in SILENT or tag in CHROME or (tag == "header" and not in_article):
        return True
    if "=" not in rest or tag in INLINE or tag in HEADINGS:      # names are asked of containers only
        return False
    for found in _NAMES.finditer(rest):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            parts = [x for x in _PARTS.split(name) if x and not x.isdigit()]
            if "header" in parts and not in_article and all(x in PLACES or x in CHROME_NAMES for x in parts):
                return True
            if not CHROME_NAMES.isdisjoint(parts) and all(x in PLACES or x in CHROME_NAMES or x in OWNERS for x in parts):
                return True
    return False


def _implied_end(open_tags: list[str], tag: str) -> int:
    """How many of the open elements stay open when an element `tag` starts."""
    keep = len(open_tags)
    if keep and tag not in HEAD_PARTS and "head" in open_tags:
        keep = open_tags.index("head")
    if tag in ENDS_P:
        for at in range(keep - 1, -1, -1):
            if open_tags[at] == "p":
                keep = at
                break
            if open_tags[at] in _CELLS or open_tags[at] == "button":
                break
    if tag in _SIBLINGS:
        family, fence = _SIBLINGS[tag]
        for at in range(keep - 1, -1, -1):
            if open_tags[at] in fence:
                break
            if open_tags[at] in family:
                keep = at
    return keep


def _end(open_tags: list[str], tag: str) -> int:
    """How many of the open elements stay open after the end tag `tag`."""
    if tag in ("body", "html"):
        return 0
    for at in range(len(open_tags) - 1, -1, -1):
        here = open_tags[at]
        if here == tag:
            return at
        if (here == "table" if tag in _TABLE_PARTS else here in _CELLS) or (tag == "li" and here in ("ul", "ol")) or (
                tag in INLINE and here not in INLINE):
            break
    return len(open_tags)


def lines_of(page: str | None) -> tuple[list[str], list[bool], bool]:
    """(all lines that count, which of them lie in a marked article, whether an article is marked)"""
    lines, inside = [], []
    buffer: list[str] = []
    open_tags: list[str] = []
    skip = -1                      # place of the element that is skipped
    articles = 0                   # open article and main elements
    marked = False

    def flush():
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                lines.append(text)
                inside.append(articles > 0)
            buffer.clear()

    def close(keep):
        nonlocal skip, articles
        if skip >= keep:
            skip = -1
        if articles:
            articles -= sum(x in ("article", "main") for x in open_tags[keep:])
        del open_tags[keep:]

    page = page or ""
    at = 0
    for token in _TOKEN.finditer(page):
        if skip < 0 and token.start() > at:
            buffer.append(page[at:token.start()])
        at = token.end()
        if token["tag"] is None:
            continue
        tag = token["tag"].lower()
        if tag not in INLINE and skip < 0:
            flush()
        if token["end"]:
            keep = _end(open_tags, tag)
            if keep < len(open_tags):
                close(keep)
            continue
        keep = _implied_end(open_tags, tag)
        if keep < len(open_tags):
            close(keep)
        if tag in VOID or token["rest"].endswith("/"):
            continue
        if skip < 0 and _is_chrome(tag, token["rest"], articles > 0):
            flush()
            skip = len(open_tags)
        open_tags.append(tag)
        if tag in ("article", "main"):
            articles += 1
            marked = marked or skip < 0
    if skip < 0:
        buffer.append(page[at:])
    flush()
    return lines, inside, marked


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Positions in `a` of a longest common subsequence with `b`."""
    numbers: dict[str, int] = {}
    left = np.array([numbers.setdefault(x, len(numbers)) for x in a], np.int64)
    right = np.array([numbers.setdefault(x, len(numbers)) for x in b], np.int64)

    def row(previous, x, y):
        step = np.where(y == x, previous[:-1] + 1, previous[1:])
        return np.concatenate([[0], np.maximum.accumulate(np.maximum(step, previous[1:]))])

    def align(x, y, offset):
        head = 0
        while head < min(len(x), len(y)) and x[head] == y[head]:
            head += 1
        found = list(range(offset, offset + head))
        x, y, offset = x[head:], y[head:], offset + head
        if not len(x) or not len(y):
            return found
        if len(x) * len(y) <= 1 << 22:
            table = [np.zeros(len(y) + 1, np.int64)]
            for value in x:
                table.append(row(table[-1], value, y))
            i, j, back = len(x), len(y), []
            while i and j:
                if x[i - 1] == y[j - 1]:
                    i, j = i - 1, j - 1
                    back.append(offset + i)
                elif table[i - 1][j] >= table[i][j - 1]:
                    i -= 1
                else:
                    j -= 1
            return found + back[::-1]
        half = len(x) // 2           # long pages: split where both halves together are longest
        top = np.zeros(len(y) + 1, np.int64)
        for value in x[:half]:
            top = row(top, value, y)
        low = np.zeros(len(y) + 1, np.int64)
        for value in x[:half - 1:-1]:
            low = row(low, value, y[::-1])
        cut = int(np.argmax(top + low[::-1]))
        return found + align(x[:half], y[:cut], offset) + align(x[half:], y[cut:], offset + half)

    return align(left, right, 0)


def template_lines(path: str, hashes: list[int], sizes: list[int], marked: bool, others: list[tuple[str, list[int]]]) -> list[int]:
    """Which lines of a page's text its nearest page shares, as numbers among the lines of the text.

    `sizes` are the lines' lengths, negative for a line that is not part of the text. A page that shares so
    much of the text that it is a copy says nothing of the template; the other neighbour is asked then.
    """
    total = sum(x for x in sizes if x > 0)
    number = np.cumsum(np.array(sizes, np.int64) > 0) - 1
    # The longest common start of the path first.
    for _, other in sorted(others, key=lambda x: -len(os.path.commonprefix([path, x[0]]))):
        shared = [i for i in common_lines(hashes, other) if sizes[i] > 0]
        if sum(sizes[i] for i in shared) <= (COPY_ARTICLE if marked else COPY_PAGE) * total:
            return [int(number[i]) for i in shared]
    return []


def _text_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to the lines of their text, before differencing."""
    for batch in batches:
        found = []
        for page in batch.column("html"):
            lines, inside, marked = lines_of(page.as_py())
            found.append([x for x, i in zip(lines, inside, strict=True) if i or not marked])
        yield batch.drop_columns(["html"]).append_column("lines", pa.array(found, pa.list_(pa.string())))


def _line_ups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to the hashes and lengths of all their lines."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        hashes, sizes, marks = [], [], []
        for page in batch.column("html"):
            lines, inside, marked = lines_of(page.as_py())
            hashes.append(np.fromiter((digest(x) for x in lines), np.uint64, len(lines)).view(np.int64))
            sizes.append([len(x) if i or not marked else -len(x) for x, i in zip(lines, inside, strict=True)])
            marks.append(marked)
        columns = batch.drop_columns(["html"])
        new = {"hashes": pa.array(hashes, pa.list_(pa.int64())), "sizes": pa.array(sizes, pa.list_(pa.int32())), "marked": pa.array(marks, pa.bool_())}
        yield pa.RecordBatch.from_arrays([*columns.columns, *new.values()], names=[*columns.schema.names, *new])


#: kind is `drop` (a page and its template lines), `open` (a page whose run meets an end of the partition) or `run`.
_DRAFT = "page_id {id}, key long, kind string, path string, sizes array<int>, marked boolean, dropped array<int>, " \
         "part int, run int, last boolean, host string, first_path string, last_path string, hashes array<long>"
_KINDS = {"key": pa.int64(), "kind": pa.string(), "path": pa.string(), "sizes": pa.list_(pa.int32()), "marked": pa.bool_(),
          "dropped": pa.list_(pa.int32()), "part": pa.int32(), "run": pa.int32(), "last": pa.bool_(), "host": pa.string(),
          "first_path": pa.string(), "last_path": pa.string(), "hashes": pa.list_(pa.int64())}


class _Run:
    """Neighbouring pages of a host with the same line-up."""

    def __init__(self, number: int, row: dict):
        self.number, self.host, self.hashes = number, row["host"], row["hashes"]
        self.first_path = self.last_path = row["path"]
        self.members: list[dict] = []


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and path: template lines where both neighbours are known, and what the partition's ends need."""
    part = TaskContext.get().partitionId()
    done: list[dict] = []
    kind = None

    def batch_of(rows):
        columns = {"page_id": pa.concat_arrays([r["page_id"] if "page_id" in r else pa.nulls(1, kind) for r in rows])}
        return pa.record_batch(columns | {name: pa.array([r.get(name) for r in rows], t) for name, t in _KINDS.items()})

    def describe(run, last):
        done.append({"kind": "run", "part": part, "run": run.number, "last": last, "host": run.host, "first_path": run.first_path,
                     "last_path": run.last_path, "hashes": run.hashes})

    def settle(before, run, after):
        """Pages of a run between two others."""
        others = [(x.last_path if x is before else x.first_path, x.hashes) for x in (before, after) if x.host == run.host]
        known: dict = {}
        for row in run.members if others else []:
            near = (row["path"], tuple(row["sizes"]), row["marked"])
            if near not in known:
                known.clear()
                known[near] = template_lines(row["path"], run.hashes, row["sizes"], row["marked"], others)
            if known[near]:
                done.append({"page_id": row["page_id"], "key": row["key"], "kind": "drop", "dropped": known[near]})

    def leave_open(run):
        done.extend({"kind": "open", "part": part, "run": run.number, **{k: row[k] for k in ("page_id", "key", "path", "sizes", "marked")}}
                    for row in run.members)

    before, now = None, None
    for batch in batches:
        kind = batch.column("page_id").type
        columns = {name: batch.column(name).to_pylist() for name in ("key", "host", "path", "hashes", "sizes", "marked")}
        for i in range(batch.num_rows):
            row = {name: values[i] for name, values in columns.items()}
            row["page_id"] = batch.column("page_id").slice(i, 1)
            if now is None or row["host"] != now.host or row["hashes"] != now.hashes:
                following = _Run(now.number + 1 if now else 0, row)
                if before is not None:
                    settle(before, now, following)
                elif now is not None:
                    leave_open(now)
                if now is not None and now.number < 2:
                    describe(now, False)
                before, now = now, following
                if before is not None:
                    before.members = []
            now.last_path = row["path"]
            now.members.append({k: row[k] for k in ("page_id", "key", "path", "sizes", "marked")})
        if done:
            yield batch_of(done)
            done.clear()
    if now is not None:
        leave_open(now)
        if before is not None and before.number >= 2:
            describe(before, False)
        describe(now, True)
        yield batch_of(done)


def _beside(runs: list) -> list[tuple[int, int, int | None, int | None, int | None, int | None]]:
    """(part, run, part and run before, part and run after): the nearest runs of another line-up on the host, across partitions.

    `runs` are rows (part, run, last, host, line_up) of the first two and last two runs of each partition.
    """
    parts: dict[int, list] = {}
    for row in sorted(runs, key=lambda r: (r["part"], r["run"])):
        parts.setdefault(row["part"], []).append(row)
    order = sorted(parts)

    def walk(order, ends):
        """The neighbour of the run at the near end of each partition, going away from `order`'s start."""
        found, known = {}, None          # the run at the far end of the partition before, and its own neighbour
        for part in order:
            near, far = ends(parts[part])
            here = None
            if known is not None and known[0]["host"] == near["host"]:
                here = known[0] if known[0]["line_up"] != near["line_up"] else known[1]
            found[part, near["run"]] = here
            if far is near:
                known = (far, here)
            else:
                inside = parts[part][-2] if far is parts[part][-1] else parts[part][1]
                inside = inside if inside["host"] == far["host"] else None
                found[part, far["run"]] = inside
                known = (far, inside)
        return found

    up = walk(order, lambda p: (p[0], p[-1]))
    down = walk(order[::-1], lambda p: (p[-1], p[0]))
    return [(*key, *((x["part"], x["run"]) if (x := up[key]) else (None, None)), *((x["part"], x["run"]) if (x := down[key]) else (None, None)))
            for key in sorted(up)]


def _open_lines(path, hashes, sizes, marked, up_path, up, down_path, down):
    others = [(p, h) for p, h in ((up_path, up), (down_path, down)) if h is not None]
    return template_lines(path, hashes, sizes, marked, others)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text): a row per row of `pages`."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        F.xxhash64(F.col(url), F.col(html)).alias("key"))
    kind = rows.schema["page_id"].dataType.simpleString()
    # Hashes of lines travel, not the lines.
    named = pages.select(F.col(page_id).alias("page_id"), F.xxhash64(F.col(url), F.col(html)).alias("key"), host.alias("host"),
                         path.alias("path"), F.col(html).alias("html"))
    line_ups = named.mapInArrow(_line_ups, f"page_id {kind}, key long, host string, path string, hashes array<long>, sizes array<int>, marked boolean")
    order = ["host", "path", "page_id", "key"]
    ordered = line_ups.repartitionByRange(*order).sortWithinPartitions(*order)
    drafts = save(ordered.mapInArrow(_stream, _DRAFT.format(id=kind)), "page-drafts")
    # Runs of pages at the ends of partitions: at most four small rows per partition tell which runs lie beside them.
    runs = drafts.where("kind = 'run'").select("part", "run", "last", "host", "first_path", "last_path", "hashes")
    ends = runs.select("part", "run", "last", F.xxhash64("host").alias("host"), F.xxhash64("hashes").alias("line_up")).collect()
    beside = spark.createDataFrame(_beside(ends), "part int, run int, up_part int, up_run int, down_part int, down_run int")

    def side(name, path):
        return runs.select(F.col("part").alias(f"{name}_part"), F.col("run").alias(f"{name}_run"), F.col(path).alias(f"{name}_path"),
                           F.col("hashes").alias(name))

    placed = beside.join(runs.select("part", "run", "hashes"), ["part", "run"])
    placed = placed.join(side("up", "last_path"), ["up_part", "up_run"], "left").join(side("down", "first_path"), ["down_part", "down_run"], "left")
    placed = placed.select("part", "run", "hashes", "up_path", "up", "down_path", "down").where("up IS NOT NULL OR down IS NOT NULL")
    found = F.udf(_open_lines, "array<int>")("path", "hashes", "sizes", "marked", "up_path", "up", "down_path", "down")
    late = drafts.where("kind = 'open'").select("page_id", "key", "path", "sizes", "marked", "part", "run").join(placed, ["part", "run"])
    late = late.select("page_id", "key", found.alias("dropped")).where(F.size("dropped") > 0)
    dropped = drafts.where("kind = 'drop'").select("page_id", "key", "dropped").unionByName(late)
    # Repeated rows have equal lines to drop.
    dropped = save(dropped.dropDuplicates(["page_id", "key"]).select(F.col("page_id").alias("id"), F.col("key").alias("of"), "dropped"), "page-template")
    texts = rows.select("page_id", "url", "key", "html").mapInArrow(_text_lines, f"page_id {kind}, url string, key long, lines array<string>")
    joined = texts.join(dropped, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of")), "left")
    own = F.filter("lines", lambda x, i: ~F.array_contains("dropped", i))
    return joined.select("page_id", "url", F.array_join(F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(own), " ").alias("text"))
