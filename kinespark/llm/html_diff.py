"""Main text of pages by nearest-URL differencing.

A page becomes lines, one a block element, without what its markup declares to be
no content. Pages of a host are ordered by path, and each is paired with the one
before it (the first with the one after it) that has other lines. The two are
aligned by a longest common subsequence of lines; lines they share are the
template of the site and are deleted. Two guards keep content: a pair that
shares more than ``copy_share`` of the page's characters is a copy, not a
template, and lines of an explicit ``<article>`` or ``<main>`` stay.

Only digests of lines travel through the shuffle; texts meet just the lines to
delete.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.url_rules import host_of, path_of
from kinespark.session import materialise

COPY_SHARE = 0.5

_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "canvas", "object", "title"}
_SKIP = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "figure", "audio", "video", "map"}
_BLOCK = set("address article blockquote body caption center dd details div dl dt fieldset figcaption h1 h2 h3 h4 h5 h6 hgroup hr html legend li "
             "main ol option p pre section summary table tbody td tfoot th thead tr ul".split()) | _SKIP
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that name no content.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|reply|replies|cookies?|consent|disqus|footer|header|masthead|menu|nav|navbar|navigation|"
    r"newsletter|notice|pager|pagination|popup|modal|promo\w*|related|recommend\w*|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget|contentinfo|complementary|alert)(?:$|[\s_-])", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")


def lines_of(page: str) -> list[tuple[str, bool]]:
    """(line, inside an explicit article or main) of a page in order.

    Malformed markup is read as browsers do roughly: unclosed elements end with
    their parents, stray end tags are ignored, a ``<`` that opens no tag is text."""
    out: list[tuple[str, bool]] = []
    run: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, skipped, main
    at, skipped, main = 0, False, False

    def flush():
        if run:
            line = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            run.clear()
            if line:
                out.append((line, main))

    pos = 0
    while m := _TAG.search(page, pos):
        if not skipped and m.start() > at:
            run.append(page[at:m.start()])
        pos = at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    skipped, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                    break
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            pos = at = end.end() if end else len(page)
            continue
        if name == "br":
            run.append(" ")
        elif name in _BLOCK:
            flush()
        if name in _VOID:
            continue
        if name == "p" or name == "li":  # an open one ends here
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    skipped, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                    break
                if stack[k][0] in _BLOCK and stack[k][0] != "p":
                    break
        attrs = m[3] or ""
        if attrs.rstrip().endswith("/") and name not in _BLOCK:
            continue
        named = " ".join(x for a in _ATTR.findall(attrs) for x in a if x)
        inside = main or name in ("article", "main")
        # a header inside an article carries its title
        drop = (name in _SKIP and not (name in ("header", "figure") and inside)) or bool(named and _NAMES.search(named)) or bool(attrs and _HIDDEN.search(attrs))
        stack.append((name, skipped or drop, inside))
        skipped, main = skipped or drop, inside
    if not skipped and at < len(page):
        run.append(page[at:])
    flush()
    return out


def shared_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    One bit row a line of ``a`` (as whole numbers), then a walk back: the memory is
    lines of ``a`` times lines of ``b`` bits."""
    known = set(b.tolist())
    own = [i for i, x in enumerate(a.tolist()) if x in known]
    have = set(a.tolist())
    other = [x for x in b.tolist() if x in have]
    where: dict[int, int] = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | 1 << j
    full, v, rows = (1 << len(other)) - 1, (1 << len(other)) - 1, []
    for i in own:
        u = v & where[int(a[i])]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # zeros of a row mark where the length grows; row k of `rows` is after own[k]
    out, j = [], len(other)
    length = lambda k, j: (j - (rows[k] & ((1 << j) - 1)).bit_count()) if k >= 0 else 0
    k = len(own) - 1
    while k >= 0 and j > 0:
        here = length(k, j)
        if not here:
            break
        if length(k - 1, j) == here:
            k -= 1
        else:
            while length(k, j - 1) == here:
                j -= 1
            out.append(own[k])
            k, j = k - 1, j - 1
    return out[::-1]


def extract(pages: DataFrame, page: str = "html", copy_share: float = COPY_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null or empty pages give an empty text; null urls and urls without ``://`` share
    the empty host and path; repeated rows are one page for the pairing and each get
    its text; other columns aren't read. A page whose host has no page with other
    lines keeps all its lines."""

    @F.pandas_udf("struct<lines:array<string>,main:array<boolean>,keys:array<long>>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            found = [lines_of(x) if x else [] for x in pages]
            yield pd.DataFrame({
                "lines": [[x for x, _ in f] for f in found], "main": [[m for _, m in f] for f in found],
                "keys": [[xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x, _ in f] for f in found]})

    @F.pandas_udf("array<int>")
    def drop(mine: pd.Series, sizes: pd.Series, main: pd.Series, other: pd.Series) -> pd.Series:
        out = []
        for a, n, m, b in zip(mine, sizes, main, other):
            if b is None or not len(a):
                out.append([])
                continue
            both = shared_lines(np.asarray(a, np.int64), np.asarray(b, np.int64))
            copy = sum(int(n[i]) for i in both) > copy_share * max(1, sum(map(int, n)))
            out.append([] if copy else [i for i in both if not m[i]])
        return pd.Series(out)

    parsed = pages.select("page_id", "url", parse(F.coalesce(F.col(page), F.lit(""))).alias("p"))
    keyed = parsed.select("page_id", "url", "p.lines", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                          F.xxhash64("p.keys").alias("body"), "p.keys", "p.main")
    slim = keyed.select("host", "path", "body", "keys", F.transform("lines", F.length).alias("sizes"), "main")
    # written, so that its size decides how it meets the texts
    gone = materialise(paired(slim).select("host", "path", "body", drop("keys", "sizes", "main", "other").alias("gone")).where(F.size("gone") > 0), "html-gone")
    left = keyed.select("page_id", "url", "lines", "host", "path", "body").join(gone, ["host", "path", "body"], "left")
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x, i: ~F.array_contains("gone", i))), "\n")
    return left.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def paired(slim: DataFrame) -> DataFrame:
    """Distinct (host, path, body) with ``other``: the keys of the neighbour in the
    host's order of paths (the one before; for a host's first page the one after).

    Rows are spread by ranges of (host, path, body), so a host may span many tasks;
    the first and last row of each task reach its neighbours as a small table."""
    order = ["host", "path", "body"]
    spark = slim.sparkSession
    one = slim.groupBy(*order).agg(*[F.first(c).alias(c) for c in ("keys", "sizes", "main")])
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = materialise(
        materialise(one, "html-lines").repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "html-order")
    near = Window.partitionBy("part").orderBy(*order)
    marked = rows.withColumns({
        "prev": F.lag(F.struct("host", "keys")).over(near), "next": F.lead(F.struct("host", "keys")).over(near),
    })
    # one row a part at most: its last row goes to the next part that has rows, its first to the one before
    tips = rows.groupBy("part").agg(
        F.max(F.struct("host", "path", "body", "keys")).alias("last"), F.min(F.struct("host", "path", "body", "keys")).alias("first"))
    along = Window.orderBy("part")
    tips = tips.select("part", F.lag(F.struct("last.host", "last.keys")).over(along).alias("before"), F.lead(F.struct("first.host", "first.keys")).over(along).alias("after"))
    both = marked.join(tips, "part").withColumns({"prev": F.coalesce("prev", "before"), "next": F.coalesce("next", "after")})
    same = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.col(f"{c}.keys"))
    return both.withColumn("other", F.coalesce(same("prev"), same("next"))).select(*order, "keys", "sizes", "main", "other")
