"""Main text of web pages, by structure and by differencing with the page of the nearest URL.

A page is cut into lines, one for each block. Lines in menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments go by their elements. What an article element holds is main text. The lines
outside one are compared with those of the page of its host whose path comes nearest: they are aligned by the
longest common subsequence and shared ones deleted, as templates repeat and texts don't.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitloom.llm.columns import back, own
from hitloom.llm.urls import host_of, path_of
from hitloom.operators.neighbors import with_neighbors

# Elements that stand for a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
# Elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that are no main text, wherever they stand.
EXCLUDED = frozenset(
    "nav footer aside form script style noscript template iframe object svg math canvas audio video select button "
    "textarea menu dialog head title datalist".split()
)
# Words that mark such parts, alone or at the end of a class, id or role.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar complementary contentinfo widget notice notices cookie cookies "
    "consent gdpr popup modal overlay subscribe newsletter signup login comment comments reply replies disqus respond "
    "share sharing social related recommended pagination pager toolbar skip".split()
)
# Of those, what the heading of an article may be called.
HEADINGS = frozenset("header masthead banner".split())
# Words before a mark that make it the name of a layout or subject, or say that the part is missing.
MODIFIERS = frozenset("has no not non with without category cat tag layout template format type".split())
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(_RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\s+[^<>\"'=\s/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?|\s*/)*\s*|[^>]*)>",
    re.S | re.I,
)
# Attributes in order, so that what stands inside a value is none.
_ATTRIBUTE = re.compile(r"\s([^<>\"'=\s/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_MARKED = ("class", "id", "role")
_WORD = re.compile(r"[a-z]+")
_ENDS_P = BLOCKS - {"html", "body", "head", "title"}
_ITEMS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",)}
_ARTICLES = ("article", "main")
# Pages that share this percentage of their characters may be copies, so that what they share is no sign of a template.
COPY_PERCENT = 80


def _is_marked(rest: str, article: bool) -> bool:
    for attribute, *values in _ATTRIBUTE.findall(rest):
        if attribute.lower() not in _MARKED:
            continue
        for token in "".join(values).lower().split():
            *before, last = _WORD.findall(token) or [""]
            if last in MARKS and not (article and last in HEADINGS) and not MODIFIERS.intersection(before):
                return True
    return False


class _Open(NamedTuple):
    """An open element; but for the name, what is so of it or of one around it."""

    name: str
    out: bool = False
    article: bool = False
    # Inside an element named article, as opposed to main.
    nested: bool = False
    # Number of the innermost element outside articles that its mark rules out, or 0.
    mark: int = 0


class _Page:
    def __init__(self):
        self.lines: list[tuple[str, bool, int]] = []
        self.parts: list[tuple[str, int]] = []
        self.open: list[_Open] = [_Open("")]
        # For each mark the one around it, and whether it holds an article.
        self.around: list[int] = [0]
        self.holds: list[bool] = [True]

    def flush(self) -> None:
        for mark in dict.fromkeys(mark for _, mark in self.parts):
            line = " ".join(html.unescape("".join(data for data, of in self.parts if of == mark)).split())
            if line:
                self.lines.append((line, self.open[-1].article, mark))
        self.parts = []

    def found(self) -> list[tuple[str, bool]]:
        """Without marked parts, but for those that hold an article if there is none elsewhere."""
        only = not any(inside and not mark for _, inside, mark in self.lines)
        return [(line, inside) for line, inside, mark in self.lines if not mark or only and self.holds[mark]]

    def text(self, data: str) -> None:
        if data and not self.open[-1].out:
            self.parts.append((data, self.open[-1].mark))

    def close_to(self, name: str, within: tuple[str, ...] = ()) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == name:
                if any(entry.name in BLOCKS for entry in self.open[i:]):
                    self.flush()
                del self.open[i:]
                return
            if self.open[i].name in within:
                return

    def start(self, name: str, rest: str) -> None:
        if name == "br":
            self.text(" ")
        if name in BLOCKS:
            self.flush()
            if name in _ENDS_P:
                self.close_to("p", ("table", "td", "th", "button", "object", *EXCLUDED, "div", "article", "section", "main", "blockquote", "li"))
            if name in _ITEMS:
                for other in ("dd", "dt") if name in ("dd", "dt") else ("td", "th") if name in ("td", "th") else (name,):
                    self.close_to(other, _ITEMS[name])
        if name in VOID or rest.rstrip().endswith("/") and name in EXCLUDED:
            return
        parent = self.open[-1]
        out = parent.out or name in EXCLUDED or (name == "header" and not parent.article)
        mark = parent.mark
        # An article around all others is never ruled out by its marks; one inside another may be a comment.
        spared = name in ("html", "body", "main") or (name == "article" and not parent.nested)
        if not out and not spared and _is_marked(rest, parent.article):
            if parent.article:
                out = True
            else:
                self.around.append(mark)
                self.holds.append(False)
                mark = len(self.around) - 1
        if name in _ARTICLES and not out:
            at = mark
            while not self.holds[at]:
                self.holds[at] = True
                at = self.around[at]
        self.open.append(_Open(name, out, parent.article or name in _ARTICLES, parent.nested or name == "article", mark))

    def end(self, name: str) -> None:
        if name == "p" and not any(entry.name == "p" for entry in self.open):
            self.flush()
            return
        if name in BLOCKS:
            self.flush()
        self.close_to(name)


def page_lines(source: str) -> list[tuple[str, bool]]:
    """The lines of a page that no element rules out, each with whether an article holds it."""
    page = _Page()
    at = 0
    for token in _TOKEN.finditer(source):
        page.text(source[at : token.start()])
        at = token.end()
        name = token["name"]
        if name:
            name = name.lower()
            if token["end"]:
                page.end(name)
            else:
                page.start(name, token["rest"])
    page.text(source[at:])
    page.flush()
    return page.found()


def shared_lines(lines: list, other: list) -> set[int]:
    """Which lines belong to a longest common subsequence with the other page's lines.

    Equal runs at both ends are taken first; the rest goes through the table of lengths, one row of bytes per
    line. Of several longest ones, that which matches earlier lines of the other page.
    """
    n, m = len(lines), len(other)
    head = 0
    while head < n and head < m and lines[head] == other[head]:
        head += 1
    tail = 0
    while tail < n - head and tail < m - head and lines[n - 1 - tail] == other[m - 1 - tail]:
        tail += 1
    found = set(range(head)) | set(range(n - tail, n))
    there = set(other[head : m - tail])
    own = [i for i in range(head, n - tail) if lines[i] in there]
    here = {lines[i] for i in own}
    theirs = [line for line in other[head : m - tail] if line in here]
    if not own:
        return found
    table = np.zeros((len(own) + 1, len(theirs) + 1), dtype=np.int32)
    codes = {line: k for k, line in enumerate(dict.fromkeys(theirs))}
    theirs_codes = np.array([codes[line] for line in theirs])
    for i in range(len(own) - 1, -1, -1):
        match = theirs_codes == codes[lines[own[i]]]
        best = np.where(match, table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    i = j = 0
    while i < len(own) and j < len(theirs):
        if lines[own[i]] == theirs[j] and table[i, j] == table[i + 1, j + 1] + 1:
            found.add(own[i])
            i, j = i + 1, j + 1
        elif table[i, j] == table[i, j + 1]:
            j += 1
        else:
            i += 1
    return found


_PARSED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("lines", T.ArrayType(T.StringType())),
        T.StructField("inside", T.ArrayType(T.BooleanType())),
        T.StructField("digest", T.BinaryType()),
    ]
)


@F.arrow_udf(_PARSED)
def _parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``text`` is the main text of a page that articles hold whole, else null; ``lines`` has the lines of a page with some outside."""
    for column in batches:
        texts, lines, insides, digests = [], [], [], []
        for source in column:
            found = page_lines(source.as_py() or "")
            is_open = not all(inside for _, inside in found)
            texts.append(None if is_open else "\n".join(line for line, _ in found))
            lines.append([line for line, _ in found] if is_open else None)
            insides.append([inside for _, inside in found] if is_open else None)
            digests.append(_digest(_keys(found)) if is_open else None)
        yield pa.StructArray.from_arrays(
            [
                pa.array(texts, pa.string()), pa.array(lines, pa.list_(pa.string())),
                pa.array(insides, pa.list_(pa.bool_())), pa.array(digests, pa.binary()),
            ],
            names=["text", "lines", "inside", "digest"],
        )


def _keys(found: list[tuple[str, bool]]) -> list[bytes]:
    """For each line a 16-byte digest, a byte that is 1 inside an article, and its length in characters."""
    from hashlib import blake2b

    return [
        blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest() + bytes([inside]) + len(line).to_bytes(4, "big")
        for line, inside in found
    ]


def _digest(keys: list[bytes]) -> bytes:
    from hashlib import blake2b

    return blake2b(b"".join(keys), digest_size=16).digest()


@F.arrow_udf(T.StructType([T.StructField("lines", T.BinaryType()), T.StructField("keys", T.ArrayType(T.BinaryType()))]))
def _line_keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The keys of a page's lines, and a digest of them all; null if no line lies outside an article."""
    for column in batches:
        rows = [_keys(page_lines(source.as_py() or "")) for source in column]
        rows = [keys if any(not key[16] for key in keys) else None for keys in rows]
        digests = [None if keys is None else _digest(keys) for keys in rows]
        yield pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(rows, pa.list_(pa.binary()))], names=["lines", "keys"])


def alike(keys: list[bytes], other: list[bytes]) -> bool:
    """Whether two pages may be copies: they share ``COPY_PERCENT`` of the longer one's characters."""
    shared = sum(int.from_bytes(keys[i][17:], "big") for i in shared_lines(keys, other))
    longer = max(sum(int.from_bytes(key[17:], "big") for key in side) for side in (keys, other))
    return 100 * shared >= COPY_PERCENT * longer


@F.arrow_udf(T.StringType())
def _difference(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The lines inside an article, and of the others those not shared with the first candidate that is no copy."""
    for lines, insides, candidates in batches:
        texts = []
        for own, inside, others in zip(lines.to_pylist(), insides.to_pylist(), candidates.to_pylist()):
            keys = _keys(list(zip(own, inside)))
            other = next((o for o in others or [] if not alike(keys, o)), [])
            outside = [i for i, held in enumerate(inside) if not held]
            theirs = [key for key in other if not key[16]]
            shared = {outside[k] for k in shared_lines([keys[i] for i in outside], theirs)}
            texts.append("\n".join(line for i, line in enumerate(own) if i not in shared))
        yield pa.array(texts, pa.string())


@F.arrow_udf(T.IntegerType())
def _common_start(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """How many characters two texts begin with alike; null if one is null."""
    from os.path import commonprefix

    for a, b in batches:
        both = zip(a.to_pylist(), b.to_pylist())
        yield pa.array([None if x is None or y is None else len(commonprefix([x, y])) for x, y in both], pa.int32())


def candidate_pages(pages: DataFrame, folder: str, url_column: str, html_column: str) -> DataFrame:
    """For each host (``_host``) and different list of lines (``_lines``) the line keys of pages to compare it with (``_others``).

    Only pages with lines outside articles count. Pages of a host with the same lines are one, under the least of their
    paths, and so are pages of one path: crawls of one address differ little, so a page is compared with the paths
    beside its own, first that which shares the longer start (the one before if both do). Only a host with a single
    path has its pages compared with each other, in order of their digests. Hosts of any size are cut into ranges.
    """
    url, source = F.col(f"`{url_column}`"), F.coalesce(F.col(f"`{html_column}`"), F.lit(""))
    parsed = pages.select(host_of(url).alias("_host"), path_of(url).alias("_path"), _line_keys(source).alias("_found"))
    parsed = parsed.filter(F.col("_found.lines").isNotNull()).select("_host", "_path", F.col("_found.lines").alias("_lines"), F.col("_found.keys").alias("_keys"))
    parsed.groupBy("_host", "_lines").agg(F.min("_path").alias("_path"), F.first("_keys").alias("_keys")).write.parquet(f"{folder}/lines")
    groups = pages.sparkSession.read.parquet(f"{folder}/lines")

    def beside(side: str):
        return F.when(F.col(f"{side}._host") == F.col("_host"), F.col(f"{side}._lines"))

    # The neighbours carry a digest of their lines; the lines themselves are fetched for candidates only.
    carried = ["_host", "_path", "_lines"]
    paths = with_neighbors(groups.groupBy("_host", "_path").agg(F.min("_lines").alias("_lines")), ["_host", "_path"], carried, f"{folder}/paths")
    ends = {side: F.coalesce(_common_start("_path", F.when(F.col(f"{side}._host") == F.col("_host"), F.col(f"{side}._path"))), F.lit(-1)) for side in ("before", "after")}
    paths = paths.withColumn("_start_before", ends["before"]).withColumn("_start_after", ends["after"])
    first, second = beside("before"), beside("after")
    ordered = F.when(F.col("_start_before") >= F.col("_start_after"), F.array(first, second)).otherwise(F.array(second, first))
    paths = paths.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), F.array_compact(ordered).alias("_by_path"))
    near = with_neighbors(groups.drop("_keys"), ["_host", "_path", "_lines"], carried, f"{folder}/groups")
    near = near.join(paths, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")))
    by_page = F.array_compact(F.array(beside("before"), beside("after")))
    chosen = F.when(F.size("_by_path") > 0, F.col("_by_path")).otherwise(by_page)
    wanted = near.select("_host", "_lines", F.posexplode(chosen).alias("_place", "_other"))
    keys = groups.select(F.col("_host").alias("_h"), F.col("_lines").alias("_other"), "_keys")
    found = wanted.join(keys, (F.col("_host") == F.col("_h")) & (wanted["_other"] == keys["_other"]))
    return found.groupBy("_host", "_lines").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_place", "_keys"))), lambda x: x["_keys"]).alias("_others")
    )


def extract(
    pages: DataFrame, folder: str, url_column: str = "url", html_column: str = "html",
) -> DataFrame:
    """Append ``text``, the main text of each page: its blocks in order, joined by line feeds.

    A null page is empty, and so is the text of a page without any. Character references are decoded,
    white space inside a block becomes one space. Lines inside an article element stay even if the nearest page has
    them too; of those outside, on any page, go the ones that the nearest page has outside its articles, if that
    page is no copy (``COPY_PERCENT``). A page with copies only beside it keeps its lines. Pages without a url are on a host of their own name (empty); pages of a host with equal lines
    get equal texts, and are no neighbours of each other. A column ``text`` is replaced; an empty table gives no rows.
    ``folder``, shared by all executors, takes tables of line digests.
    """
    url, source = F.col(f"`{url_column}`"), F.coalesce(F.col(f"`{html_column}`"), F.lit(""))
    parsed = pages.select(*own(pages, ("text",)), host_of(url).alias("_host"), _parse(source).alias("_parsed"))
    open_pages = parsed.filter(F.size("_parsed.lines") > 0).withColumn("_lines", F.col("_parsed.digest"))
    settled = parsed.filter(F.coalesce(F.size("_parsed.lines"), F.lit(0)) <= 0)
    names = back(pages, ("text",))
    compared = open_pages.join(candidate_pages(pages, folder, url_column, html_column), ["_host", "_lines"], "left")
    return settled.select(*names, F.coalesce("_parsed.text", F.lit("")).alias("text")).unionByName(
        compared.select(*names, _difference("_parsed.lines", "_parsed.inside", "_others").alias("text"))
    )
