"""Text of web pages without the templates of their sites.

Every element's subtree gets a Merkle hash of its tag, attributes, texts (white space collapsed) and children. Spark counts
on how many pages of a host each hash occurs; subtrees on at least MIN_PAGES pages are template, however many pages the
host has, and the outermost of them are deleted before the text is taken. The host is the lower-cased authority of the
URL, without user and port.

The recurring hashes are a few for each host. While there are at most BROADCAST_HASHES they are broadcast as sorted
numbers and no page is shuffled; beyond that every page's hashes are joined with them by key and its hits go back to it by
page_id, or by a hash of its text where that is null; pages that share either share their hits, which is no harm.

Defined cases: null html gives null text and removes nothing; empty html gives empty text; a null or odd URL belongs to
the host ''; a subtree that occurs twice on a page counts once; repeated rows count as pages of their own; void elements,
the root and the body are no subtrees; markup that never closes ends with its parent, an open head before the first thing
that can't be in one; a noscript that never closes is no noscript; an unclosed quote or '<' is text. Both ways of counting give
equal results, also for null page_ids. An empty table gives no rows; columns besides page_id, url and html are not looked
at, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terseflow.llm.common import BLOCK_SCHEMA, U64, by_part, materialize, mix, named, pack, part_of, shuffle_parts, unpack

MIN_PAGES = 5
BROADCAST_HASHES = 2_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_LIST = frozenset({"ul", "ol"})
_TABLE = frozenset({"table"})
#: What an opening tag closes, and the open tags beyond which it does not reach.
CLOSES = {t: (frozenset({"p"}), frozenset({"td", "th", "button", "object"})) for t in BLOCK}
CLOSES |= {"li": (frozenset({"li"}), _LIST), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"}))}
CLOSES |= {"tr": (frozenset({"tr"}), _TABLE), "td": (frozenset({"td", "th"}), _TABLE | {"tr"}), "th": (frozenset({"td", "th"}), _TABLE | {"tr"}), "option": (frozenset({"option"}), frozenset({"select"}))}
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript")}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_REST = r"""(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+>"""
#: A head with what can be in one, up to its end tag or to the first thing that can't.
_HEAD = rf"""<head{_REST}(?>\s+|<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(script|style|title|template)(?=[\s>]).*?(?:</\1\s*>|\Z)|<noscript(?=[\s>])(?:(?!</?(?:noscript|head|body)[\s>]).)*+</noscript\s*>|</?(?:meta|link|base|basefont|bgsound|noscript){_REST})*+(?:</head\s*>)?"""
_HIDDEN = re.compile(rf"<!--.*?(?:-->|\Z)|{_HEAD}|<(script|style|noscript)(?=[\s>]).*?(?:</\2\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
_NOSCRIPT, _NOSCRIPT_END = re.compile(r"<noscript(?=[\s>])[^>]*>", re.I), re.compile(r"</noscript\s*>", re.I)
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
_SPACES = re.compile(r"[^\S\n]+")


def elements(page: str) -> tuple[list[int], list[int], list[int]]:
    """(first character, character after the last, hash) of every element of a page, inner ones before the element they are in."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    starts, ends, hashes = [], [], []
    tags, opened, pieces = [""], [0], [[]]
    open_count: dict[str, int] = {}

    def close(at: int) -> None:
        tag, begin, own = tags.pop(), opened.pop(), pieces.pop()
        open_count[tag] -= 1
        h = digest(b"\0".join(own))
        pieces[-1].append(h.to_bytes(8, "little"))
        if tag not in ("html", "body"):
            starts.append(begin)
            ends.append(at)
            hashes.append(h)

    last_noscript = max((m.start() + 1 for m in RAW["noscript"].finditer(page)), default=0)
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)].split()
        if text:
            if tags[-1] == "head":
                close(at)
            pieces[-1].append(b"t" + " ".join(text).encode("utf-8", "replace"))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_count.get(tag):
                while tags[-1] != tag:
                    close(m.start())
                close(at)
            continue
        if tags[-1] == "head" and tag not in IN_HEAD:
            close(m.start())
        rule = CLOSES.get(tag)
        if rule and any(open_count.get(t) for t in rule[0]):
            i = len(tags) - 1
            while i and tags[i] not in rule[1] and tags[i] not in rule[0]:
                i -= 1
            if tags[i] in rule[0]:
                while len(tags) > i:
                    close(m.start())
        attributes = sorted((a.lower(), v.strip("\"'")) for a, v in _ATTRIBUTE.findall(m[3])) if m[3] else []
        head = b"<" + repr((tag, attributes)).encode("utf-8", "replace") if attributes else b"<" + tag.encode("utf-8", "replace")
        if tag in VOID or m[3].endswith("/"):
            pieces[-1].append(head)
            continue
        tags.append(tag)
        opened.append(m.start())
        pieces.append([head])
        open_count[tag] = open_count.get(tag, 0) + 1
        if tag in RAW and (tag != "noscript" or at < last_noscript):
            end = RAW[tag].search(page, at)
            pieces[-1].append(page[at : end.start() if end else len(page)].encode("utf-8", "replace"))
            at = end.end() if end else len(page)
            close(at)
    while len(tags) > 1:
        close(len(page))
    return starts, ends, hashes


def visible(page: str) -> str:
    """The text a reader sees: a line for each block, white space collapsed."""
    closed = max((m.end() for m in _NOSCRIPT_END.finditer(page)), default=0)
    page = _HIDDEN.sub(" ", page[:closed] + _NOSCRIPT.sub(" ", page[closed:]))
    out, at = [], 0
    for m in _TOKEN.finditer(page):
        out.append(page[at : m.start()].replace("\n", " "))
        tag = (m[2] or "").lower()
        out.append("\n" if tag in BLOCK or tag in ("br", "li", "tr", "dt", "dd", "title") else " " if tag in ("td", "th") else "")
        at = m.end()
    out.append(page[at:].replace("\n", " "))
    lines = (_SPACES.sub(" ", x).strip() for x in entities.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x)


def without(page: str, is_template) -> tuple[str, int]:  # noqa: ANN001
    """(page without its outermost template subtrees, their number)."""
    starts, ends, hashes = elements(page)
    marked = is_template(np.array(hashes, U64))
    cuts = sorted((starts[i], -ends[i]) for i in np.flatnonzero(marked))
    out, at, n = [], 0, 0
    for begin, end in cuts:
        if begin >= at:
            out.append(page[at:begin])
            at = -end
            n += 1
    out.append(page[at:])
    return "\n".join(out) if n else page, n


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_key(host: str) -> np.uint64:
    import xxhash

    return U64(xxhash.xxh3_64_intdigest(host.encode()))


def keys_of(host: str, hashes: list[int]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.array(hashes, U64) ^ host_key(host))


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which numbers are in a sorted array that is not empty."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def templates(pages: DataFrame, min_pages: int) -> DataFrame:
    """The keys of the recurring subtrees; pages has host and html. Hashes are counted once a page."""
    spark = pages.sparkSession
    parts = shuffle_parts(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if keys:
                k, n = np.unique(np.concatenate(keys), return_counts=True)  # a footer of all pages is one record of a task
                yield from pack(part_of(k, parts), [k, n.astype(np.uint32)], parts)
                keys.clear()

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = page.as_py()
                if page:
                    k = np.unique(keys_of(host, elements(page)[2]))
                    keys.append(k)
                    held += len(k)
            if held > 1 << 20:
                yield from flush()
                held = 0
        yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = unpack(batches, ["u8", "u4"])
        keys, own = np.unique(keys, return_inverse=True)
        total = np.bincount(own, weights=n, minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys[total >= min_pages].view(np.int64))], names=["key"])

    return by_part(pages.mapInArrow(run, BLOCK_SCHEMA), parts).mapInArrow(count, "key long")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """(page_id, host, text, n_removed): the text of every page without the subtrees that recur on its host."""
    spark = pages.sparkSession
    source = named(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), "html")
    recurring = materialize(templates(source.select("host", "html"), min_pages), "templates")
    schema = "page_id long, host string, text string, n_removed long"

    def cut(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        for batch in batches:
            texts, removed = [], []
            for i, (host, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                page = page.as_py()
                if page is None:
                    texts.append(None)
                    removed.append(0)
                    continue
                mine = known(batch, i)
                rest, n = without(page, lambda h: among(keys_of(host, h), mine)) if len(mine) else (page, 0)
                texts.append(visible(rest))
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["page_id", "host", "text", "n_removed"])

    if recurring.count() <= broadcast_hashes:
        shared = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in recurring.collect()], np.int64).view(U64)))
        return source.mapInArrow(lambda b: cut(b, lambda batch, i: shared.value), schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, host, page in zip(*(c.to_pylist() for c in batch.columns)):
                k = np.unique(keys_of(host, elements(page)[2]))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(k), pa.int64()), pa.array(k.view(np.int64))], names=["row", "key"])

    row = F.coalesce(F.col("page_id").cast("long"), F.xxhash64("host", "html"))
    hits = source.where("html is not null").select(row.alias("row"), "host", "html").mapInArrow(hashes, "row long, key long").join(recurring, "key").groupBy("row").agg(F.collect_set("key").alias("hits"))
    joined = source.join(hits, row == F.col("row"), "left").select("page_id", "host", "html", "hits")
    return joined.mapInArrow(lambda b: cut(b, lambda batch, i: np.sort(np.array(batch.column(3)[i].as_py() or [], np.int64).view(U64))), schema)
