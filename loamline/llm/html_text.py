"""Main text of web pages: site templates are found by counting element subtrees for each host.

1. Every page is cut into its elements, and each block element that holds text gets a hash
   of its whole subtree: tags, texts and order, without attributes. (host, subtree, digest
   of the page's main text) is counted in Spark, so copies of one page count once.
2. Counts of ``LEAST_PAGES`` or more go to sorted files in the shared folder, cut by hash,
   which workers map into memory; nothing of them passes through the driver but a row for
   each file.
3. Pages are read again. A subtree that recurs on at least ``LEAST_PAGES`` different pages
   of its host, and on a share of ``LEAST_SHARE`` of them, is deleted, and so is what its
   name tells: scripts, styles, menus, headers and footers outside of the article, sidebars,
   forms, and elements whose class, id or role names a notice, an advert or comments.
4. Of what is left the article is taken (outermost ``article`` elements, else ``main``, else
   the whole page), one text for each block.

Paragraphs and headings of the main text are never deleted for recurring, as passages and
whole articles recur too; lists, tables and other containers in it are, if they recur on
pages of different main texts. Without ``article`` or ``main``, the paragraphs of the element
with most paragraph text count as main text here.

Defined results: a null, empty or markup-only page has an empty text; text outside of any
tag is a page's text; unclosed elements end where an element that can't stand in them
begins, or with the page; a tag that the page's end cuts off is dropped. A null address is a
host of its own. Null ids and repeated rows are pages of their own, repeated ones count once
as templates. An empty table gives an empty result. Other columns pass through ``extract``;
of these, ``text``, ``n_chars`` and ``n_template`` are replaced.
"""

from __future__ import annotations

import os
import re
from collections import OrderedDict
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loamline.llm.common import discard, local_path, materialize, replace_file, shared_dir

#: A template stands on so many different pages of a host, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 4, 0.01
#: Keys in one file of counts, 16 bytes each; files that a worker keeps mapped.
FILE_KEYS, MAPPED = 4_000_000, 1024
#: Bytes of pages that a task parses at a time.
SLICE_BYTES = 8 << 20

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe svg template object select button xmp noembed noframes canvas video audio".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br caption legend option".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements with their own text that hold the main text: kept for all that they recur.
_PROSE = _HEADINGS | frozenset("p blockquote pre dd dt figcaption".split())
#: Elements that are counted.
_COUNTED = frozenset("div section nav aside header footer form ul ol dl table figure details dialog menu address fieldset center".split()) | _PROSE
#: What a start tag closes, and where the search for it ends.
_CLOSES = {t: frozenset(["p"]) for t in _BLOCK - {"br", "html", "body", "head", "option", "tbody", "tfoot", "thead", "tr", "td", "th", "caption", "legend"}}
_CLOSES |= {"li": frozenset(["li", "p"]), "dd": frozenset(["dd", "dt", "p"]), "dt": frozenset(["dd", "dt", "p"]), "option": frozenset(["option"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "body": frozenset(["head", "p"])}
_CLOSES |= {h: frozenset(["p", *_HEADINGS]) for h in _HEADINGS}
_FENCES = {"li": frozenset(["ul", "ol", "menu", "dir"]), "dd": frozenset(["dl"]), "dt": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
_FENCE = frozenset(["article", "aside", "div", "section", "table", "td", "th", "caption", "button", "main", "nav", "header", "footer", "form", "blockquote", "ul", "ol"])
#: Elements that never belong to an article, and those that only don't outside of it.
_GONE = frozenset("nav aside form dialog menu fieldset search head".split())
_GONE_OUTSIDE = frozenset("header footer".split())
_GONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that tell what isn't part of an article.
_GONE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notification notifications alert popup modal overlay newsletter subscribe subscription signup login paywall nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side aside widget widgets toolbar share sharing social related recommended recommendations trending popular comment comments commentlist disqus respond replies reviews pagination pager tags skip".split()
)
_GONE_WORDS_OUTSIDE = frozenset("footer header banner masthead topbar".split())
_GONE_ARTICLES = frozenset("ad ads comment comments promo related sponsored teaser".split())
_ABOUT = ("no-", "has-", "with-", "without-", "not-")
_KEPT_TAGS = _HEADINGS | frozenset("html body article main".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|(\Z))""",
    re.S,
)
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in _RAW}
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SCHEME = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    """The host in an address, lower-cased; empty where there is none."""
    found = _SCHEME.match(url or "")
    return found[1].lower() if found else ""


def _said(attributes: str):
    """(class, id or role, its names, the words in them), lower-cased; names like no-ads or has-sidebar don't count."""
    for kind, *values in _NAMES.findall(attributes):
        names = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", next((v for v in values if v), "")).lower().split()
        names = [n for n in names if not n.startswith(_ABOUT)]
        yield kind.lower(), names, [w for n in names for w in re.split("[_-]+", n)]


class Page:
    """Elements of a page in the order in which they begin, and its texts.

    ``tags``, ``parents`` and ``told`` (what class, id and role say) go by element, the first
    of which is the page itself; ``pieces`` are (element, text), where a null text ends a block.
    """

    __slots__ = ("tags", "parents", "told", "pieces")

    def __init__(self, html: str):
        self.tags, self.parents, self.told, self.pieces = ["html"], [-1], [""], []
        tags, parents, told, pieces = self.tags, self.parents, self.told, self.pieces
        stack, at, search = [0], 0, _TOKEN.search
        while found := search(html, at):
            if found.start() > at:
                pieces.append((stack[-1], html[at : found.start()]))
            at, name = found.end(), found[2]
            if not name or found[4] is not None:
                continue
            name = name.lower()
            if found[1]:
                self._close(stack, name)
                continue
            for up in range(len(stack) - 1, 0, -1):
                own = tags[stack[up]]
                if own in _CLOSES.get(name, ()):
                    del stack[up:]
                    pieces.append((stack[-1], None))
                elif own in _FENCES.get(name, _FENCE):
                    break
            if name in _BLOCK:
                pieces.append((stack[-1], None))
            if name in _VOID or name == "html":
                continue
            if name in _RAW:
                # Without an end, a script reaches to the end of the page; other elements of this kind are passed over.
                end = _ENDS[name].search(html, at)
                at = end.end() if end else len(html) if name in ("script", "style") else at
                continue
            tags.append(name)
            parents.append(stack[-1])
            told.append(found[3] if found[3] and "=" in found[3] else "")
            if not found[3].endswith("/") or name in _BLOCK:
                stack.append(len(tags) - 1)
        if at < len(html):
            pieces.append((stack[-1], html[at:]))

    def _close(self, stack: list[int], name: str) -> None:
        """An end tag closes what it names and all that is open in it; an inline one doesn't reach out of its block."""
        for up in range(len(stack) - 1, 0, -1):
            own = self.tags[stack[up]]
            if own == name:
                if name in _BLOCK:
                    self.pieces.append((stack[up], None))
                del stack[up:]
                if name in _BLOCK:
                    self.pieces.append((stack[-1], None))
                return
            if own in _BLOCK and name not in _BLOCK:
                return

    def marked(self) -> list[bool]:
        """For each element whether its name, or that of one around it, tells that it isn't part of an article."""
        holders = {i for k, t in enumerate(self.tags) if t in ("article", "main") for i in self._up(self.parents[k])}
        gone, inside = [False], [False]
        for i in range(1, len(self.tags)):
            tag, up, told = self.tags[i], self.parents[i], self.told[i]
            inside.append(inside[up] or tag in ("article", "main"))
            own = gone[up] or (tag in _GONE and not (tag == "form" and i in holders)) or (tag in _GONE_OUTSIDE and not inside[up])
            # What holds an article isn't judged by its names, nor is a heading.
            if not own and told and i not in holders and tag not in _KEPT_TAGS:
                words = _GONE_WORDS if inside[up] else _GONE_WORDS | _GONE_WORDS_OUTSIDE
                own = any(not (_GONE_ROLES if kind == "role" else words).isdisjoint(said) for kind, _, said in _said(told))
            elif not own and told and tag == "article":
                own = any(not _GONE_ARTICLES.isdisjoint(names) for kind, names, _ in _said(told) if kind != "role")
            gone.append(own)
        return gone

    def within(self, chosen: set[int]) -> list[bool]:
        """For each element whether it is one of ``chosen`` or stands in one."""
        found = []
        for i, up in enumerate(self.parents):
            found.append(i in chosen or (up >= 0 and found[up]))
        return found

    def main(self, gone: list[bool]) -> set[int]:
        """The elements that hold the main text."""
        for kind in ("article", "main"):
            own = {i for i, t in enumerate(self.tags) if not gone[i] and (t == kind or (kind == "main" and 'role="main"' in self.told[i]))}
            if own:
                inner = self.within(own)
                return {i for i in own if not inner[self.parents[i]]}
        return {0}

    def prose(self, gone: list[bool], main: set[int]) -> list[bool]:
        """For each element whether it is a paragraph or heading of the main text."""
        held = main
        if main == {0}:
            sizes: dict[int, int] = {}
            for i, text in self.pieces:
                while i > 0 and self.tags[i] not in _PROSE:
                    i = self.parents[i]
                if text and i > 0 and not gone[i]:
                    up = self.parents[i]
                    sizes[up] = sizes.get(up, 0) + len(text)
            held = {max(sizes, key=lambda i: (sizes[i], -i))} if sizes else set()
        return [inner and tag in _PROSE for inner, tag in zip(self.within(held), self.tags, strict=True)]

    def subtrees(self, host: str, main: set[int], prose: list[bool]) -> dict[int, int]:
        """Key of (host, subtree) of each counted element with text that neither holds the main text nor is its prose."""
        import xxhash

        parts: list[list[str]] = [[] for _ in self.tags]
        keys, texts = {}, [False] * len(self.tags)
        last, around = {}, {i for m in main for i in self._up(m)}
        at = 0
        # A child's place among its parent's texts is where it begins.
        for i, text in self.pieces:
            while at < i:
                at += 1
                parts[self.parents[at]].append("")
                last[at] = len(parts[self.parents[at]]) - 1
            if text and not text.isspace():
                parts[i].append(" ".join(unescape(text).split()))
                texts[i] = True
        for i in range(len(self.tags) - 1, 0, -1):
            up, digest = self.parents[i], 0
            if texts[i]:
                texts[up] = True
                digest = xxhash.xxh64_intdigest("\1".join((self.tags[i], *parts[i])))
            if i in last:
                parts[up][last[i]] = f"\2{digest:x}"
            if not texts[i]:
                continue
            if self.tags[i] in _COUNTED and i not in around and not prose[i]:
                keys[i] = _key(host, f"{digest:x}")
        return keys

    def _up(self, i: int):
        while i >= 0:
            yield i
            i = self.parents[i]

    def text(self, main: set[int], gone: list[bool], deleted: set[int]) -> str:
        """Texts of the blocks of the main elements, without what is gone or deleted."""
        inside, out = self.within(main), self.within(deleted) if deleted else None
        kept: list[str] = []
        for i, text in self.pieces:
            if inside[i] and not gone[i] and not (out and out[i]):
                kept.append(" " if text is None else unescape(text))
        # A block's end is a space, and so is what joins blocks.
        return " ".join("".join(kept).split())


def _key(host: str, subtree: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{host}\0{subtree}") - (1 << 63)


class Parsed:
    """A page with all that both passes need: main elements, keys of subtrees, digest of the main text."""

    __slots__ = ("page", "gone", "main", "keys", "host")

    def __init__(self, url: str | None, html: str | None):
        self.page = Page(html or "")
        self.gone = self.page.marked()
        self.main = self.page.main(self.gone)
        host = host_of(url)
        self.host = _key(host, "")
        self.keys = self.page.subtrees(host, self.main, self.page.prose(self.gone, self.main))

    def digest(self) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(self.page.text(self.main, self.gone, set())) - (1 << 63)

    def text(self, count) -> tuple[str, int]:
        """The main text, and how many subtrees are deleted as templates; ``count`` gives the pages of a key."""
        least = max(LEAST_PAGES, LEAST_SHARE * count(self.host))
        deleted = {i for i, key in self.keys.items() if count(key) >= least}
        inner = self.page.within(deleted)
        return self.page.text(self.main, self.gone, deleted), sum(not inner[self.page.parents[i]] for i in deleted)


def _slices(batches, url: int, html: int):
    """(rows of a batch, their pages), so many at a time that their pages stay small."""
    from loamline.llm.common import text_slices

    for b in batches:
        for lo, texts in text_slices(b.column(html), SLICE_BYTES):
            rows = b.slice(lo, len(texts))
            yield rows, [Parsed(u, h) for u, h in zip(rows.column(url).to_pylist(), texts.to_pylist(), strict=True)]


def subtree_counts(pages: DataFrame) -> DataFrame:
    """(key, n) of each subtree of a host, and of the host itself: on how many pages of different main texts it stands.

    A task drops repeated rows of a slice before they are shuffled; a hot template is spread
    over as many keys as there are pages with it, then counted by partial sums.
    """

    def keyed(batches):
        import pyarrow as pa

        for _, parsed in _slices(batches, 0, 1):
            found = {(k, d) for p in parsed for d in [p.digest()] for k in (p.host, *p.keys.values())}
            keys, digests = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.int64())], names=["key", "digest"])

    rows = pages.select("url", "html").mapInArrow(keyed, "key long, digest long")
    return rows.distinct().groupBy("key").agg(F.count("*").alias("n"))


def write_counts(counts: DataFrame, folder: str) -> list[str]:
    """Files of sorted keys and their counts, one for each range of hashes; gives their paths, an empty one where a range has no key."""
    path, total = local_path(folder), counts.count()
    files = max(1, -(-total // FILE_KEYS))
    dealt = counts.withColumn("file", F.pmod("key", F.lit(files)).cast("int")).repartition(files, "file").sortWithinPartitions("file", "key")

    def write(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}
        names = []

        def flush():
            for number, parts in held.items():
                keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                name = os.path.join(path, f"counts-{number}")
                replace_file(name, [np.stack([keys, n]).astype("<i8").tobytes()])
                names.append((number, name))
            held.clear()

        for b in batches:
            numbers = b.column(2).to_numpy()
            for number in dict.fromkeys(numbers.tolist()):
                if held and number not in held:
                    flush()
                own = numbers == number
                held.setdefault(number, []).append((b.column(0).to_numpy()[own], b.column(1).to_numpy()[own]))
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in names], pa.int32()), pa.array([p for _, p in names], pa.string())], names=["file", "path"])

    found = {r.file: r.path for r in dealt.mapInArrow(write, "file int, path string").collect()}
    return [found.get(i, "") for i in range(files)]


class Counts:
    """Looks keys up in the mapped files; ``MAPPED`` of them stay open."""

    def __init__(self, paths: list[str]):
        self.paths, self.open = paths, OrderedDict()

    def _file(self, number: int):
        import numpy as np

        if number not in self.open:
            if len(self.open) >= MAPPED:
                self.open.popitem(last=False)
            self.open[number] = np.memmap(self.paths[number], "<i8", "r").reshape(2, -1)
        self.open.move_to_end(number)
        return self.open[number]

    def of(self, keys: set[int]) -> dict[int, int]:
        """Counts of those keys that have one."""
        import numpy as np

        found, wanted = {}, np.array(sorted(keys), "i8")
        numbers = wanted % len(self.paths)
        for number in np.unique(numbers).tolist():
            if self.paths[number]:
                own, (held, n) = wanted[numbers == number], self._file(number)
                at = np.minimum(np.searchsorted(held, own), held.size - 1)
                same = held[at] == own
                found.update(zip(own[same].tolist(), n[at[same]].tolist(), strict=True))
        return found


def extract(pages: DataFrame) -> DataFrame:
    """``pages(url, html, ...)`` with ``text``, ``n_chars`` and ``n_template``, the number of subtrees deleted as templates."""
    often = materialize(subtree_counts(pages).filter(F.col("n") >= LEAST_PAGES), "subtrees")
    paths = write_counts(often, shared_dir(pages.sparkSession, "templates"))
    discard(often)
    own = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", "n_template")]
    names = [f.name for f in own]
    out = StructType([*own, StructField("text", StringType()), StructField("n_chars", LongType()), StructField("n_template", LongType())])

    def run(batches):
        import pyarrow as pa

        counts = Counts(paths)
        for rows, parsed in _slices(batches, names.index("url"), names.index("html")):
            known = counts.of({k for p in parsed for k in (p.host, *p.keys.values())})
            found = [p.text(lambda k: known.get(k, 0)) for p in parsed]
            columns = [pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[f.name for f in out])

    return pages.select(*names).mapInArrow(run, out)


def op12_html_text(spark, sf_dir: str) -> DataFrame:
    """Query: main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "n_template")
