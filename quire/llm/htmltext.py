"""Main text of web pages: structure first, then a suffix array over each host's pages.

A page is read once into blocks of text. What the markup itself names as a menu, header,
footer, sidebar, notice, advert, form or comment is left out, and if the page marks its
article, the rest is too. The tokens of what is left are the page's stream. The streams of
*all* pages are laid end to end, host by host, and their suffixes sorted. Neighbours in that
order that share ``RUN`` tokens or more and stand on distinct pages show a repeated substring
(longer ones are chains of such neighbours). A repeat is boilerplate unless some page of the
host marks it as part of its article: copies of an article, and passages that articles share,
are content wherever they stand. Tokens that boilerplate covers are left out.

The array is distributed by the beginnings of suffixes, so no host is one task. Sorting every
suffix would move all texts several times; only those that can have a neighbour with ``RUN``
common tokens are sorted, by their tokens:

1. Each window of ``RUN`` tokens is named by the least of the digests of the shorter windows in
   it, cut to some bits. Equal windows have equal names, wherever they stand, and neighbours
   mostly share one, so these are few. Chunks of pages send the sorted names they hold, as gaps.
2. A name that only one page holds belongs to no repeat. Chunks learn which of theirs are others.
3. Suffixes at windows of such names are sorted by their tokens, in each chunk and then, dealt by
   host and first tokens, over all chunks. Common beginnings of neighbours decide. Names that
   met by chance, or on copies of one page, fall away here.
4. Chunks receive which windows are repeats and cut their texts.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import per_batch, shared_dir, slices, small_batches

#: Tokens that a repeated substring must have to be boilerplate.
RUN = 8
#: Parts of the table of parsed chunks; what is found out about a chunk moves to it.
PARTS = 64
#: Names or suffixes that one task sorts, about.
SORTED_AT_ONCE = 4 << 20

# Element names of the HTML standard, by what they mean here.
NEVER_TEXT = frozenset("head nav header footer aside form button select textarea dialog menu template iframe object audio video canvas svg math noscript datalist".split())
RAW_TEXT = "script|style|title|textarea|noscript|template|iframe|svg|xmp"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose end tag may be left away: the start tags that end them, and what they don't end them through.
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}), "dd": ({"dd", "dt"}, {"dl"})}
ENDED_BY |= {"th": ENDED_BY["td"], "dt": ENDED_BY["dd"]} | {k: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for k in ("thead", "tbody", "tfoot")}
ENDS_ITSELF = frozenset(ENDED_BY) | {"p"}
# Words in class, id or role that name what isn't the article.
NAMES_OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside "
    "comment comments disqus reply replies cookie cookies consent notice notices gdpr popup modal newsletter subscribe subscription share sharing social related recommended widget toolbar skip".split()
)
# Elements that may wrap a whole page, whatever they are called, and words of those that never do.
MAY_WRAP = frozenset("div section form table tbody tr td".split())
NEVER_AROUND = frozenset("comment comments disqus reply replies related recommended".split())

_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW_TEXT})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"""|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<more>[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+(?=>)|[^>]*+)>""",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|\baria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")

ARTICLE, MAIN, LOOSE = range(3)


def named(attributes: str) -> set[str]:
    """The words in class, id and role."""
    return {w for m in _NAMED.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}


def says_other(name: str, attributes: str) -> bool:
    """Whether an element, by name or attributes, is something else than main text."""
    if name in NEVER_TEXT:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    if name in ("html", "body"):
        return False
    return bool(named(attributes) & NAMES_OTHER) or bool(_HIDDEN.search(attributes))


class Open:
    """The elements that are open, innermost last: blocks, and what is left out."""

    def __init__(self):
        self.names: list[str] = []
        self.starts: list[int] = []
        self.count: dict[str, int] = {}

    def push(self, name: str, start: int) -> None:
        self.names.append(name)
        self.starts.append(start)
        self.count[name] = self.count.get(name, 0) + 1

    def cut(self, depth: int) -> None:
        while len(self.names) > depth:
            self.count[self.names.pop()] -= 1
            self.starts.pop()

    def ended(self, name: str) -> None:
        """An end tag ends the innermost element of its name and all within; without one it ends nothing."""
        if self.count.get(name):
            depth = len(self.names) - 1
            while self.names[depth] != name:
                depth -= 1
            self.cut(depth)

    def started(self, name: str) -> None:
        """A block's start tag ends an open paragraph; that of an item, row or cell the one before it."""
        if self.names and self.names[-1] == "p":
            self.cut(len(self.names) - 1)
        ends, within = ENDED_BY.get(name, ((), ()))
        if any(self.count.get(x) for x in ends):
            last = depth = len(self.names)
            while depth and self.names[depth - 1] not in within:
                depth -= 1
                if self.names[depth] in ends:
                    last = depth
            self.cut(last)


def blocks(page: str, wrappers: frozenset[int] = frozenset(), holders: set[int] | None = None) -> Iterator[tuple[int, str]]:
    """(zone, text) of each block in page order, without what the markup names as something else.

    An element that is left out reaches to its end tag, or where HTML ends it without one: a
    paragraph at the next block, an item, row or cell at the next one, any element at its
    parent's end. One that has no end tag and needs one is not an element to leave out. Headers
    inside an article are part of it. Elements that start at ``wrappers`` stay; ``holders``
    receives where elements start that are left out, or stand in one, and hold an article or ``main``.
    """
    lower, at, buffer = page.lower(), 0, []
    depth, inside, tree = -1, {"article": 0, "main": 0}, Open()  # depth: of the element that is left out
    no_end: set[str] = set()

    def zone() -> int:
        return ARTICLE if inside["article"] else MAIN if inside["main"] else LOOSE

    def flush() -> Iterator[tuple[int, str]]:
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip()
            buffer.clear()
            if text:
                yield zone(), text

    for m in _MARKUP.finditer(page):
        if depth < 0 and at < m.start():
            piece = page[at : m.start()]
            buffer.append(html.unescape(piece) if "&" in piece else piece)
        at = m.end()
        name, end = (m["name"] or "").lower(), bool(m["end"])
        if not name:
            continue
        block = name in BLOCKS
        if depth >= 0:
            left_out = tree.names[depth]
            if end:
                tree.ended(name)
            elif block:
                tree.started(name)
            if len(tree.names) > depth:  # still within
                if not end and (block or name == left_out) and name not in VOID:
                    tree.push(name, m.start())
                if not end and name in inside and holders is not None:
                    for start in reversed(tree.starts[depth:]):
                        if start in holders:
                            break
                        holders.add(start)
                continue
            depth = -1
            if end and name == left_out:
                continue
        elif end:
            tree.ended(name)
        elif block:
            tree.started(name)
        if block:
            yield from flush()
        elif name in ("br", "wbr", "img") and not end:
            buffer.append("" if name == "wbr" else " ")
        if end:
            if name in inside:
                inside[name] = max(0, inside[name] - 1)
            continue
        if name not in VOID and not (name == "header" and inside["article"]) and name not in no_end and m.start() not in wrappers and says_other(name, m["more"]):
            if name in ENDS_ITSELF or lower.find(f"</{name}", at) >= 0:
                depth = len(tree.names)
                tree.push(name, m.start())
                if holders is not None and name in inside:
                    holders.add(m.start())
                continue
            no_end.add(name)
        if block and name not in VOID:
            tree.push(name, m.start())
        if name in inside:
            inside[name] += 1
    if depth < 0 and at < len(page):
        piece = page[at:]
        buffer.append(html.unescape(piece) if "&" in piece else piece)
    yield from flush()


def wrapping(page: str, holders: set[int]) -> frozenset[int]:
    """Those of ``holders`` that can be a page's layout: not comments and the like."""
    found = set()
    for start in holders:
        m = _MARKUP.match(page, start)
        if m["name"].lower() in MAY_WRAP | {"article", "main"} and not named(m["more"]) & NEVER_AROUND:
            found.add(start)
    return frozenset(found)


def structured(page: str | None) -> tuple[bool, list[str]]:
    """Whether the markup settles the main text, and the blocks: the article's, else those of
    ``main``, else all that is left, which is not settled. Where every article and ``main``
    stands in an element that is left out, the names of elements around them are not heeded."""
    page = page or ""
    holders: set[int] = set()
    found = list(blocks(page, holders=holders))
    if holders and all(z == LOOSE for z, _ in found) and (wrappers := wrapping(page, holders)):
        found = list(blocks(page, wrappers))
    best = min((z for z, _ in found), default=ARTICLE)
    return best != LOOSE, [t for z, t in found if z == best]


def host_of(url: str | None) -> str:
    """What stands between :// and the path."""
    return re.split(r"[/?#]", (url or "").partition("://")[2], maxsplit=1)[0].lower()


_ODD = np.uint64(0x9E3779B97F4A7C15)


def hashed(words: pa.StringArray) -> np.ndarray:
    """64 bits for each word, from eight of its bytes at a time; from another digest for words of more than 64."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32, len(words) + 1, 4 * words.offset).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.concatenate([np.frombuffer(data or b"", np.uint8)[: ends[-1]], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    at, left = ends[:-1], np.diff(ends)
    found = left.astype(np.uint64)
    short = which = np.flatnonzero(left <= 64)
    for start in range(0, 64, 8):
        which = which[left[which] > start]
        if not len(which):
            break
        unused = 8 * np.maximum(0, 8 + start - left[which]).astype(np.uint64)
        h = found[which]
        found[which] = (h ^ (h >> np.uint64(32))) * _ODD + (eight[at[which] + start] << unused)
    h = (found ^ (found >> np.uint64(32))) * _ODD
    found = h ^ (h >> np.uint64(29))
    if len(short) < len(words):
        for i in np.flatnonzero(left > 64).tolist():
            found[i] = int.from_bytes(blake2b(data[at[i] : at[i] + left[i]].tobytes(), digest_size=8).digest(), "little")
    return found


def digests(columns: list[np.ndarray], first: np.ndarray | np.uint64) -> np.ndarray:
    """A digest of ``first`` and each row of the columns."""
    found = np.zeros(len(columns[0]), np.uint64) + first
    for column in columns:
        found = (found ^ (found >> np.uint64(32))) * _ODD + column
    found = (found ^ (found >> np.uint64(32))) * _ODD
    return found ^ (found >> np.uint64(29))


def of_windows(stream: np.ndarray, n: int, host: np.uint64) -> np.ndarray:
    """The digest of every ``n`` tokens in a row, and the host."""
    windows = max(0, len(stream) - n + 1)
    return digests([stream[j : j + windows] for j in range(n)], host)


def names(stream: np.ndarray, run: int, host: np.uint64, bits: int) -> np.ndarray:
    """The name of each window of ``run`` tokens: the least digest of the windows in it that are
    up to two tokens shorter, mixed anew, as least ones are small."""
    apart = min(3, run)
    short = of_windows(stream, run - apart + 1, host)
    windows = max(0, len(stream) - run + 1)
    least = short[:windows]
    for j in range(1, apart):
        least = np.minimum(least, short[j : j + windows])
    return (least * _ODD) >> np.uint64(64 - bits)


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed gaps."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return pa.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Numbers of 32 bits with their first bytes together, and so on: small ones compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def holds(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among ``wanted``, which is sorted."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def merged(ns: list[int] | None, lists: list[bytes] | None) -> np.ndarray:
    """The numbers of several packed lists, sorted."""
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpacked(x, n) for n, x in zip(ns or (), lists or (), strict=True))]))


def as_chunk(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def of_chunk(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def streams(chunk: pa.Table) -> Iterator[tuple[np.ndarray, np.uint64, bool]]:
    """(tokens' hashes, host's hash, whether the markup settles the text) of each page."""
    for part in chunk.to_batches():
        blocks = part.column("blocks")
        tokens = pc.split_pattern(pc.binary_join(blocks, " "), " ")
        known = hashed(tokens.flatten())
        hosts = hashed(pa.array([host_of(url) for url in part.column("url").to_pylist()], pa.string()))
        lengths = np.where(pc.list_value_length(blocks).to_numpy() > 0, pc.list_value_length(tokens).to_numpy(), 0)
        starts = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
        for host, settled, at, n in zip(hosts, part.column("settled").to_pylist(), starts[:-1].tolist(), lengths.tolist(), strict=True):
            yield known[at : at + n], host, settled


def name_of(stream: np.ndarray) -> int:
    """Pages of one host with equal streams count as one page, so copies of a page do not erase it."""
    return int.from_bytes(blake2b(stream.tobytes(), digest_size=8).digest(), "little")


def sent_names(chunk: pa.Table, run: int, bits: int) -> np.ndarray:
    """The names on a chunk's pages, sorted; those on two distinct pages or more stand twice."""
    seen, found = set(), [np.zeros(0, np.uint64)]
    for stream, host, _ in streams(chunk):
        page = (name_of(stream), host)
        if len(stream) >= run and page not in seen:
            seen.add(page)
            found.append(np.unique(names(stream, run, host, bits)))
    values, counts = np.unique(np.concatenate(found), return_counts=True)
    return np.repeat(values, np.minimum(counts, 2))


def suffix_order(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes given by rows, and where one starts that has not all in common with
    the one before it: the length of the common beginning is less than a row."""
    order = np.lexsort(suffixes.T[::-1])
    rows = suffixes[order]
    common = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1).sum(axis=1)
    return order, np.concatenate([np.zeros(min(1, len(rows)), np.intp), 1 + np.flatnonzero(common < rows.shape[1])])


def sorted_suffixes(chunk: pa.Table, run: int, bits: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct suffixes of a chunk at windows whose names are ``wanted``, in order: host (two
    numbers) and ``run`` tokens, each known by 32 bits of its hash; the least and greatest page; whether a page's markup holds it."""
    rows, pages, marked = [np.zeros((0, run + 2), np.uint32)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for stream, host, settled in streams(chunk):
        if len(stream) < run:
            continue
        at = np.flatnonzero(holds(names(stream, run, host, bits), wanted))
        if len(at):
            tokens = (stream >> np.uint64(32)).astype(np.uint32)
            hosts = np.array([[host >> np.uint64(32), host & np.uint64(0xFFFFFFFF)]], np.uint32)
            rows.append(np.hstack([np.broadcast_to(hosts, (len(at), 2)), tokens[at[:, None] + np.arange(run)]]))
            pages.append(np.full(len(at), name_of(stream), np.uint64))
            marked.append(np.full(len(at), settled))
    suffixes, page, mark = np.concatenate(rows), np.concatenate(pages), np.concatenate(marked)
    if not len(page):
        return suffixes, page, page, mark
    order, starts = suffix_order(suffixes)
    page, mark = page[order], mark[order]
    return suffixes[order][starts], np.minimum.reduceat(page, starts), np.maximum.reduceat(page, starts), np.logical_or.reduceat(mark, starts)


def suffix_digests(suffixes: np.ndarray) -> np.ndarray:
    """As ``of_windows`` on the upper halves of the tokens' hashes."""
    columns = suffixes.T.astype(np.uint64)
    return digests(list(columns[2:]), (columns[0] << np.uint64(32)) | columns[1])


def cut(chunk: pa.Table, run: int, repeats: np.ndarray) -> tuple[list[str], list[int]]:
    """The texts of a chunk's pages without boilerplate, and how many of their tokens repeats cover.
    The last bit of a repeat says that a page marks it as its article's."""
    one, texts, counts = np.uint64(1), [], []
    for (stream, host, _), found in zip(streams(chunk), chunk["blocks"].to_pylist(), strict=True):
        windows = of_windows(stream >> np.uint64(32), run, host) & ~one if len(stream) >= run else np.zeros(0, np.uint64)

        def covered(which, n=len(stream)):
            at = np.flatnonzero(which)
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + run, -1)
            return np.cumsum(edges[:-1]) > 0

        unmarked = holds(windows, repeats)
        counts.append(int(covered(unmarked | holds(windows | one, repeats)).sum()))
        gone = covered(unmarked)
        if gone.any():
            place, kept = 0, []
            for block in found:
                words = block.split(" ")
                unique = [w for w, out in zip(words, gone[place : place + len(words)].tolist(), strict=True) if not out]
                place += len(words)
                if unique:
                    kept.append(" ".join(unique))
            found = kept
        texts.append("\n\n".join(found))
    return texts, counts


def repeated(chunks: DataFrame, run: int, bits: int, buckets: int) -> DataFrame:
    """(chunk, ns, lists): for each chunk the digests of the windows on its pages that distinct
    pages of a host share, as packed lists."""
    back = "chunk long, n int, list binary"

    def send_names(batches):
        edges = [(b << bits) // buckets for b in range(1, buckets)]
        for batch in batches:
            for chunk, pages in zip(batch.column("chunk").to_pylist(), batch.column("pages"), strict=True):
                parts = np.split(found := sent_names(of_chunk(pages.as_buffer()), run, bits), np.searchsorted(found, np.array(edges, np.uint64)))
                rows = [(b, chunk, len(p), packed(p)) for b, p in enumerate(parts) if len(p)]
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "chunk", "n", "list"), r, strict=True)) for r in rows], pa.schema(named_schema))

    named_schema = [("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("list", pa.binary())]

    def shared_names(table):
        lists = [unpacked(x, n) for n, x in zip(table["n"].to_pylist(), table["list"].to_pylist(), strict=True)]
        every = np.sort(np.concatenate(lists))
        shared = every[1:][every[1:] == every[:-1]]
        del every
        out = []
        for chunk, values in zip(table["chunk"].to_pylist(), lists, strict=True):
            values = np.unique(values[holds(values, shared)])
            if len(values):
                out.append({"chunk": chunk, "n": len(values), "list": packed(values)})
        return pa.Table.from_pylist(out, pa.schema(named_schema[1:]))

    def send_suffixes(batches):
        for batch in batches:
            for chunk, pages, ns, lists in zip(batch.column("chunk").to_pylist(), batch.column("pages"), batch.column("ns").to_pylist(), batch.column("lists").to_pylist(), strict=True):
                suffixes, least, greatest, marked = sorted_suffixes(of_chunk(pages.as_buffer()), run, bits, merged(ns, lists))
                if not len(least):
                    continue
                ids, place = np.unique(least, return_inverse=True)
                flags = (least != greatest).astype(np.uint8) | marked.astype(np.uint8) << 1
                first = digests([suffixes[:, j].astype(np.uint64) for j in range(min(6, run + 2))], np.uint64(0))
                bucket = first % np.uint64(buckets)
                rows = []
                for b in np.unique(bucket).tolist():
                    at = np.flatnonzero(bucket == b)
                    used, own = np.unique(place[at], return_inverse=True)
                    tokens, which = np.unique(suffixes[at].T.ravel(), return_inverse=True)
                    data = planes(np.diff(tokens, prepend=np.uint32(0))) + planes(which) + planes(own) + flags[at].tobytes() + ids[used].tobytes()
                    rows.append({"bucket": b, "chunk": chunk, "n": len(at), "pages": len(used), "tokens": len(tokens), "list": pa.compress(data, codec="zstd", asbytes=True)})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([*named_schema[:3], ("pages", pa.int32()), ("tokens", pa.int32()), named_schema[3]]))

    def shared_suffixes(table):
        rows, pages, flags = [], [], []
        for n, used, known, data in zip(*(table[c].to_pylist() for c in ("n", "pages", "tokens", "list")), strict=True):
            ends = np.cumsum([4 * known, 4 * n * (run + 2), 4 * n, n, 8 * used]).tolist()
            raw = pa.decompress(data, decompressed_size=ends[-1], codec="zstd", asbytes=True)
            tokens = np.cumsum(of_planes(raw[: ends[0]]), dtype=np.uint32)
            rows.append(tokens[of_planes(raw[ends[0] : ends[1]])].reshape(run + 2, n).T)
            flags.append(np.frombuffer(raw[ends[2] : ends[3]], np.uint8))
            pages.append(np.frombuffer(raw[ends[3] :], np.uint64)[of_planes(raw[ends[1] : ends[2]])])
        suffixes, page, flag = np.concatenate(rows), np.concatenate(pages), np.concatenate(flags)
        source = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        del rows, pages, flags
        order, starts = suffix_order(suffixes)
        group = np.empty(len(order), np.intp)
        group[order] = np.cumsum(np.bincount(starts, minlength=len(order))) - 1
        page, any_flag = page[order], np.bitwise_or.reduceat(flag[order], starts)
        distinct = (np.minimum.reduceat(page, starts) != np.maximum.reduceat(page, starts)) | (any_flag & 1 > 0)
        values = suffix_digests(suffixes[order[starts]]) & ~np.uint64(1) | (any_flag >> 1).astype(np.uint64)
        out = []
        bounds = np.searchsorted(source, np.arange(table.num_rows + 1))
        for i, chunk in enumerate(table["chunk"].to_pylist()):
            own = group[bounds[i] : bounds[i + 1]]
            own = np.unique(values[own[distinct[own]]])
            if len(own):
                out.append({"chunk": chunk, "n": len(own), "list": packed(own)})
        return pa.Table.from_pylist(out, pa.schema(named_schema[1:]))

    def per_chunk(df):
        return df.repartition(PARTS, "chunk").groupBy("chunk").agg(F.collect_list("n").alias("ns"), F.collect_list("list").alias("lists"))

    named = per_batch(chunks, send_names, "bucket int, chunk long, n int, list binary")
    shared = named.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(shared_names, back)
    with_names = chunks.join(per_chunk(shared).hint("shuffle_hash"), "chunk")
    suffixes = per_batch(with_names, send_suffixes, "bucket int, chunk long, n int, pages int, tokens int, list binary")
    return per_chunk(suffixes.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(shared_suffixes, back))


def main_text(pages: DataFrame, run: int = RUN, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page, from its whole HTML.

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined in page order by two line ends. Rows and ids may repeat and ids be null; null or
    empty HTML has an empty text; a null URL belongs to the host ""; other columns are not
    read; empty tables are fine. Every page goes through the suffix array of its host. The parsed
    pages are written once, in chunks of some MB, and don't move; what moves are names of
    windows and the suffixes that can be repeats.

    Returns (id, url, text, n_chars long, n_repeated long: tokens of the page's blocks that
    stand on another page of the host in a run of ``run`` or more, kept or not).
    """

    def read(batches):
        for b in slices(batches, "html"):
            found = [structured(page) for page in b.column("html").to_pylist()]
            rows = pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("url"), pa.array([s for s, _ in found], pa.bool_()), pa.array([x for _, x in found], pa.list_(pa.string()))],
                ["id", "url", "settled", "blocks"],
            )
            tokens = sum(x.count(" ") + 1 for _, blocks in found for x in blocks)
            chunk = uuid.uuid4().int >> 65
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([tokens], pa.int64()), pa.array([as_chunk(rows)], pa.binary())], ["chunk", "tokens", "pages"])

    def write(batches):
        for b in batches:
            for data, ns, lists in zip(b.column("pages"), b.column("ns").to_pylist(), b.column("lists").to_pylist(), strict=True):
                chunk = of_chunk(data.as_buffer())
                texts, counts = cut(chunk, run, merged(ns, lists))
                ids, urls = (chunk[c].combine_chunks() for c in ("id", "url"))
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["id", "url", "text", "n_repeated"])

    spark = pages.sparkSession
    small_batches(spark)
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    name = f"quire_chunks_{uuid.uuid4().hex}"
    parsed = per_batch(source, read, "chunk long, tokens long, pages binary")
    parsed.write.bucketBy(PARTS, "chunk").option("path", f"{shared_dir(spark)}/{name}").option("compression", "none").saveAsTable(name)
    chunks = spark.table(name)
    total = chunks.agg(F.sum("tokens")).first()[0] or 0
    bits = min(60, max(24, total.bit_length() + 7))  # a window that is no repeat shares its name with another in 1 of 128 cases
    found = repeated(chunks.select("chunk", "pages"), run, bits, max(16, total // SORTED_AT_ONCE))
    texts = per_batch(chunks.select("chunk", "pages").join(found.hint("shuffle_hash"), "chunk", "left"), write, "id long, url string, text string, n_repeated long")
    return texts.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
