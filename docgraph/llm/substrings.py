"""Substring dedup by longest-previous-factor arrays.

A byte goes if a string of `width` bytes around it also starts in a document with a smaller doc_id. Two facts make that a
job of bounded tasks:

* Every window of `width` bytes has a least `K`-byte gram under a hash. Equal windows have it at the same place, so windows
  need comparing only among those that own the same such gram, their anchor. About 6 % of positions are anchors.
* Documents are dealt into blocks of a bounded size by doc_id's hash. Whatever is common within a block is reduced to one
  entry before blocks meet, so a string that a third of all documents share costs one entry a block.

Four steps: blocks exchange anchor hashes to find those that several documents have; of these, blocks send the bytes around
(the union of the windows an anchor owns); per hash bucket the suffixes that begin a window are put in order, with the common
prefixes of neighbours, and each one's longest previous factor is read off the previous and the next suffix of a smaller
document in that order; blocks apply the answers to their texts. Hashes only choose what to compare: contexts and windows
that pass as equal, within a block and between blocks, have been compared by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import utf8

#: Length of an anchor's gram.
K = 18
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_TOP = np.uint32(0xFFFFFFFF)
_CHUNK = 1 << 20
_SIDE = "block int, kind int, bucket int, a binary, b binary"


def _grams(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every K-byte gram."""
    n = len(buf) - K + 1
    with np.errstate(over="ignore"):
        one = buf.astype(np.uint64) + np.uint64(1)
        two = one[:-1] * _A + one[1:]
        four = two[:-2] * _B + two[2:]
        eight = four[:-4] * _C + four[4:]
        eight ^= eight >> np.uint64(31)
        sixteen = eight[:-8] * _A + eight[8:]
        h = (sixteen[:n] ^ (sixteen[:n] >> np.uint64(29))) * _B + two[16 : 16 + n]
        h = (h ^ (h >> np.uint64(32))) * _C
        h ^= h >> np.uint64(29)
        return h * _A


def _running(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w neighbours."""
    s = 1
    while 2 * s <= w:
        x = f(x[:-s], x[s:])
        s *= 2
    return f(x[: len(x) - (w - s)], x[w - s :]) if s < w else x


def anchors(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some window of their text (and some more, at texts' edges)."""
    w = width - K + 1
    places, hashes = [], []
    cross = np.zeros(len(buf) + 1, bool)
    for back in range(1, K):  # grams that reach into the next text
        at = off[1:-1] - back
        cross[at[at >= 0]] = True
    for lo in range(0, len(buf), _CHUNK):
        a, b = max(0, lo - 2 * width), min(len(buf), lo + _CHUNK + 2 * width)
        if b - a < K:
            continue
        h = _grams(buf[a:b])
        top = (h >> np.uint64(32)).astype(np.uint32)
        top[cross[a : a + len(top)]] = _TOP
        pad = np.full(w - 1, _TOP, np.uint32)
        least = _running(np.r_[pad, top, pad], w, np.minimum)
        at = np.flatnonzero((_running(least, w, np.maximum) == top) & (top != _TOP))
        at = at[(at + a >= lo) & (at + a < lo + _CHUNK)]
        places.append(at + a)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def _owned(places: np.ndarray, hashes: np.ndarray, text: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the bytes of the windows each anchor owns: those in its text where no gram is less, or as small and before."""
    w, n = width - K + 1, len(places)
    top = (hashes >> np.uint64(32)).astype(np.uint32)
    lo, hi = np.maximum(places - (w - 1), off[text]), np.minimum(places, off[text + 1] - width)  # first and last window
    live = np.arange(n)
    for d in range(1, w):
        live = live[live >= d]
        live = live[places[live] - places[live - d] < w]
        if not len(live):
            break
        less = (top[live - d] <= top[live]) & (text[live - d] == text[live])
        lo[live[less]] = np.maximum(lo[live[less]], places[live[less] - d] + 1)
        live = live[~less]
    live = np.arange(n)
    for d in range(1, w):
        live = live[live < n - d]
        live = live[places[live + d] - places[live] < w]
        if not len(live):
            break
        less = (top[live + d] < top[live]) & (text[live + d] == text[live])
        hi[live[less]] = np.minimum(hi[live[less]], places[live[less] + d] - w)
        live = live[~less]
    return lo, hi + width


class Block:
    """A block's texts in doc_id order, with their anchors."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by([("doc_id", "ascending"), ("part", "ascending")])
        self.table, self.width = table, width
        self.ids = table.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        self.buf, self.off = utf8(table.column("text"))
        self.at, self.h = anchors(self.buf, self.off, width)
        self.text = np.searchsorted(self.off, self.at, side="right") - 1
        lo, hi = _owned(self.at, self.h, self.text, self.off, width)
        use = hi - lo >= width
        self.at, self.h, self.text, self.lo, self.hi = self.at[use], self.h[use], self.text[use], lo[use], hi[use]

    def contexts(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The owned bytes of the picked anchors in rows of equal width, placed by anchor and zero outside; a hash of each."""
        span = 2 * self.width - K
        rows, key = np.zeros((len(pick), span + 2), np.uint8), np.zeros(len(pick), np.uint64)
        weights = np.cumprod(np.full(span + 2, _B, np.uint64), dtype=np.uint64)
        reach = np.arange(-(self.width - K), self.width)[None, :]
        for i in range(0, len(pick), 1 << 14):
            x = pick[i : i + (1 << 14)]
            where = self.at[x][:, None] + reach
            inside = (where >= self.lo[x][:, None]) & (where < self.hi[x][:, None])
            part = rows[i : i + (1 << 14)]
            part[:, :span] = np.where(inside, self.buf[np.clip(where, 0, len(self.buf) - 1)], 0)
            part[:, span], part[:, span + 1] = self.at[x] - self.lo[x], self.hi[x] - self.at[x]
            with np.errstate(over="ignore"):
                key[i : i + (1 << 14)] = ((part.astype(np.uint64) + np.uint64(1)) * weights).sum(1, dtype=np.uint64)
        return rows, key ^ (key >> np.uint64(32)) ^ self.h[pick]


def _alike(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First member and number of each member's class of equal rows: `key` sorts them, their bytes decide."""
    key = key.copy()
    while True:
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        odd = np.zeros(len(key), bool)
        for i in range(0, len(key), 1 << 16):
            odd[i : i + (1 << 16)] = (rows[i : i + (1 << 16)] != rows[first[inverse[i : i + (1 << 16)]]]).any(1)
        if not odd.any():
            return first, inverse
        key[odd] += np.uint64(1)  # equal hashes of different bytes: these go on under another


def _windows(rows: np.ndarray, x: np.ndarray, o: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The window at place o of each context x, and a hash of its bytes."""
    window = rows[x, o : o + width]
    g = np.zeros(len(x), np.uint64)
    weights = np.cumprod(np.full(width, _A, np.uint64), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 1 << 14):
            g[i : i + (1 << 14)] = ((window[i : i + (1 << 14)].astype(np.uint64) + np.uint64(1)) * weights).sum(1, dtype=np.uint64)
    return window, g ^ (g >> np.uint64(31))


def _side(rows: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["block", "kind", "bucket", "a", "b"])


def _split(bucket: np.ndarray, order: np.ndarray):
    """(bucket, members of it) of an order by bucket."""
    if not len(order):
        return
    b = bucket[order]
    edge = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(b[i]), order[i:j]


def _several(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each key has more than one owner; owners come in ascending order."""
    if not len(keys):
        return np.zeros(0, bool)
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    last = np.zeros(len(first), np.int64)
    np.maximum.at(last, inverse, np.arange(len(keys)))
    return (owner[first] != owner[last])[inverse]


def _smaller_before(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place of an order, its common prefix with the nearest place before it of a smaller document; 0 if there is none.

    lcp: common prefix of each place and the one before. Places skip along what those that they pass have skipped already.
    """
    at, common = np.arange(len(doc)) - 1, lcp.copy()
    live = np.flatnonzero(common > 0)
    live = live[doc[at[live]] >= doc[live]]
    while len(live):
        over = at[live]
        common[live], at[live] = np.minimum(common[live], common[over]), at[over]
        live = live[common[live] > 0]
        live = live[doc[at[live]] >= doc[live]]
    return common


def longest_previous(suffix: np.ndarray, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order and, in that order, each suffix's longest previous factor: the most bytes it has in common with a
    suffix of a smaller document of its group.

    suffix: rows of equal width, each a suffix cut to it. They are put in order by group and bytes; lcp are the common
    prefixes of neighbours. Of all suffixes of smaller documents the nearest before and the nearest after have the longest.
    """
    width = suffix.shape[1]
    order = np.argsort(np.ascontiguousarray(suffix).view(f"S{width}").ravel(), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    s, g, d = suffix[order], group[order], doc[order]
    differs = s[1:] != s[:-1]
    lcp = np.where(g[1:] != g[:-1], 0, np.where(differs.any(1), differs.argmax(1), width))
    before = _smaller_before(d, np.r_[0, lcp])
    after = _smaller_before(d[::-1], np.r_[0, lcp[::-1]])[::-1]
    return order, np.maximum(before, after)


def _previous(rows: np.ndarray, doc: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Per context, a bit for each window that also begins in a context of the same group from a smaller document: where the
    longest previous factor of the window's suffix is `width`."""
    span = rows.shape[1] - 2
    mid = width - K
    left, right = rows[:, span].astype(np.int64), rows[:, span + 1].astype(np.int64)
    count = left + right - width + 1
    owner = np.repeat(np.arange(len(rows)), count)
    begin = mid - left[owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    suffix = np.lib.stride_tricks.sliding_window_view(rows[:, :span], width, axis=1)[owner, begin]
    order, factor = longest_previous(suffix, doc[owner], group[owner])
    again = order[factor == width]
    bits = np.zeros(len(rows), np.uint64)
    np.bitwise_or.at(bits, owner[again], np.uint64(1) << begin[again].astype(np.uint64))
    return bits


def _dealt(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's bucket and 32 bits more of it: what blocks exchange to choose what to look at."""
    x = h >> np.uint64(8)
    return (x % np.uint64(buckets)).astype(np.int64), ((x // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _known(h: np.ndarray, table: pa.Table, column: str, buckets: int) -> np.ndarray:
    """Which hashes are in the table's answers of kind 1."""
    bucket, rest = _dealt(h, buckets)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = np.zeros(len(h), bool)
    for kind, b, x in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column(column).to_pylist()):
        if kind == 1 and x:
            i = order[edge[b] : edge[b + 1]]
            out[i] = np.isin(rest[i], np.frombuffer(x, np.uint32))
    return out


def _hash_step(width: int, buckets: int):
    def run(key, table):
        block = Block(table, width)
        h = np.unique(block.h)
        bucket, rest = _dealt(h, buckets)
        return _side([(key[0].as_py(), 0, b, np.unique(rest[i]).tobytes(), None) for b, i in _split(bucket, np.argsort(bucket, kind="stable"))])

    return run


def _meet_step(hot: int):
    def run(key, table):
        blocks, parts = table.column("block").to_pylist(), [np.frombuffer(x, np.uint32) for x in table.column("a").to_pylist()]
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        out = []
        for block, part in zip(blocks, parts):
            many = n[np.searchsorted(h, part)]
            if (many > 1).any():
                out.append((block, 1, key[0].as_py(), part[many > 1].tobytes(), part[many > hot].tobytes()))
        return _side(out)

    return run


def _context_step(width: int, buckets: int):
    def run(key, left, right):
        if not left.num_rows:
            return _side([])
        block = Block(left, width)
        pick = np.flatnonzero(_known(block.h, right, "a", buckets) | _several(block.h, block.ids[block.text]))
        hot = _known(block.h[pick], right, "b", buckets)
        out = []
        rows, ckey = block.contexts(pick)
        first, _ = _alike(ckey, rows)
        first.sort()
        cold = first[~hot[first]]
        bucket = ((block.h[pick[cold]] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
        row = lambda i, b, g, d, rows: (key[0].as_py(), 2, b, np.concatenate([i.astype("<i8"), g.view("<i8"), d.astype("<i8")]).tobytes(), zstandard.compress(rows.tobytes(), 1))
        for b, i in _split(bucket, np.argsort(bucket, kind="stable")):
            x = cold[i]
            out.append(row(x, b, block.h[pick[x]], block.ids[block.text[pick[x]]], rows[x]))
        warm = first[hot[first]]
        if len(warm):
            # an anchor of very many contexts is dealt out by its windows' own bytes instead
            span, mid = rows.shape[1] - 2, width - K
            for o in range(mid + 1):
                l, r = rows[warm, span].astype(np.int64), rows[warm, span + 1].astype(np.int64)
                x = warm[(o >= mid - l) & (o + width <= mid + r)]
                if not len(x):
                    continue
                window, g = _windows(rows, x, o, width)
                one, _ = _alike(g, window)  # of equal windows of a block, the smallest document's
                lone = np.zeros((len(one), rows.shape[1]), np.uint8)
                lone[:, o : o + width] = window[one]
                lone[:, span], lone[:, span + 1] = mid - o, width - (mid - o)
                bucket = ((g[one] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
                for b, i in _split(bucket, np.argsort(bucket, kind="stable")):
                    out.append(row(x[one[i]], b, g[one[i]], block.ids[block.text[pick[x[one[i]]]]], lone[i]))
        return _side(out)

    return run


def _suffix_step(width: int):
    def run(key, table):
        span = 2 * width - K + 2
        block, index, group, doc, rows = [], [], [], [], []
        for b, a, r in zip(table.column("block").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist()):
            i, g, d = np.frombuffer(a, "<i8").reshape(3, -1)
            block.append(np.full(len(i), b))
            index.append(i), group.append(g.view(np.uint64)), doc.append(d), rows.append(np.frombuffer(zstandard.decompress(r), np.uint8).reshape(-1, span))
        block, index, group, doc, rows = map(np.concatenate, (block, index, group, doc, rows))
        order = np.lexsort((doc, group))
        edge = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1], True])
        bits = np.zeros(len(doc), np.uint64)
        lone = np.repeat(np.diff(edge) == 1, np.diff(edge))
        keep, sizes = order[~lone], np.diff(edge)[np.diff(edge) > 1]
        i = 0
        ends = np.cumsum(sizes)
        while i < len(keep):  # some thousand contexts at a time, whole groups each
            j = int(ends[max(np.searchsorted(ends, i + 8000, side="right") - 1, np.searchsorted(ends, i, side="right"))])
            x = keep[i:j]
            bits[x] = _previous(rows[x], doc[x], group[x], width)
            i = j
        hit = np.flatnonzero(bits)
        hit = hit[np.argsort(block[hit], kind="stable")]
        return _side([(b, 3, key[0].as_py(), index[i].astype("<i8").tobytes(), bits[i].tobytes()) for b, i in _split(block, hit)])

    return run


def _apply_step(width: int, buckets: int):
    def run(key, left, right):
        names = ["doc_id", "part", "n_bytes", "n_removed", "spans", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        block = Block(left, width)
        got = right.filter(pa.compute.equal(right.column("kind"), 3))
        pick = np.flatnonzero(_known(block.h, right, "a", buckets) | _several(block.h, block.ids[block.text]))
        bits = np.zeros(len(pick), np.uint64)
        for a, b in zip(got.column("a").to_pylist(), got.column("b").to_pylist()):
            np.bitwise_or.at(bits, np.frombuffer(a, "<i8"), np.frombuffer(b, np.uint64))
        mid = width - K
        starts = np.zeros(len(block.buf) + 1, np.int32)
        if len(pick):
            rows, ckey = block.contexts(pick)
            first, inverse = _alike(ckey, rows)
            ids = block.ids[block.text[pick]]
            lo, hi, at = block.lo[pick], block.hi[pick], block.at[pick]
            later = ids > ids[first][inverse]
            np.add.at(starts, lo[later], 1)
            np.add.at(starts, hi[later] - width + 1, -1)
            # a hot anchor's windows were sent once per block, by whichever context has them first
            span = rows.shape[1] - 2
            same = np.flatnonzero(~later)
            mine = bits[first][inverse]
            for o in range(mid + 1):
                x = same[(mine[same] >> np.uint64(o)) & np.uint64(1) == 1]
                np.add.at(starts, at[x] - mid + o, 1)
                np.add.at(starts, at[x] - mid + o + 1, -1)
            warm = np.flatnonzero(_known(block.h[pick], right, "b", buckets))
            for o in range(mid + 1) if len(warm) else ():
                l, r = rows[warm, span].astype(np.int64), rows[warm, span + 1].astype(np.int64)
                x = warm[(o >= mid - l) & (o + width <= mid + r)]
                if not len(x):
                    continue
                window, g = _windows(rows, x, o, width)
                one, back = _alike(g, window)
                sent = (bits[x] >> np.uint64(o)) & np.uint64(1) == 1
                answered = np.zeros(len(one), bool)
                np.logical_or.at(answered, back, sent)
                yes = x[(ids[x] > ids[x[one]][back]) | answered[back]]
                np.add.at(starts, at[yes] - mid + o, 1)
                np.add.at(starts, at[yes] - mid + o + 1, -1)
        start = np.cumsum(starts[:-1]) > 0
        cover = np.zeros(len(block.buf) + width + 1, np.int32)
        at = np.flatnonzero(start)
        cover[: len(start)] += start
        cover[width : width + len(start)] -= start
        gone = np.cumsum(cover[: len(block.buf)]) > 0
        spans, kept, removed = [], [], []
        for a, b in zip(block.off[:-1].tolist(), block.off[1:].tolist()):
            g = gone[a:b]
            edges = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
            spans.append(edges.tolist())
            kept.append(block.buf[a:b][~g].tobytes())
            removed.append(int(g.sum()))
        columns = [block.table.column("doc_id").combine_chunks(), block.table.column("part").combine_chunks(), np.diff(block.off), removed, spans, kept]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def dedup_substrings(docs: DataFrame, width: int = 50, block_bytes: int | None = None, hot: int = 5000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for each row of docs: UTF-8 bytes without those in an earlier document's strings.

    Removes each byte covered by a string of `width` bytes that also starts in a document with a smaller doc_id, judged on
    the input. spans: begin and end byte of each maximal removed run, in turn; kept: the other bytes in a row (may cut a
    character). Null texts are empty; texts under `width` bytes keep all; rows with equal doc_ids do not count as earlier
    than each other; a null doc_id counts as the largest one. Repeated rows keep a row each. An empty table gives no rows.

    Blocks have 4 MB of text, up to 32 MB where the input has over a terabyte: a task's memory does not grow beyond that.
    An anchor in more than `hot` blocks is compared by its windows' own hashes (same result, no task gets it whole).
    """
    if not K < width <= 80:
        raise ValueError(f"width must be {K + 1} to 80")
    text = F.coalesce(docs["text"], F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long")).first()[0]
    block_bytes = block_bytes or min(32 << 20, max(4 << 20, int(25 * total**0.5)))
    blocks = max(1, -(-total // block_bytes))
    buckets = max(8, -(-total // (4 * block_bytes)))
    last = F.lit((1 << 63) - 1)
    base = docs.select(F.coalesce(docs["doc_id"].cast("long"), last).alias("doc_id"), F.xxhash64(text).alias("part"), text.alias("text"))
    base = base.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "part", "text")
    hashes = base.groupBy("block").applyInArrow(_hash_step(width, buckets), _SIDE)
    shared = hashes.groupBy("bucket").applyInArrow(_meet_step(hot), _SIDE)
    sent = base.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_context_step(width, buckets), _SIDE)
    answers = sent.groupBy("bucket").applyInArrow(_suffix_step(width), _SIDE)
    out = "doc_id long, part long, n_bytes long, n_removed long, spans array<long>, kept binary"
    done = base.groupBy("block").cogroup(shared.unionByName(answers).groupBy("block")).applyInArrow(_apply_step(width, buckets), out)
    return done.select(F.nullif("doc_id", last).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")
