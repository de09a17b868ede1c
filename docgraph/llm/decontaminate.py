"""Benchmark decontamination by a prefix-filtered set join of word shingles."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import row_slices, utf8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits, lower-case letters and every byte of a code point from U+0080 on.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_P_INVERSE = pow(_P, -1, 1 << 64)


@lru_cache(maxsize=16)
def _table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    out = np.cumprod(out, dtype=np.uint64)
    out.flags.writeable = False
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers from 0 to n - 1 modulo 2**64, read only. Those of usual lengths are kept by the process."""
    most = 1 << max(18, (n - 1).bit_length())
    return (_table(base, most) if most <= 1 << 19 else _table.__wrapped__(base, n))[:n]


@lru_cache(maxsize=16)
def _translations(kind: bytes) -> bytes:
    return np.frombuffer(kind, bool)[_LOWER].tobytes()


class Words:
    """The words of some texts: byte spans, hashes, and the first word of each text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, kind: np.ndarray = _WORD):
        # bytes.translate and arrays worked on in place: several passes over a corpus spend most of their time here
        n, raw = len(buf), buf.tobytes()
        self.bytes = np.frombuffer(raw.translate(_LOWER.tobytes()), np.uint8)
        inside = np.frombuffer(raw.translate(_translations(kind.tobytes())), bool)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)
        terms = self.bytes.astype(np.uint64)
        terms += np.uint64(1)
        terms *= powers(_P, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        h = sums[self.end]
        h -= sums[self.start]
        h *= powers(_P_INVERSE, n + 1)[self.start]
        h ^= h >> np.uint64(32)
        self.hash = h * np.uint64(_Q)
        self.text = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def shingles(self, n: int) -> np.ndarray:
        """A hash for every n words in a row, those across two texts included."""
        m = max(0, len(self.hash) - n + 1)
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h = h * np.uint64(_P) + self.hash[i : i + m]
        return h ^ (h >> np.uint64(29))

    def joined(self, i: int, n: int) -> bytes:
        return b" ".join(self.bytes[a:b].tobytes() for a, b in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist()))


#: Shingles' frequencies are told apart in so many slots, whatever the tables' sizes.
SLOTS = 1 << 18


def _slot(k: int, h: np.ndarray) -> np.ndarray:
    return (((h ^ np.uint64(k)) * np.uint64(_P)) >> np.uint64(46)).astype(np.int64)


class Windows:
    """The windows of `window` words of some items (an item of fewer words is one window), each found by its rarest shingle.

    A window is a set of shingles of `n` words; all of them must be in a text that holds it, so of the sets ordered by rarity
    a prefix of one is necessary: the shingle whose slot has the lowest count. All is kept in arrays over the items' words.
    """

    def __init__(self, ids: list, buf: np.ndarray, off: np.ndarray, window: int, n: int, counts: np.ndarray):
        self.ids, self.words = ids, (w := Words(buf, off))
        many = np.diff(w.first)
        each = np.where(many > 0, np.maximum(many - window + 1, 1), 0)
        self.item = np.repeat(np.arange(len(many)), each)
        self.begin = w.first[:-1][self.item] + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        self.size = np.minimum(many, window)[self.item]
        #: By shingle length: sorted hashes, where each one's windows begin, and for each of these the window and the place in it.
        self.prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        place = np.zeros(len(self.size), np.int64)
        key = np.zeros(len(self.size), np.uint64)
        for size in np.unique(self.size).tolist():
            k, mine = min(n, size), np.flatnonzero(self.size == size)
            h = w.shingles(k)
            seen = counts[_slot(k, h)]
            best = self.begin[mine]
            for j in range(1, size - k + 1):
                at = self.begin[mine] + j
                rarer = (seen[at] < seen[best]) | ((seen[at] == seen[best]) & (h[at] < h[best]))
                best = np.where(rarer, at, best)
            place[mine], key[mine] = best - self.begin[mine], h[best]
        for k in np.unique(np.minimum(self.size, n)).tolist():
            mine = np.flatnonzero(np.minimum(self.size, n) == k)
            mine = mine[np.argsort(key[mine], kind="stable")]
            hashes, first = np.unique(key[mine], return_index=True)
            self.prefixes[k] = hashes, np.r_[first, len(mine)], mine, place[mine]


def _within(words: Words, n: int, at: np.ndarray) -> np.ndarray:
    return at[words.text[at] == words.text[at + n - 1]] if len(at) else at


def _matches(words: Words, windows: Windows):
    """(first word, window) of every verified occurrence in the texts."""
    for k, (keys, start, window, place) in windows.prefixes.items():
        h = words.shingles(k)
        if not len(keys) or not len(h):
            continue
        slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        at = _within(words, k, np.flatnonzero(keys[slot] == h))
        slot = slot[at]
        many = start[slot + 1] - start[slot]
        x = np.repeat(start[slot] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(at) else at
        pos, win = np.repeat(at, many) - place[x], window[x]
        # positional and length bounds: the window at this offset begins and ends in the same text
        last = pos + windows.size[win] - 1
        ok = (pos >= 0) & (last < len(words.text))
        pos, win, last = pos[ok], win[ok], last[ok]
        ok = words.text[pos] == words.text[last]
        pos, win = pos[ok], win[ok]
        # exact containment: word by word by hash, then what is left by its bytes
        for j in range(int(windows.size.max())):
            in_it = windows.size[win] > j
            ok = ~in_it
            ok[in_it] = words.hash[pos[in_it] + j] == windows.words.hash[windows.begin[win[in_it]] + j]
            pos, win = pos[ok], win[ok]
        for p, x in zip(pos.tolist(), win.tolist()):
            if words.joined(p, n := int(windows.size[x])) == windows.words.joined(int(windows.begin[x]), n):
                yield p, x


def _slots_of(texts: DataFrame, lengths: list[int], used: np.ndarray | None) -> np.ndarray:
    """How many shingles of these lengths the texts have in each slot, of all slots or of the used ones: an array of fixed size."""
    shared = texts.sparkSession.sparkContext.broadcast(used)

    def run(batches):
        total, some = np.zeros(SLOTS, np.int64), shared.value
        for batch in batches:
            buf, off = utf8(batch.column(0))
            for i, j in row_slices(off):
                w = Words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                for k in lengths:
                    at = _within(w, k, np.arange(max(0, len(w.hash) - k + 1)))
                    total += np.bincount(_slot(k, w.shingles(k)[at]), minlength=SLOTS)
        at = np.flatnonzero(total if some is None else total * some)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    rows = texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def _pass(frame: DataFrame, windows: Windows) -> DataFrame:
    names = frame.columns
    shared = frame.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        windows = shared.value
        for batch in batches:
            buf, off = utf8(batch.column(1))
            n_words, spans, items = [], [], []
            old_spans, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, j in row_slices(off):
                w = Words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                n_words += np.diff(w.first).tolist()
                hits: dict = {}
                for p, x in _matches(w, windows):
                    hits.setdefault(int(w.text[p]), []).append((p, x))
                for t in range(j - i):
                    found, base = hits.get(t, ()), int(w.first[t])
                    mine = [*zip(old_spans[i + t][::2], old_spans[i + t][1::2]), *((p - base, p - base + int(windows.size[x])) for p, x in found)]
                    merged: list[int] = []
                    for a, b in sorted(mine):
                        if merged and a <= merged[-1]:
                            merged[-1] = max(merged[-1], b)
                        else:
                            merged += (a, b)
                    spans.append(merged)
                    items.append(sorted({*old_items[i + t], *(windows.ids[windows.item[x]] for _, x in found)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names)

    return frame.mapInArrow(run, frame.schema)


def _united(spans) -> Column:
    """Begins and ends, in turn, of any spans as those of the fewest spans that cover the same words, in order."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(2)), lambda i: F.struct(F.element_at(spans, i.cast("int")).alias("a"), F.element_at(spans, (i + 1).cast("int")).alias("b"))))

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))  # null at first
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(last, x["b"])))
        return F.when(x["a"] <= last, longer).otherwise(F.concat(done, F.array(x["a"], x["b"])))

    return F.aggregate(pairs, F.array().cast("array<long>"), add)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_words, spans, items) for each row of docs: which words lie in a benchmark window, and which items have one there.

    Words: A-Z lower-cased, runs of digits, letters a-z and code points from U+0080 on. An item's windows are `window` words
    in a row; an item of fewer, but not none, is one. Each window is a set of `shingle`-word shingles. Shingles are ordered
    by rarity, read from counts over all documents in a table of fixed size, which one pass makes for the whole benchmark; a
    window is looked up by its necessary prefix (all must be there, so its rarest shingle), the place of the shingle bounds
    where it can begin and end, and its words are then compared exactly.
    spans: begin and end word of each maximal hit run, in turn. Null texts have no words; null item ids and items without
    words match nothing; repeated rows of docs keep a row each, repeated items count once; an empty table on either side
    gives no rows or no hits. Items go to executors in blocks of about `block_bytes` of text (an index of some six times as
    much). A benchmark of one block is one pass without a shuffle; of more, each block has tasks of its own over the documents,
    whose hits alone are shuffled and put together by doc_id and SHA-256 of the text. So the driver gathers and a worker holds
    one block's index at a time; the scans, and the broadcasts that lie on disk until the job ends, grow with the number of
    blocks. Other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text")).where("id is not null and text <> ''")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    texts = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"))
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    lengths = sorted(r.k for r in items.select(F.least(words, F.lit(min(window, shingle))).alias("k")).distinct().collect() if r.k)
    used = _slots_of(items.select("text"), lengths, None) > 0
    counts = _slots_of(texts, lengths, used)
    frame = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))

    def block(k: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
        return _pass(frame, Windows(rows.column("id").to_pylist(), *utf8(rows.column("text")), window, shingle, counts))

    if blocks == 1:
        return block(0).select("doc_id", "n_words", "spans", "items")
    # tasks of one block each, which send their hits alone: a worker holds one index, and no text is shuffled
    key = F.sha2("text", 256).alias("key")
    hits = None
    for k in range(blocks):
        got = block(k).where(F.size("items") > 0).select("doc_id", key, "spans", "items").dropDuplicates(["doc_id", "key"])
        hits = got if hits is None else hits.unionByName(got)
    both = hits.groupBy("doc_id", "key").agg(_united(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = both.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "spans", "items")
    every = frame.select("doc_id", key, words.cast("long").alias("n_words"))
    out = every.join(both, every["doc_id"].eqNullSafe(both["__id"]) & (every["key"] == both["__key"]), "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs, all columns, without the documents that have a benchmark window. A doc_id, null included, goes with all its rows;
    null and empty texts stay; an empty benchmark removes nothing."""
    bad = matches(docs, benchmark, window).where(F.size("items") > 0).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti")
