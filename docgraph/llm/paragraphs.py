"""Near-duplicate paragraphs: MinHash banding, exact Jaccard, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm import passages
from docgraph.llm.common import Tables, looked_up, row_slices, utf8
from docgraph.llm.decontaminate import Words
from docgraph.llm.graph import pointers

#: Stands for a null doc_id, which comes first.
_NO_ID = -(1 << 63)


class Paragraphs:
    """The paragraphs of some texts with enough words, and a 64-bit key of what each says.

    A paragraph is a line; if `wrapped`, also the lines between two blank ones, where they are several, as one.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, least: int, wrapped: bool = False):
        new = np.flatnonzero(buf == 10) + 1
        self.off = np.unique(np.r_[off, new]) if len(buf) else off
        self.words = Words(buf, self.off, passages.KIND)
        first = self.words.first
        text = np.searchsorted(off, self.off[:-1], side="right") - 1
        nth = np.arange(len(text)) - np.searchsorted(text, text)
        a = b = np.arange(len(text))
        if wrapped and len(text):
            full = np.diff(first) > 0
            same = np.r_[False, full[:-1] & (text[1:] == text[:-1])]
            begin, end = np.flatnonzero(full & ~same), np.flatnonzero(full & ~np.r_[same[1:] & full[1:], False])
            several = end > begin
            a, b = np.r_[a, begin[several]], np.r_[b, end[several]]
        enough = first[b + 1] - first[a] >= least
        a, b = a[enough], b[enough]
        self.begin, self.count = first[a], first[b + 1] - first[a]
        #: Each paragraph's text, first and last line.
        self.text, self.par, self.upto = text[a], nth[a], nth[b]

    def keys(self) -> np.ndarray:
        return passages.span_keys(self.words, self.begin, self.begin + self.count)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Every paragraph's shingle hashes in a row, and where each begins. Under n words the whole paragraph is one shingle."""
        many = np.maximum(self.count - n + 1, 1)
        start = np.r_[0, np.cumsum(many)]
        at = np.repeat(self.begin - start[:-1], many) + np.arange(many.sum())
        flat = np.r_[self.words.shingles(n), np.zeros(n, np.uint64)][at]
        for k in range(1, n):
            few = np.flatnonzero(self.count == k)
            if len(few):
                flat[start[few]] = self.words.shingles(k)[self.begin[few]] * np.uint64(2 * k + 1)
        return flat, start


def bands(shingles: np.ndarray, start: np.ndarray, number: int, rows: int, seed: int = 11) -> np.ndarray:
    """A key per paragraph and band from the band's `rows` least hashes."""
    r = np.random.default_rng(seed)
    factors = r.integers(1, 1 << 63, (number, rows, 2), dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(start) - 1, number), np.uint64)
    if not len(out):
        return out
    for i in range(number):
        key = np.full(len(out), i, np.uint64)
        for f, g in factors[i]:
            x = shingles * f
            x ^= x >> np.uint64(31)
            key = (key ^ np.minimum.reduceat(x * g, start[:-1])) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, i] = key
    return out


def _slices(batch, text: int, least: int, wrapped: bool):
    buf, off = utf8(batch.column(text))
    for i, j in row_slices(off, 1 << 18):
        yield i, Paragraphs(buf[off[i] : off[j]], off[i : j + 1] - off[i], least, wrapped)


def _found(docs: DataFrame, least: int, shingle: int, number: int, rows: int, wrapped: bool) -> DataFrame:
    """(doc_id, par, upto, size, key, bands) of every paragraph with enough words, and per input row one with par -1 and its lines in size."""
    names = ["doc_id", "par", "upto", "size", "key", "bands"]
    lists = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, p in _slices(batch, 1, least, wrapped):
                x, m = bands(*p.shingles(shingle), number, rows), len(p.text)
                keys = pa.ListArray.from_arrays(pa.array((np.arange(m + 1) * number).astype(np.int32)), pa.array(x.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p.text + i)), pa.array(p.par), pa.array(p.upto), pa.array(p.count), pa.array(p.keys().view(np.int64)), keys], names)
            buf, off = utf8(batch.column(1))
            full = np.diff(off) > 0
            lines = np.add.reduceat(np.r_[buf == 10, False].astype(np.int64), off[:-1]) * full + full if batch.num_rows else np.zeros(0, np.int64)
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int64(), lists)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(batch.num_rows, -1, np.int64)), none[0], pa.array(lines), *none], names)

    return docs.mapInArrow(run, "doc_id long, par long, upto long, size long, key long, bands array<long>")


def _texts(found: DataFrame) -> DataFrame:
    """(key, at, total, bands) of every distinct paragraph: its first place, its copies and its band keys."""
    return found.where("par >= 0").groupBy("key").agg(F.min(F.struct("doc_id", "par", "upto")).alias("at"), F.count("*").alias("total"), F.first("bands").alias("bands"))


def _stars(texts: DataFrame) -> DataFrame:
    """(band, n, hub, key) of every text in a bucket of several: the bucket's texts and its least key, the hub."""
    spread = texts.select("key", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("most"), F.count("*").alias("n")).where("hub < most").drop("most")
    return spread.join(looked_up(buckets), "band")


#: Words of 64 bits in a sketch.
_SKETCH = 4


def sketches(flat: np.ndarray, of: np.ndarray, number: int) -> np.ndarray:
    """Of each set 256 bits: which of 256 classes of hashes hold an odd number of its members. Two sets' sketches differ in no more
    bits than the sets in members, so they bound what the sets share."""
    at = of * (64 * _SKETCH) + (flat >> np.uint64(56)).astype(np.int64)
    odd = np.bincount(at, minlength=number * 64 * _SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(number, -1), axis=1).view(np.int64).reshape(number, _SKETCH)


def _sets(docs: DataFrame, wanted: DataFrame, least: int, shingle: int, wrapped: bool) -> DataFrame:
    """(key, hubs, lead, s, n, x0 ...): the distinct shingle hashes of the wanted (key, hubs, lead, at) paragraphs, one place of each
    being read, their number and sketch.

    Where several rows have the place's doc_id, a paragraph may come several times.
    """
    where = wanted.groupBy(F.col("at.doc_id").alias("__id")).agg(F.collect_list(F.struct("at.par", "at.upto", "key", "hubs", F.coalesce("lead", F.lit(False)).alias("lead"))).alias("pars"))

    def run(batches):
        for batch in batches:
            pars = batch.column(0)
            bounds, every = pars.offsets.to_numpy(), pars.values
            place = [every.field(c).to_numpy(zero_copy_only=False) for c in ("par", "upto", "key")]
            for i, p in _slices(batch, 1, least, wrapped):
                first = bounds[i]
                many = np.diff(bounds[i : i + int(p.text.max()) + 2]) if len(p.text) else np.zeros(0, np.int64)
                asked = first + np.arange(many.sum())
                par, upto, key = (x[asked] for x in place)
                # a slice has under 2**18 lines, or one text
                wide = int(max(p.upto.max(initial=0), upto.max(initial=0))) + 1
                code = lambda text, par, upto: (text * wide + par) * wide + upto  # noqa: E731, B023
                mine = code(p.text, p.par, p.upto)
                order = np.argsort(mine)
                want = code(np.repeat(np.arange(len(many)), many), par, upto)
                k = order[np.minimum(np.searchsorted(mine[order], want), len(mine) - 1)] if len(mine) else np.zeros(0, np.int64)
                same = (mine[k] == want) & (p.keys().view(np.int64)[k] == key)
                k, asked = k[same], asked[same]
                flat, start = p.shingles(shingle)
                size = start[k + 1] - start[k]
                of = np.repeat(np.arange(len(k)), size)
                s = flat[np.arange(len(of)) + np.repeat(start[k] - (np.cumsum(size) - size), size)]
                order = np.lexsort((s, of))
                s, of = s[order], of[order]
                new = np.r_[True, (s[1:] != s[:-1]) | (of[1:] != of[:-1])][: len(s)]
                s, of = s[new], of[new]
                n = np.bincount(of, minlength=len(k)).astype(np.int32)
                whole = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(s.view(np.int64)))
                bits = [pa.array(np.ascontiguousarray(x)) for x in sketches(s, of, len(k)).T]
                yield pa.RecordBatch.from_arrays([*[every.field(c).take(pa.array(asked)) for c in ("key", "hubs", "lead")], whole, pa.array(n), *bits], ["key", "hubs", "lead", "s", "n", *[f"x{c}" for c in range(_SKETCH)]])

    found = docs.join(looked_up(where), F.col("doc_id") == F.col("__id")).select("pars", "text")
    return found.mapInArrow(run, "key long, hubs array<long>, lead boolean, s array<long>, n int, " + ", ".join(f"x{c} long" for c in range(_SKETCH)))


def _alike(pairs: DataFrame, jaccard: float) -> DataFrame:
    """The distinct pairs (a, b) of (a, b, sa, sb) whose sets have the similarity."""
    x = pairs.where(F.least(F.size("sa"), F.size("sb")) >= jaccard * F.greatest(F.size("sa"), F.size("sb")))
    both = F.size(F.array_intersect("sa", "sb"))
    return x.where(both >= F.lit(jaccard) * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _near(sets: DataFrame, jaccard: float) -> DataFrame:
    """The pairs (a, b) of a hub and a text whose sizes and sketches do not rule the similarity out."""
    x = [f"x{c}" for c in range(_SKETCH)]
    hub = sets.where("lead").select(F.col("key").alias("a"), *[F.col(c).alias(f"{c}a") for c in ("n", *x)])
    pairs = sets.select(F.explode("hubs").alias("a"), F.col("key").alias("b"), "n", *x).where("a <> b").join(hub, "a")
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}a"))) for c in x), F.lit(0))
    most = F.floor((F.col("n") + F.col("na") - differ) / 2)
    alike = F.least("n", "na") >= F.lit(jaccard) * F.greatest("n", "na")
    return pairs.where(alike & (most >= F.lit(jaccard) * (F.col("n") + F.col("na") - most))).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """The pairs whose texts have the similarity."""
    a, b = (sets.select(F.col("key").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    return _alike(pairs.join(a, "a").join(b, "b"), jaccard)


def _heads(sets: DataFrame, jaccard: float, slots: int = 1 << 18) -> DataFrame:
    """(key, root, rare, size, left, t) of each set's prefix, its first size - ceil(jaccard * size) + 1 shingles in an order common to
    all sets: two sets at `jaccard` share one there. left counts those from t on. Rare shingles come first; how rare is
    read from counts by the low bits of the hash, which take `slots` numbers whatever the input. rare: how much of a set is
    rare (each shingle weighs a thousandth over its count), so a group's most typical text has the least.
    """
    slot = F.col("t").bitwiseAND(F.lit(slots - 1)).alias("slot")
    counts = np.ones(slots, np.int64)
    for x in sets.select(F.explode("s").alias("t")).groupBy(slot).agg(F.count("*").alias("n")).where("n > 1").collect():
        counts[x["slot"]] = x["n"]
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(size)), size)
            seen = shared.value[flat & (slots - 1)]
            rare = np.bincount(of, 1000 // seen, len(size)).astype(np.int64)
            order = np.lexsort((flat, seen, of))
            at = np.arange(len(flat)) - (np.cumsum(size) - size)[of]
            head = np.flatnonzero(at < (size - np.ceil(jaccard * size - 1e-9) + 1)[of])
            row = pa.array(of[head])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(rare[of[head]]), pa.array(size[of[head]]), pa.array((size[of] - at)[head]), pa.array(flat[order][head])], ["key", "root", "rare", "size", "left", "t"])

    return sets.mapInArrow(run, "key long, root long, rare long, size long, left long, t long")


def _across(live: DataFrame, roots: DataFrame, sets: DataFrame, jaccard: float, tables: Tables) -> DataFrame:
    """Links (a, b) that join what the hubs left in different components: none of a bucket's that would join two is left out.

    Two sets with the similarity share a prefix shingle, and from the first one on that they share enough remains in both.
    Of each such shingle first the most typical text of every component is compared with the most typical of all, which joins
    large groups by few links; only texts that are still apart are then compared in pairs. Members of buckets that were compared
    whole or are one component already, and shingles that one component has alone, are not looked at. live: (band, key,
    open), open saying that the bucket may hold a pair that was not compared.
    """
    rows = live.join(looked_up(roots.withColumnRenamed("node", "key")), "key", "left").withColumn("root", F.coalesce("root", "key"))
    parted = rows.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_or("open").alias("open")).where("lo < hi and open").select("band")
    apart = tables.keep(rows.join(looked_up(parted), "band", "left_semi").select("key", "root").distinct())
    rest = tables.keep(*[sets.where(x).select("key", "s").join(looked_up(apart.where(x)), "key").select("key", "root", "s") for x in _parts("key")])
    tables.drop(sets)  # rest has all that is still looked at
    prefixes = tables.keep(_heads(rest, jaccard))
    first = prefixes.groupBy("t", "root").agg(F.min_by("key", "rare").alias("key"), F.min("rare").alias("rare"))
    hub = first.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by("key", "rare").alias("hub")).where("lo < hi").select("t", "hub")
    pairs = tables.keep(first.join(looked_up(hub), "t").where("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct())
    some = tables.keep(_linked(pairs, rest, jaccard))
    joined = pointers(some.join(apart.withColumnRenamed("key", "a").withColumnRenamed("root", "x"), "a").join(apart.withColumnRenamed("key", "b").withColumnRenamed("root", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    heads = prefixes.join(looked_up(joined.select(F.col("node").alias("root"), F.col("root").alias("now"))), "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now")
    met = heads.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("t")
    a, b = (heads.select("t", F.col("key").alias(x), *[F.col(y).alias(y + x) for y in ("root", "size", "left")]) for x in "ab")
    enough = F.least("lefta", "leftb") >= F.lit(jaccard / (1 + jaccard)) * (F.col("sizea") + F.col("sizeb")) - F.lit(1e-9)
    alike = F.least("sizea", "sizeb") >= F.lit(jaccard) * F.greatest("sizea", "sizeb") - F.lit(1e-9)
    still = tables.keep(a.join(looked_up(met), "t", "left_semi").join(b, "t").where("a < b and roota <> rootb").where(alike & enough).select("a", "b").distinct())
    links = tables.keep(some, _linked(still, rest, jaccard))
    tables.drop(apart, rest, prefixes, pairs, some, still)
    return links


def _parts(column: str, n: int = 2) -> list[F.Column]:
    """Conditions that part a table's rows by a key, so that a step on whole sets has a part of them in shuffle files at a time."""
    return [F.pmod(F.col(column), F.lit(n)) == k for k in range(n)]


def repeated(docs: DataFrame, least: int = 20, shingle: int = 5, jaccard: float = 0.8, number: int = 6, rows: int = 2, wrapped: bool = False) -> DataFrame:
    """(doc_id, par, upto, size, keep_doc, keep_par, keep_upto, total): every paragraph of `least` words or more and what its class keeps.

    A paragraph is a line, from place par to upto; if `wrapped`, also several lines between two blank ones, as one. With
    `least` 1 every paragraph with a word is judged: under `shingle` words, as one shingle. size: its words. Equal ones (white
    space and the case of A-Z apart) are one text; texts and shingles are told apart by 64-bit hashes. Texts that collide in
    one of `number` bands of `rows` MinHashes of their `shingle`-word shingles are candidates; those at a Jaccard similarity
    of `jaccard` or more, by their whole sets, are linked, links make classes by connected components, and a class keeps its
    first paragraph by (doc_id, place). Two texts at 0.8 collide with probability 1 - (1 - 0.8**2)**6 = 0.998. Every text is
    compared with three hubs of its buckets at most, and then, by a prefix filter that loses none, with those of its buckets
    that this did not bring into its component: no link within a bucket is lost.
    total: paragraphs in the class, null where it is alone. Rows with par -1 (one per input row, key null) count lines in
    size. Rows of equal doc_id are one document. Null texts have no paragraphs; a null doc_id comes first (and is the least
    long in the result); repeated rows repeat their paragraphs; an empty table gives no rows.
    """
    if least < shingle and least != 1:
        raise ValueError("least must be at least shingle, or 1 for every paragraph")
    tables = Tables(docs.sparkSession, "paragraphs")
    docs = _plain(docs)
    found = tables.keep(_found(docs, least, shingle, number, rows, wrapped))
    banded = tables.keep(_texts(found))
    units = tables.keep(found.drop("bands"))
    tables.drop(found)
    stars = tables.keep(_stars(banded))
    texts = tables.keep(banded.drop("bands"))
    tables.drop(banded)
    # each text is compared with three hubs of its buckets at most; what that leaves open goes to _across
    others = [F.min_by("key", F.xxhash64("key", F.lit(i))).alias(f"hub{i}") for i in (1, 2)]
    crowded = stars.where("n > 2").groupBy("band").agg(*others)
    hubs = stars.join(looked_up(crowded), "band", "left").groupBy("key").agg(F.min("hub").alias("first"), F.min("hub1").alias("second"), F.min("hub2").alias("third"))
    hubs = tables.keep(hubs.select("key", "first", F.nullif("second", "first").alias("second"), F.nullif(F.nullif("third", "first"), "second").alias("third")))
    live = tables.keep(stars.join(looked_up(hubs.select("key", "first")), "key").select("band", "key", F.expr("n > 2 or key <> hub and first <> hub").alias("open")))
    tables.drop(stars)
    lead = hubs.select(F.explode(F.array("first", "second", "third")).alias("key")).where("key is not null").distinct().withColumn("lead", F.lit(True))
    wanted = looked_up(hubs.join(looked_up(lead), "key", "left")).join(texts.select("key", "at"), "key").withColumn("hubs", F.array("first", "second", "third"))
    sets = tables.keep(_sets(docs, wanted, least, shingle, wrapped))
    near = tables.keep(_near(sets, jaccard).distinct())
    a = sets.where("lead").select(F.col("key").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("key").alias("b"), F.col("s").alias("sb"))
    links = tables.keep(*[_alike(looked_up(near.where(x)).join(b.where(x), "b").join(a, "a"), jaccard) for x in _parts("b")])
    tables.drop(near)
    roots = pointers(links)
    more = _across(live, roots, sets, jaccard, tables)
    tables.drop(live, links, hubs)
    roots = pointers(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = texts.join(looked_up(roots.withColumnRenamed("node", "key")), "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = named.groupBy("root").agg(F.min("at").alias("keep"), F.sum("total").alias("of_class")).where("of_class > 1")
    of = tables.keep(named.join(looked_up(classes), "root").select("key", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.par").alias("keep_par"), F.col("keep.upto").alias("keep_upto"), F.col("of_class").alias("total")))
    tables.drop(texts)
    return units.join(looked_up(of), "key", "left").drop("key")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def dedup_paragraphs(docs: DataFrame, reach: int = 16, passage: int = 20, **settings) -> DataFrame:
    """One row per document: doc_id, n_lines, n_paragraphs (long enough to judge), n_repeated (in a class of several),
    n_removed (lines of those that are not the class's first), removed (their places, as text), n_passages and passages (word
    ranges, `begin-end` as text, of the stretches that an earlier document has, see `passages`), class_id.

    Of paragraphs of several lines, a line that its own class keeps stays, and so does one that overlaps what its class
    keeps. class_id is the least doc_id that can be reached from the document by shared passages, or its own: documents are
    linked to those that keep one of its stretches or one of its paragraphs of `passage` words or more. Short lines that many
    documents have are removed too, but make no document another's copy. With a `passage` of 20 and a `reach` of 16, every
    passage of over 50 words that two documents share links them, wherever it stands in its lines. See `repeated` for the
    rules and their edge cases."""
    tables = Tables(docs.sparkSession, "paragraph-classes")
    r = tables.keep(repeated(docs, **settings))
    plain = _plain(docs)
    shared = tables.keep(passages.shared_runs(plain, reach))
    found = tables.keep(passages.repeated_passages(plain, shared, reach, passage))
    tables.drop(shared)
    edges = r.where("keep_doc <> doc_id").where(F.col("size") >= passage).select(F.col("doc_id").alias("a"), F.col("keep_doc").alias("b"))
    roots = pointers(edges.unionByName(found.select(F.col("doc_id").alias("a"), F.explode("keeps").alias("b"))))
    gone = F.expr("total is not null and not (doc_id = keep_doc and par <= keep_upto and keep_par <= upto)")
    kept = F.expr("total is not null and par = upto and doc_id = keep_doc and par = keep_par and upto = keep_upto")
    stretches = found.select("doc_id", F.lit(-2).cast("long").alias("par"), F.struct("begin", "end").alias("stretch"))
    r = r.withColumn("gone", gone).withColumn("kept", kept).unionByName(stretches, allowMissingColumns=True)
    r = r.groupBy("doc_id").agg(
        F.sum(F.when(F.col("par") == -1, F.col("size")).otherwise(0)).alias("n_lines"),
        F.count_if(F.col("par") >= 0).alias("n_paragraphs"),
        F.count("total").alias("n_repeated"),
        F.collect_list(F.expr("if(gone and par = upto, par, null)")).alias("alone"),
        F.flatten(F.collect_list(F.expr("if(gone and par < upto, sequence(par, upto), null)"))).alias("together"),
        F.collect_list(F.expr("if(kept, par, null)")).alias("kept"),
        F.array_sort(F.collect_list("stretch")).alias("stretches"),
    )
    places = F.array_sort(F.concat("alone", F.array_except(F.array_except("together", "kept"), "alone")))
    r = r.withColumn("places", places).join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return r.select(
        F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "n_lines", "n_paragraphs", "n_repeated", F.size("places").cast("long").alias("n_removed"), F.array_join("places", ",").alias("removed"),
        F.size("stretches").cast("long").alias("n_passages"), F.array_join(F.transform("stretches", lambda x: F.concat_ws("-", x["begin"], x["end"])), ",").alias("passages"),
        F.nullif(F.coalesce("root", "doc_id"), F.lit(_NO_ID)).alias("class_id"),
    )


def remove_repeats(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, text) without the removed lines and passages. Rows of equal doc_id lose the same places; null texts stay null."""
    gone = dedup_paragraphs(docs, **settings).select(F.col("doc_id").alias("__id"), "removed", "passages")

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            out = []
            for k, (text, lines, stretches) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                out.append(text if text is None else without(buf[off[k] : off[k + 1]], lines, stretches))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    joined = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")))
    return joined.select("doc_id", "text", "removed", "passages").mapInArrow(run, "doc_id long, text string")


def without(text: np.ndarray, lines: str, stretches: str) -> str:
    """A text's UTF-8 bytes without some of its lines (places) and stretches of words (`begin-end`), as a string."""
    keep = np.ones(len(text), bool)
    if stretches:
        words = Words(text, np.array([0, len(text)]), passages.KIND)
        starts = np.r_[words.start, len(text)]
        for x in stretches.split(","):
            a, b = map(int, x.split("-"))
            keep[starts[a] : starts[b] if b < len(words.start) else words.end[-1]] = False
    bounds = np.r_[0, np.flatnonzero(text == 10) + 1, len(text)]
    gone = set(map(int, lines.split(","))) if lines else set()
    parts = [text[a:b][keep[a:b] & (text[a:b] != 10)].tobytes() for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if k not in gone]
    return b"\n".join(parts).decode("utf-8", "replace")
