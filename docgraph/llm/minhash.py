"""MinHash near-duplicates of whole documents by tensored banding, verified on whole sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm import passages
from docgraph.llm.common import Tables, row_slices, utf8
from docgraph.llm.decontaminate import Words
from docgraph.llm.graph import components
from docgraph.llm.paragraphs import _across, _alike, _parts

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's `n`-word shingle hashes in a row, repeats included, and where each text's begin.

    Fewer than n words are one shingle, no words none.
    """
    w = Words(buf, off, passages.KIND)
    count = np.diff(w.first)
    many = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    start = np.r_[0, np.cumsum(many)]
    flat = np.r_[w.shingles(n), np.zeros(n, np.uint64)][np.repeat(w.first[:-1] - start[:-1], many) + np.arange(start[-1])]
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            flat[start[few]] = w.shingles(k)[w.first[:-1][few]] * np.uint64(2 * k + 1)
    return flat, start


def half_keys(flat: np.ndarray, start: np.ndarray, halves: int, rows: int, seed: int = 29) -> np.ndarray:
    """Per text two small collections of `halves` keys each, every key from `rows` MinHashes; texts without shingles have zeros.

    These 2 * halves * rows MinHashes are all that is computed: the halves * halves table keys are pairs of one key of either
    collection.
    """
    r = np.random.default_rng(seed)
    factors = r.integers(1, 1 << 63, (2 * halves, rows, 2), dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(start) - 1, 2 * halves), np.uint64)
    full = np.flatnonzero(np.diff(start) > 0)
    if not len(full):
        return out
    for i in range(2 * halves):
        key = np.full(len(full), i, np.uint64)
        for f, g in factors[i]:
            x = flat * f
            x ^= x >> np.uint64(31)
            key = (key ^ np.minimum.reduceat(x * g, start[full])) * _MIX
            key ^= key >> np.uint64(29)
        out[full, i] = key
    return out


def sketches(docs: DataFrame, n: int, halves: int, rows: int) -> DataFrame:
    """(doc_id, key, size, u, v): the hash and size of each row's shingle set, and its two collections of half keys.

    Rows without words have size 0 and no key.
    """

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in row_slices(off, 1 << 18):
                flat, start = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)
                sets = [np.unique(flat[a:b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
                key = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                size = np.array([len(s) for s in sets], np.int64)
                x = half_keys(flat, start, halves, rows).view(np.int64)
                ends = pa.array((np.arange(j - i + 1) * halves).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(y).ravel())) for y in (x[:, :halves], x[:, halves:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(key, mask=size == 0), pa.array(size), *lists], ["doc_id", "key", "size", "u", "v"])

    return docs.mapInArrow(run, "doc_id long, key long, size long, u array<long>, v array<long>")


def _buckets(texts: DataFrame) -> DataFrame:
    """(band, key, size, hub, hub_size, n): the members of every table's buckets of several texts; the hub is the least key.

    Table (i, j) is keyed by the pair of u's i-th and v's j-th half key.
    """
    tables = F.expr("flatten(transform(u, (x, i) -> transform(v, (y, j) -> xxhash64(i, j, x, y))))")
    spread = texts.select("key", "size", F.explode(tables).alias("band"))
    full = spread.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("most"), F.min_by("size", "key").alias("hub_size"), F.count("*").alias("n"))
    return spread.join(full.where("hub < most").drop("most"), "band")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, s): the distinct shingle hashes of the wanted (key, doc_id) texts, one row of each doc_id's rows having the key."""

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in row_slices(off, 1 << 18):
                flat, start = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)
                want = [set(x) for x in batch.column(0).slice(i, j - i).to_pylist()]
                keys, sets = [], []
                for k, x in enumerate(want):
                    s = np.unique(flat[start[k] : start[k + 1]])
                    key = int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None
                    if key in x:
                        keys.append(key)
                        sets.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "s"])

    where = wanted.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("key").alias("keys"))
    found = docs.join(where, F.col("doc_id").eqNullSafe(F.col("__id"))).select("keys", "text").mapInArrow(run, "key long, s array<long>")
    return found.groupBy("key").agg(F.first("s").alias("s"))  # rows of one doc_id may repeat a text


def near_duplicates(docs: DataFrame, n: int = 4, jaccard: float = 0.8, halves: int = 8, rows: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text, ...); other columns are ignored.

    A document's set: its distinct `n`-word shingles, A-Z lower-cased, words being runs of non-space bytes; with fewer words
    the whole sequence is its one shingle. Documents are linked at a Jaccard similarity of `jaccard` or more of their whole
    sets; component_id is the least doc_id that can be reached, the row's own included; kept says that it is the row's own.

    Tensored banding: of two collections of `halves` keys of `rows` MinHashes each, every pair makes a table, 64 tables of 4
    MinHashes from 32 by the defaults. Two texts at s meet in a table with probability (1 - (1 - s**rows)**halves)**2, which
    is 0.9994 at 0.8 and 0.99997 at 0.85. Each text of a bucket is compared with the bucket's hub; what the hubs leave in
    different components of a bucket then goes through a prefix filter that loses none, so no bucket is capped, no link
    within one is lost and none is expanded to all its pairs. Sets are compared as 64-bit hashes of shingles, and equal
    sets are told by 64-bit hashes too; equal sets are one node, whatever the number of their copies.

    Null, empty and blank texts have no shingle and are linked with nothing. Rows that repeat keep a row each. A null doc_id
    names a component only if that has no other (component_id is null then, kept true). An empty table gives none.
    """
    tables = Tables(docs.sparkSession, "minhash")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    found = tables.keep(sketches(docs, n, halves, rows))
    copies = found.where("key is not null").groupBy("key", "size")
    texts = tables.keep(copies.agg(F.min("doc_id").alias("first"), F.first("u").alias("u"), F.first("v").alias("v")))
    members = tables.keep(_buckets(texts))
    alike = f"least(size, hub_size) >= {jaccard} * greatest(size, hub_size) - 1e-9"
    pairs = tables.keep(members.where("key <> hub").where(alike).select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct())
    # a bucket of two is compared whole; in larger ones some pairs may still be open
    met = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).unionByName(members.where("n > 2").select("key")).distinct()
    first = texts.join(met, "key", "left_semi").select("key", F.col("first").alias("doc_id"))
    sets = tables.keep(_sets(docs, first, n))
    a, b = (sets.select(F.col("key").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    links = tables.keep(*[_alike(pairs.where(x).join(a, "a").join(b, "b"), jaccard) for x in _parts("b")])
    roots = components(links)
    live = tables.keep(members.where("n > 2").select("band", "key", F.lit(True).alias("open")))
    tables.drop(members, pairs)
    more = _across(live, roots, sets, jaccard, tables)
    roots = tables.keep(components(links.unionByName(more)))
    tables.drop(live, links)
    named = texts.select("key", "first").join(roots.withColumnRenamed("node", "key"), "key")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    classes = texts.select("key", "first").join(named.join(least, "root").select("key", "least"), "key", "left")
    classes = tables.keep(classes.select("key", F.coalesce("least", "first").alias("component_id")))
    out = found.drop("u", "v").join(classes, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, all columns, without near copies: of each component the row with the least doc_id stays; of a
    doc_id's several rows those whose own text is of its component do."""
    keep = near_duplicates(docs, **settings).where("kept").select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["__keep"]), "left_semi")
