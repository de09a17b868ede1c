"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import cut, texts_of, unsent
from docgraph.llm.graph import components

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def simhash(text: bytes, n: int = 3) -> int:
    """The 64-bit fingerprint of a text's n-word shingles, repeats included: a bit is 1 if it is in over half their hashes.

    Words are runs of non-space bytes with A-Z lower-cased. Fewer than n words are one shingle; no words give 0.
    """
    clean = _SPACE.sub(b" ", text.lower()).strip(b" ")
    if not clean:
        return 0
    gaps = np.flatnonzero(np.frombuffer(clean, np.uint8) == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(clean)]
    if len(starts) >= n:
        starts, ends = starts[: len(starts) - n + 1], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), 1 << 16):
        h = np.array([digest(clean[a:b], 42) for a, b in zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist())], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. One row per input row."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((simhash(t, n) for t in texts_of(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _segment(seg: int) -> str:
    return f"(shiftrightunsigned(fp, {32 * seg}) & 4294967295L)"


def variants(fps: DataFrame) -> DataFrame:
    """(key, side, fp): for each of two 32-bit segments its value (side 2) and its 32 one-wildcard forms (side: the bit under it).

    Two segments that differ in exactly one bit share the form with the wildcard there, on opposite sides.
    """
    forms = ", ".join(
        f"array(named_struct('key', {(33 * seg + 32) << 32}L + {v}, 'side', 2)),"
        f"transform(sequence(0, 31), i -> named_struct('key', ({33 * seg}L + i) * 4294967296L + ({v} & ~shiftleft(1L, i)), 'side', cast(shiftright({v}, i) & 1L as int)))"
        for seg, v in ((0, _segment(0)), (1, _segment(1)))
    )
    return fps.select("fp", F.explode(F.expr(f"concat({forms})")).alias("x")).select("x.key", "x.side", "fp")


def _cliques(hot: DataFrame) -> DataFrame:
    """Links within keys of too many members, without pairs: a second set of wildcards in the other segment.

    Members that agree under both differ in two bits at most, so each is linked to the least of its clique alone. A member
    costs 32 rows, or 496 in a key on a full half, whatever the key's size; they are made twice, which is CPU time, rather
    than kept, which would be disk.
    """
    masks = """case when side = 2
        then filter(flatten(transform(sequence(0, 31), i -> transform(sequence(0, 31), j -> if(i < j, shiftleft(1L, i) | shiftleft(1L, j), 0L)))), m -> m <> 0)
        else transform(sequence(0, 31), i -> shiftleft(1L, i)) end"""
    other = f"if(key div {33 << 32}L = 0, {_segment(1)}, {_segment(0)})"
    rows = hot.select("key", "fp", F.expr(other).alias("o"), F.explode(F.expr(masks)).alias("mask")).select("key", "mask", F.expr("o & ~mask").alias("rest"), "fp")
    least = rows.groupBy("key", "mask", "rest").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most").drop("most")
    return rows.join(unsent(least), ["key", "mask", "rest"]).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))


def links(fps: DataFrame, pairs_up_to: int = 48) -> DataFrame:
    """(a, b) pairs of distinct fingerprints at 1 or 2 differing bits that connect whatever such pairs connect.

    Of two segments one differs by at most one bit. Keys of up to `pairs_up_to` members give verified pairs; larger keys go
    to `_cliques`, which is exact too, so no bucket is capped.
    """
    # each fingerprint becomes 66 rows, so a task takes some thousands of them, whatever the reader's partitions hold
    v = variants(fps.repartition(max(1, -(-fps.count() // 15_000)), "fp"))
    sizes = v.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi")).where("n > 1 and (lo < hi or lo = 2)").select("key", "n")
    live = cut(v.join(unsent(sizes), "key"))
    few, hot = live.where(F.col("n") <= pairs_up_to), live.where(F.col("n") > pairs_up_to)
    a, b = few.select("key", F.col("side").alias("sa"), F.col("fp").alias("a")), few.select("key", F.col("side").alias("sb"), F.col("fp").alias("b"))
    pairs = a.join(unsent(b), "key").where("(sa = 0 and sb = 1 or sa = 2 and sb = 2 and a < b) and bit_count(a ^ b) <= 2").select("a", "b")
    return pairs.unionByName(_cliques(hot).where("bit_count(a ^ b) <= 2"))


def near_duplicates(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text, ...); other columns are ignored.

    Fingerprints at two or fewer differing bits are linked; component_id is the least doc_id that can be reached, the row's
    own included. Null and empty texts have fingerprint 0 and are linked like any other. Rows that repeat keep a row each;
    a null doc_id is never a component's name unless the component has no other (then component_id is null).
    """
    rows = cut(fingerprints(docs, n))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    named = fps.join(unsent(roots), "fp").groupBy("root").agg(F.min("first").alias("least"))
    classes = fps.join(unsent(roots), "fp", "left").join(unsent(named), "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(unsent(classes), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without near copies: of each component the row with the least doc_id stays.

    Where that doc_id has several rows, they all stay if their texts are of one component (they are one document).
    """
    found = near_duplicates(docs)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(unsent(keep), docs["doc_id"].eqNullSafe(keep["__keep"]), "left_semi")
