"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import Tables, words_of

#: Stands for a null doc_id in comparisons of ranks.
_NO_ID = -(1 << 62)
#: How fine ranks are binned by their logarithm, and the range of it that bins tell apart.
_BIN_ROWS, _LOG = 5000, 24.0


def _uniform(doc_id) -> F.Column:
    """A number in [0, 1) from doc_id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _favour(size) -> F.Column:
    """What a document's expected copies are in proportion to: one over the root of its size, in millionths."""
    return F.floor(F.lit(1e6) / F.sqrt(size.cast("double"))).cast("long")


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """rows (size, u, id, level, ...) with `whole`, the copies that are certain, and `rank`, by which the last copy is drawn."""
    expected = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("level") * _favour(F.col("size")))).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(expected).cast("int")).withColumn("p", expected - F.floor(expected))
    odds = (F.col("u") / (1 - F.col("u"))) / F.nullif(F.col("p") / (1 - F.col("p")), F.lit(0.0))
    return rows.withColumn("rank", F.when(odds.isNotNull(), F.struct(odds.alias("odds"), F.col("id"), F.col("size")))).drop("p")


def measured(docs: DataFrame) -> DataFrame:
    """(source, id, size, u) per row: what every later step needs of it."""
    return docs.select(docs["source"].alias("source"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)).alias("id"), F.size(words_of(docs["text"])).cast("long").alias("size"), _uniform(docs["doc_id"]).alias("u"))


def targets(sizes: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (source, source_size) with each source's target share of the total.

    Sources by code point, null last, weigh `weights` in turn and share the total; a target stops at `most` times its
    source's size and the excess is shared again by weight. In order of cap over weight the capped sources come first, so
    running sums find the level at which it settles.
    """
    all_rows = Window.partitionBy(F.lit(0))
    w = sizes.withColumn("k", F.row_number().over(all_rows.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod("k", F.lit(len(weights))) + 1))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = all_rows.orderBy(F.col("cap") / F.col("w"), "k")
    w = w.withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("capped", F.min(F.col("level") * F.col("w") > F.col("cap")).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.withColumn("settled", first)
    return w.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("settled") * F.col("w")).alias("target"))


def levels(by_size: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """goal (source, source_size, target) with `level`: expected copies are the lesser of `most` and level times _favour.

    by_size (source, size, n): sizes above 0 and how many rows have them. In order of size those that reach `most` come
    first, so running sums find the level at which expected words equal the target. Null where all reach it.
    """
    x = by_size.alias("b").join(small(goal).alias("g"), F.expr("b.source <=> g.source")).select("b.source", "size", "n", "target").withColumn("x", _favour(F.col("size")))
    up = Window.partitionBy("source").orderBy("size")
    before = F.coalesce(F.sum(F.col("n") * F.col("size")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum((F.col("n") * F.col("size")).cast("decimal(20,0)") * F.col("x")).over(up.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("level", (F.col("target") - (before * most).cast("double")) / ahead.cast("double"))
    found = x.where(F.col("level") * F.col("x") <= most).groupBy("source").agg(F.min_by("level", "size").alias("level"))
    return goal.alias("g").join(found.alias("f"), F.expr("g.source <=> f.source"), "left").select("g.*", "f.level")


def _fill(rows: DataFrame, p: DataFrame, tables: Tables) -> DataFrame:
    """(source, last, used): how far by rank each source's open rows fit its gap, and their words.

    Running sums go over bins of the rank's logarithm first and over one bin's rows second, so no task orders a source.
    """
    state = small(p.select(F.col("source").alias("s"), "gap", "last"))
    left = rows.join(state, F.expr("source <=> s")).where("size between 1 and gap and rank > last").drop("s")
    by_bin = left.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("rank").alias("top"), F.first("gap").alias("gap"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    by_bin = tables.keep(by_bin.withColumn("upto", upto))
    full = by_bin.where("upto <= gap").groupBy("source").agg(F.max("top").alias("last"), F.max("upto").alias("used"))
    edge = by_bin.where("upto > gap").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
    inside = left.alias("x").join(small(edge).alias("e"), F.expr("x.source <=> e.source and x.bin = e.e.bin")).select("x.source", "x.rank", "x.size", "x.gap", "e.e.before")
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank"))).where("upto <= gap")
    both = full.unionByName(inside.groupBy("source").agg(F.max("rank").alias("last"), F.max("upto").alias("used")))
    return both.groupBy("source").agg(F.max("last").alias("last"), F.max("used").alias("used"))


def plan(docs: DataFrame, weights=(1, 2, 3), most: int = 3, passes: int = 4) -> tuple[DataFrame, DataFrame, Tables]:
    """What each source takes, the rows that were measured for it, and where both are kept.

    A document's expected copies are in proportion to one over the root of its size, `most` at most, and such that a
    source's expected words are its target: a long document's share grows with the root of its length, and none decides
    alone whether the target is met. The whole part of them is certain. The fractions p are drawn by Pareto order sampling:
    with u uniform in [0, 1) from doc_id, rank by (u / (1 - u)) / (p / (1 - p)) and take the ranks whose words fit what the
    certain copies leave. The next rank is too long for what is left then; later passes go on by rank among those that fit.

    Per source: source_size, target, level, and steps (after, last, gap): a row takes one copy more if for a step its rank
    is above `after`, `last` at most, and its size is `gap` at most.
    """
    tables = Tables(docs.sparkSession, "mix")
    rows = tables.keep(measured(docs))
    by_size = tables.keep(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = tables.keep(targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most))
    goal = tables.keep(levels(by_size.where("size > 0"), goal, most))
    ranked = _drawn(rows.join(small(goal.select(F.col("source").alias("s"), "level")), F.expr("source <=> s")).drop("s"), most)
    bins = max(64, rows.count() // _BIN_ROWS)
    spread = F.coalesce(F.log("rank.odds") / (2 * _LOG) + 0.5, F.lit(0.0))
    ranked = tables.keep(ranked.withColumn("bin", F.floor(F.least(F.greatest(spread, F.lit(0.0)), F.lit(1.0)) * bins).cast("int")).select("source", "rank", "size", "whole", "bin"))
    certain = ranked.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("words"))
    first = F.struct(F.lit(-1.0).alias("odds"), F.lit(_NO_ID).alias("id"), F.lit(-1).cast("long").alias("size"))
    p = goal.alias("g").join(certain.alias("c"), F.expr("g.source <=> c.source"), "left").select("g.*", (F.col("target") - F.coalesce("words", F.lit(0))).alias("gap"), first.alias("last"))
    p = tables.keep(p.withColumn("steps", F.array().cast("array<struct<after:struct<odds:double,id:bigint,size:bigint>,last:struct<odds:double,id:bigint,size:bigint>,gap:double>>")))
    for _ in range(passes):
        found = _fill(ranked, p, tables)
        step = F.struct(F.col("p.last").alias("after"), F.col("f.last").alias("last"), F.col("gap"))
        p = p.alias("p").join(found.alias("f"), F.expr("p.source <=> f.source"), "left").select(
            "p.source", "source_size", "target", "level", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"), F.coalesce("f.last", "p.last").alias("last"),
            F.when(F.col("f.last").isNull(), F.col("steps")).otherwise(F.array_append("steps", step)).alias("steps"),
        )
        p = tables.keep(p)
    tables.drop(by_size, ranked)
    return p, rows, tables


#: Whether a row takes one copy more than its certain ones.
_AGAIN = "coalesce(exists(steps, s -> rank > s.after and rank <= s.last and size <= s.gap), false)"


def small(table: DataFrame, rows: int = 100_000, bytes_: int = 16 << 20) -> DataFrame:
    """A per-source table, broadcast only once it is counted to have at most so many rows and bytes in its sources' names."""
    name = table.columns[0]
    n, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(name))), F.lit(0))).first()
    return F.broadcast(table) if n <= rows and size <= bytes_ else table


def copies(docs: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """(source, id, size, source_size, target, copies) per row: how often the mix takes each whole document, 0 to `most`.

    Size is words; null texts have none, and rows without words are not taken. Ranks come from doc_id alone, so reruns
    agree. Rows with equal doc_id and size stand or fall together. A source of no words takes none; null is a source like
    any other, a null doc_id an id like any other; an empty table gives no rows.
    """
    p, rows, _ = plan(docs, weights, most)
    out = _drawn(rows.join(small(p).withColumnRenamed("source", "s").drop("last", "gap"), F.expr("source <=> s")), most)
    return out.select("source", F.nullif("id", F.lit(_NO_ID)).alias("id"), "size", "source_size", "target", F.expr(f"whole + cast({_AGAIN} as int)").alias("copies"))


def mix(docs: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it. The texts are not shuffled: sources' plans are joined to them."""
    p, _, _ = plan(docs, weights, most)
    p = small(p.select(F.col("source").alias("__mix_source"), "level", "steps"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__mix_row"), *[c.alias(n) for n, c in (("__mix_from", docs["source"]), ("id", F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID))), ("size", F.size(words_of(docs["text"])).cast("long")), ("u", _uniform(docs["doc_id"])))])
    out = _drawn(rows.join(p, F.expr("__mix_from <=> __mix_source")), most).withColumn("n", F.expr(f"whole + cast({_AGAIN} as int)")).where("n > 0")
    return out.select("__mix_row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("__mix_row.*")
