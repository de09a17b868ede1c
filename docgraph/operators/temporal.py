"""Which version of a law holds on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.legal import AMENDS, CHANGE_PREDICATES, REPEALS, law_number, parse_date
from docgraph.functions.text import predicate


def effective_date(columns: list[str], law) -> Column:
    """The first readable date of some columns, else the first of January of the law's year."""
    return F.coalesce(*[parse_date(F.col(c)) for c in columns], F.try_to_date(F.concat(F.regexp_extract(law, r"^(\d{1,4})/(\d{4})", 2), F.lit("-01-01")), "yyyy-MM-dd"))


def version_index(triples: DataFrame) -> DataFrame:
    """(law, kind, by_law, day, uid) of each triple (uid, subject, predicate, object, law, quote, article) that amends or repeals a law."""
    p = predicate(F.col("predicate"), "")
    day = effective_date(["quote", "article", "object", "subject"], F.col("law"))
    kind = F.when(p.isin(AMENDS), "amended").when(p.isin(REPEALS), "repealed")
    by_law = F.coalesce(law_number(F.col("subject")), F.nullif(F.trim("law"), F.lit("")))
    out = triples.select(law_number(F.col("object")).alias("law"), kind.alias("kind"), F.replace(by_law, F.lit(" ")).alias("by_law"), day.alias("day"), "uid")
    return out.where("law is not null and kind is not null and by_law is not null")


def status(index: DataFrame, day) -> DataFrame:
    """(law, is_repealed, repealed_by, repealed_on, amended_by, amended_on): the earliest repeal by then, else the latest
    amendment. An undated change counts as having happened, before all dated ones."""
    when = F.coalesce("day", F.lit("0001-01-01").cast("date"))
    known = index.where(F.col("day").isNull() | (F.col("day") <= day))
    first = F.min(F.when(F.col("kind") == "repealed", F.struct(when.alias("at"), "uid", "by_law", "day"))).alias("r")
    last = F.max(F.when(F.col("kind") == "amended", F.struct(when.alias("at"), "uid", "by_law", "day"))).alias("a")
    s = known.groupBy("law").agg(first, last)
    free = F.col("r").isNull()
    return s.select("law", F.col("r").isNotNull().alias("is_repealed"), F.col("r.by_law").alias("repealed_by"), F.col("r.day").alias("repealed_on"), F.when(free, F.col("a.by_law")).alias("amended_by"), F.when(free, F.col("a.day")).alias("amended_on"))


def status_on(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (law, on, ...) with the law's state on the row's own day: is_repealed, repealed_by, repealed_on, amended_by,
    amended_on, as `status` defines them.

    One merge for all days: changes are first reduced to the earliest repeal and the latest amendment of each (law, day), the
    questions to their distinct (law, day), both are united in the order of days and the state is carried forward. So a law
    has a row a day at most in that order, however many changes and questions name it, and no change is paired with days. The
    states go back to the questions by equality. A law without changes is not repealed; a null law or day has no known state
    (is_repealed null). Repeated rows of asked stay.
    """
    never = F.lit("0001-01-01").cast("date")
    entry = F.struct(F.coalesce("day", never).alias("at"), "uid", "by_law", "day")
    first = F.min(F.when(F.col("kind") == "repealed", entry)).alias("r")
    last = F.max(F.when(F.col("kind") == "amended", entry)).alias("a")
    changes = index.where("law is not null").groupBy("law", F.coalesce("day", never).alias("on")).agg(first, last).withColumn("asked", F.lit(False))
    days = asked.where("law is not null and on is not null").select("law", "on").distinct().withColumn("asked", F.lit(True))
    so_far = Window.partitionBy("law").orderBy("on").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    states = changes.unionByName(days, allowMissingColumns=True).withColumn("r", F.min("r").over(so_far)).withColumn("a", F.max("a").over(so_far)).where("asked")
    free = F.col("r").isNull()
    amended = [F.when(free, F.col(f"a.{x}")).alias(y) for x, y in (("by_law", "amended_by"), ("day", "amended_on"))]
    states = states.select(F.col("law").alias("__law"), F.col("on").alias("__on"), F.col("r").isNotNull().alias("is_repealed"), F.col("r.by_law").alias("repealed_by"), F.col("r.day").alias("repealed_on"), *amended)
    return asked.join(states, (F.col("law") == F.col("__law")) & (F.col("on") == F.col("__on")), "left").drop("__law", "__on")


def weigh(chunks: DataFrame, state: DataFrame, step: float = 0.10) -> DataFrame:
    """chunks (law, predicate, subject_type, object_type, score, ...) with kept and weighted: repealed laws' chunks go unless they
    tell of a change, and repealed ones lose `step`, amended ones gain it. Chunks without a law stay as they are."""
    kinds = ["LawAmendment", "LawModification", "LawAddition", "LawDeletion"]
    tells = predicate(F.col("predicate"), "").isin(CHANGE_PREDICATES) | F.coalesce(F.col("subject_type").isin(kinds), F.lit(False)) | F.coalesce(F.col("object_type").isin(kinds), F.lit(False))
    c = chunks.join(state.select("law", "is_repealed", "amended_by"), "law", "left")
    gone = F.coalesce("is_repealed", F.lit(False))
    weighted = F.col("score") + F.when(gone, -step).when(F.col("amended_by").isNotNull(), step).otherwise(0.0)
    return c.withColumn("kept", ~gone | tells).withColumn("weighted", F.round(weighted, 6)).drop("is_repealed", "amended_by")


def lineage(state: DataFrame) -> DataFrame:
    """(law, line): a sentence on each law's state."""
    on = lambda c: F.coalesce(F.date_format(c, "dd-MM-yyyy"), F.lit("tanggal tidak jelas"))
    head = F.concat(F.lit("UU "), "law")
    line = (
        F.when(F.col("is_repealed"), F.concat(head, F.lit(" telah dicabut oleh UU "), "repealed_by", F.lit(" (efektif "), on("repealed_on"), F.lit(").")))
        .when(F.col("amended_by").isNotNull(), F.concat(head, F.lit(" (versi berlaku) terakhir diubah oleh UU "), "amended_by", F.lit(" (efektif "), on("amended_on"), F.lit(").")))
        .otherwise(F.concat(head, F.lit(" (tidak terdeteksi perubahan atau pencabutan hingga tanggal acuan).")))
    )
    return state.select("law", line.alias("line"))


def operative(chunks: DataFrame, state: DataFrame, k: int = 3) -> DataFrame:
    """(law, chunk_id, kind): of an unchanged law its first k chunks (law, chunk_id, seq, score), of an amended one the k best
    of the amending law. A repealed law has none."""
    plain = chunks.join(state.where("is_repealed or amended_by is not null").select("law"), "law", "left_anti")
    first = plain.withColumn("n", F.row_number().over(Window.partitionBy("law").orderBy("seq", "chunk_id"))).withColumn("kind", F.lit("operative"))
    by = state.where("amended_by is not null").select(F.col("law").alias("amended"), F.col("amended_by").alias("law"))
    best = chunks.join(by, "law").drop("law").withColumnRenamed("amended", "law").withColumn("n", F.row_number().over(Window.partitionBy("law").orderBy(F.desc("score"), "chunk_id"))).withColumn("kind", F.lit("amending"))
    return first.unionByName(best).where(F.col("n") <= k).select("law", "chunk_id", "kind")


def change_notes(edges: DataFrame) -> DataFrame:
    """(source, note): per law its changes (seq, source, relationship, target), kinds and targets in the order first seen."""
    seen = edges.groupBy("source", "relationship", "target").agg(F.min("seq").alias("seq"))
    name = lambda c: F.concat(F.lit("UU No. "), F.replace(c, F.lit("_"), F.lit(" Tahun ")))
    listed = lambda c, mark: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c.alias("x")))), lambda s: s["x"]), mark)
    kinds = seen.groupBy("source", "relationship").agg(F.min("seq").alias("at"), listed(name(F.col("target")), ", ").alias("targets")).withColumnRenamed("at", "seq")
    line = F.concat(F.replace("relationship", F.lit("_"), F.lit(" ")), F.lit(" "), F.col("targets"))
    return kinds.groupBy("source").agg(listed(line, "; ").alias("notes")).select("source", F.concat(name(F.col("source")), F.lit(" telah "), "notes").alias("note"))
