"""Mixing sources to target weights by Pareto order sampling.

A source's target is a share of the words to take.  Where it exceeds the source's
own size, every document first gets whole copies with certainty; the rest of the
target is a sample without replacement.  Pareto sampling ranks a source's
documents by (u / (1 - u)) / (p / (1 - p)), the odds of a random number over the
odds of the document's inclusion, and takes the smallest: a sample of fixed size
with the wanted inclusion probabilities.  Size here is words, so the ranking is
taken up to the document that would pass the rest of the target; the words that are
still missing come from at most ``FILL`` documents behind it that fit, and from one
more that passes the target if the sum ends nearer to it.

The random number is a hash of the document's id, of its text, and of its running
number among rows where both are equal, so reruns agree and no rows move as a block.
The cut is found without sorting or gathering a source: words are summed by digits of
the rank key (``FANOUT`` bins of a source, then bins of the one bin that holds the
cut, and so on), and only the few documents of the last bin are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import count_words, free_names, keep

WEIGHTS = (5, 2, 1)
SHARE, MOST_COPIES = 1.5, 2
#: bins of one level of the search for the cut, and levels
FANOUT, LEVELS = 1024, 3
#: hexadecimal digits of the hash that make the random number
DIGITS = 13
#: documents behind the cut that may fill up a source
FILL = 6
#: sources, or keys of repeated rows, up to which they are broadcast to the documents
BROADCAST_SOURCES, BROADCAST_KEYS = 10_000, 50_000


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``sized`` (source, size) -> a row per source: source, source_size, target.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; a target stops at ``most`` times its source's size
    and the excess goes to the others by weight.  That is target = least(most x size,
    weight x level) for the one level at which the targets have the wanted sum: sources
    fill up in order of size by weight, so the level follows from running sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source from here on
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = keep(per.select("source", "source_size", F.array(*map(F.lit, weights))[turn].cast("double").alias("weight")))
    cap = most * F.col("source_size").cast("double")
    fill = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    full = fill.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    wanted = share * F.sum("source_size").over(every).cast("double")
    # if all before it are full and this one isn't, it gets weight x level
    level = (wanted - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = per.select("source", "source_size", "weight", cap.alias("cap"), level.alias("level"),
                        F.row_number().over(fill).alias("at"))
    first = ranked.where(F.col("weight") * F.col("level") <= F.col("cap")).agg(F.min_by("level", "at").alias("final"))
    # no such source: all are full
    return ranked.crossJoin(first).select(  # one row
        "source", "source_size",
        F.coalesce(F.least("cap", F.col("weight") * F.col("final")), F.col("cap")).alias("target"))


def text_key(text: Column) -> Column:
    """A null text is an empty one."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def rank(doc_id: Column, key: Column, nth: Column, p: Column, priority: Column) -> Column:
    """The Pareto rank, mapped to (0, 1): odds of the row's random number over its odds of
    inclusion, which ``priority`` multiplies.  ``nth``: the row's number among equal ones."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), key, nth.cast("string"))
    u = (F.conv(F.substring(F.md5(name), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16 ** DIGITS)
    odds = (u / (1 - u)) / (priority * (p / (1 - p)))
    return odds / (1 + odds)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


ROW = ("source", "doc_id", "key")


def repeated(rows: DataFrame) -> DataFrame:
    """Distinct ``ROW`` of ``rows`` that several rows have, marked for broadcast if they are few."""
    again = keep(rows.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        *(F.col(c).alias(f"r_{c}") for c in ROW)))
    return F.broadcast(again) if again.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else again


def _is_repeated(again: DataFrame, source, doc_id, key) -> Column:
    return _same(source, again["r_source"]) & _same(doc_id, again["r_doc_id"]) & (key == again["r_key"])


def numbered(kept: DataFrame) -> DataFrame:
    """``kept`` (a kept frame of repeated rows) with ``nth``, from 0 among rows of equal ``ROW``.

    A row's number is its place in its partition and the equal rows of the partitions
    before; windows run over the equal rows of one partition, or over a row a partition.
    """
    at, part = free_names(kept, "mix_at", "mix_part")
    rows = kept.withColumns({at: F.monotonically_increasing_id(), part: F.spark_partition_id()})
    each = rows.groupBy(*ROW, part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*ROW).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(*(F.col(c).alias(f"o_{c}") for c in ROW), F.col(part).alias("o_part"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o_n"))
    local = F.row_number().over(Window.partitionBy(*ROW, part).orderBy(at)) - 1
    own = rows.withColumn("nth", local)
    both = own.join(offsets, _same(F.col("source"), F.col("o_source")) & _same(F.col("doc_id"), F.col("o_doc_id"))
                    & (F.col("key") == F.col("o_key")) & (F.col(part) == F.col("o_part")))
    return both.withColumn("nth", (F.col("nth") + F.col("o_n")).cast("long")).select(*kept.columns, "nth")


def cuts(ranked: DataFrame) -> DataFrame:
    """``ranked`` (source, doc_id, key, nth, size, z, rest) -> a row per source with a rest:
    source, cut (rank of the first row that would pass the rest), gap (words still missing there).

    Rows of one rank stand together.
    """
    part = ranked.where(F.col("rest") > 0).select("source", "size", "z", "rest", F.lit(0).cast("long").alias("below"), F.col("z").alias("digits"))
    for _ in range(LEVELS):
        part = part.withColumn("bin", F.least(F.floor(F.col("digits") * FANOUT), F.lit(FANOUT - 1)).cast("long"))
        bins = part.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"),
                                                 F.first("below").alias("below"))
        running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # FANOUT rows
        reach = bins.withColumn("upto", F.col("below") + F.sum("words").over(running)).where("upto > rest")
        hit = reach.groupBy(F.col("source").alias("s")).agg(
            F.min("bin").alias("b"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("start"))
        part = keep(part.join(hit, _same(F.col("source"), F.col("s")) & (F.col("bin") == F.col("b"))).select(
            "source", "size", "z", "rest", F.col("start").alias("below"), (F.col("digits") * FANOUT - F.col("bin")).alias("digits")))
    order = Window.partitionBy("source").orderBy("z")  # of the last bin
    upto = F.col("below") + F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("size").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    ends = part.select("source", "z", "rest", upto.alias("upto"), own.alias("own")).where("upto > rest")
    first = ends.groupBy("source").agg(F.min_by(F.struct("z", "rest", "upto", "own"), "z").alias("c"))
    return first.select("source", F.col("c.z").alias("cut"), (F.col("c.rest") - (F.col("c.upto") - F.col("c.own"))).alias("gap"))


def fill(ranked: DataFrame, cut: DataFrame) -> DataFrame:
    """A row per source of ``cut``: source, cut, more (the rows behind the cut that are taken too).

    The largest that fits the gap, then the largest that fits what is left, ``FILL`` times;
    at last the smallest that doesn't fit, if the sum ends nearer with it.  Ties go to the
    lower rank.  A step is a maximum over the rows of each source.
    """
    behind = ranked.select("source", "doc_id", "key", "nth", "size", "z").where("size > 0")
    plan = keep(cut.select("source", "cut", "gap", F.array().cast(
        "array<struct<doc_id:" + ranked.schema["doc_id"].dataType.simpleString() + ",key:string,nth:bigint>>").alias("more")))
    for step in range(FILL + 1):
        state = plan.select(F.col("source").alias("s"), "cut", "gap", "more")
        row = F.struct("doc_id", "key", "nth")
        fits = F.col("size") <= F.col("gap") if step < FILL else (F.col("size") > F.col("gap")) & (F.col("size") < 2 * F.col("gap"))
        free = behind.join(F.broadcast(state) if plan.count() <= BROADCAST_SOURCES else state, _same(F.col("source"), F.col("s"))).where(
            (F.col("z") >= F.col("cut")) & fits & ~F.array_contains(F.col("more"), row))
        wanted = F.struct((F.col("size") if step < FILL else -F.col("size")).alias("a"), (-F.col("z")).alias("b"))
        pick = free.groupBy("source").agg(F.max_by(F.struct("size", row.alias("row")), F.struct(wanted.alias("w"), "key", "nth")).alias("pick"))
        found = state.join(pick, _same(F.col("s"), F.col("source")), "left").drop("source")
        plan = keep(found.select(F.col("s").alias("source"), "cut", (F.col("gap") - F.coalesce("pick.size", F.lit(0))).alias("gap"), F.when(
            F.col("pick").isNull(), F.col("more")).otherwise(F.concat("more", F.array("pick.row"))).alias("more")))
    return plan.drop("gap")


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, priority=None,
             id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, plan, repeated): a row per row of ``docs`` with doc_id, source, key, nth, size,
    priority; a row per source with source_size, target, whole copies, p, the cut and more;
    the keys of repeated rows."""
    text = F.col(text_col)
    sized = keep(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_key(text).alias("key"), count_words(text).alias("size"),
        (F.lit(1.0) if priority is None else priority).cast("double").alias("priority")))
    again = repeated(sized)
    here = _is_repeated(again, sized["source"], sized["doc_id"], sized["key"])
    single = sized.join(again, here, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    sized = keep(single.unionByName(numbered(keep(sized.join(again, here, "left_semi")))))
    per = source_targets(sized, weights, share, most)
    size = F.col("source_size").cast("double")
    ratio = F.when(size > 0, F.col("target") / size).otherwise(0.0)
    per = per.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.col("whole")).withColumn(
        "rest", F.col("target") - F.col("whole") * size)
    per = keep(per)
    slim = per.select(F.col("source").alias("s"), "p", "rest").where("p > 0")
    slim = F.broadcast(slim) if per.count() <= BROADCAST_SOURCES else slim
    ranked = keep(sized.join(slim, _same(F.col("source"), F.col("s"))).select(
        "source", "doc_id", "key", "nth", "size", "rest", rank(F.col("doc_id"), F.col("key"), F.col("nth"), F.col("p"), F.col("priority")).alias("z")))
    cut = fill(ranked, cuts(ranked)).withColumnRenamed("source", "s")
    return sized, keep(per.join(cut, _same(F.col("source"), F.col("s")), "left").drop("s")), again


def _copies(doc_id: Column, key: Column, nth: Column, priority: Column, plan) -> Column:
    """Copies of a row that the plan of its source takes; ``plan(c)``: its columns."""
    row = F.struct(doc_id.alias("doc_id"), key.alias("key"), nth.alias("nth"))
    z = rank(doc_id, key, nth, plan("p"), priority)
    sampled = F.when(plan("p") > 0, F.when(plan("cut").isNull(), True).otherwise(
        (z < plan("cut")) | F.array_contains(plan("more"), row))).otherwise(False)
    return plan("whole") + sampled.cast("long")


def mix_report(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, priority=None,
               id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, size, source_size, target, taken (words that
    the mix takes of it, repeats counted).

    Null and empty texts have size 0 and take nothing; a null source is a source, the
    last one.  Rows that share an id, null or not, are taken each for itself; those that
    share the text too are numbered.  Other columns are not read.  An empty table has no
    rows.
    """
    sized, plan, _ = plan_mix(docs, weights, share, most, priority, id_col, source_col, text_col)
    few = plan.count() <= BROADCAST_SOURCES
    plan = plan.withColumnRenamed("source", "s")
    both = sized.join(F.broadcast(plan) if few else plan, _same(F.col("source"), F.col("s")))
    copies = _copies(F.col("doc_id"), F.col("key"), F.col("nth"), F.col("priority"), F.col)
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, priority=None,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all its columns as they were.

    Nulls, repeated rows and empty tables as in ``mix_report``; a row of size 0 has the whole
    copies of its source.  Rows that repeat id, source and text are kept once, to be numbered.
    """
    _, plan, again = plan_mix(docs, weights, share, most, priority, id_col, source_col, text_col)
    (name, at, key, nth) = free_names(docs, "mix_plan", "mix_copy", "mix_key", "mix_nth")
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    here = _is_repeated(again, keyed[source_col], keyed[id_col], keyed[key])
    single = keyed.join(again, here, "left_anti").withColumn(nth, F.lit(0).cast("long"))
    held = keep(keyed.join(again, here, "left_semi").select(
        F.struct(*docs.columns).alias("whole"), F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), F.col(key).alias("key")))
    double = numbered(held).select("whole.*", F.col("key").alias(key), F.col("nth").alias(nth))
    packed = plan.select(F.struct("source", "whole", "p", "cut", "more").alias(name))
    if plan.count() <= BROADCAST_SOURCES:
        packed = F.broadcast(packed)
    both = single.unionByName(double).join(packed, _same(F.col(source_col), F.col(name)["source"]))
    weight = (F.lit(1.0) if priority is None else priority).cast("double")
    copies = _copies(F.col(id_col), F.col(key), F.col(nth), weight, lambda c: F.col(name)[c])
    some = both.withColumn(at, copies).where(F.col(at) > 0)
    return some.withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(at)))).select(*docs.columns)
