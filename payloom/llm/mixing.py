"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

A document of a source whose target is r times its size gets r copies: floor(r) for certain and one more with
probability r - floor(r). The fractional parts are rounded together. Two documents with parts p and q meet: if p + q < 1
one of them, drawn in proportion, takes all and the other gets none; otherwise one is rounded up and the other keeps
p + q - 1. Either way one of the two becomes integral, expectations stay, and the sum does. Within a group the parts
are folded in order of size, so that mass moves between documents of similar size and words are conserved nearly; a
group leaves one residual, and residuals of groups meet in the next level of a reduction tree. The last residual of a
source is rounded by a draw of its own. Draws are hashes of the document, the level and the seed, so reruns agree.

Groups hold GROUP documents or so: those of a source and a size class whose hash falls together. How many groups a class
needs comes from counts, which are combined before their shuffle. Rows that are alike are counted first and then
numbered, and the number is part of the hash, so that no group grows with the input, whatever repeats in it; only the
number of levels does (with its logarithm).

Defined results: a null text has size 0; a null source is a source, the last one; a document of size 0 takes none;
repeated rows are documents each, with draws of their own; sources of equal names are one;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Cut

GROUP = 128
#: Rows that are alike and come from one row of their counts at a time.
REPEATS = 4096


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (source, words; a row each) with ``target``: ``share`` of all words by weight, where none exceeds
    ``most`` times its words and what it can't take is reshared among the others by weight.

    Sources get full in order of words per weight, so the level of the rest follows from running sums in that order. The
    windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sources.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("words") * F.lit(most)).withColumn("room", F.col("cap") / F.col("weight"))
    all_ = Window.partitionBy()
    x = x.withColumn("full", F.coalesce(F.sum("cap").over(by_room), F.lit(0.0))).withColumn("taken", F.coalesce(F.sum("weight").over(by_room), F.lit(0.0)))
    x = x.withColumn("level", (F.sum("words").over(all_) * F.lit(share) - F.col("full")) / (F.sum("weight").over(all_) - F.col("taken")))
    # A source is full if its cap per weight is at most the level that is left when all with less room are full.
    x = x.withColumn("is_full", F.col("room") <= F.col("level"))
    # That level is the one of the first source that isn't full.
    level = F.min(F.when(~F.col("is_full"), F.struct("room", "level"))).over(all_)["level"]
    return x.withColumn("target", F.when(F.col("is_full"), F.col("cap")).otherwise(F.col("weight") * level)).select("source", "words", F.coalesce("target", F.lit(0.0)).alias("target"))


def _draw(level: int, seed: int, *parts: str) -> Column:
    """A number in [0, 1) of the document, the level and the seed."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(p) for p in parts], F.lit(level), F.lit(seed)), 11) / F.lit(float(1 << 53))


def _fold(level: int) -> str:
    """Folds the sorted array ``docs`` of structs (size, draw, id, nth, part): the result's ``lost`` and ``won`` hold those
    rounded down and up, ``held`` and ``mass`` the one that is left and its part."""
    lost = "if({0}, array({1}), array())"
    doc = "struct(x.size as size, x.draw as draw, x.id as id, x.nth as nth)"
    sum_ = "(s.mass + x.part)"
    # Below 1 the new one takes all with probability part / sum; above, the new one is rounded up with probability (1 - mass) / (2 - sum).
    takes = f"(s.mass <= 0 or ({sum_} < 1 and x.draw * {sum_} < x.part))"
    up = f"({sum_} >= 1 and s.mass > 0)"
    new_up = f"({up} and x.draw * (2 - {sum_}) < (1 - s.mass))"
    none = "cast(array() as array<struct<size:bigint,draw:double,id:bigint,nth:bigint>>)"
    return f"""aggregate(docs, struct({none} as lost, {none} as won, cast(null as struct<size:bigint,draw:double,id:bigint,nth:bigint>) as held, cast(0 as double) as mass), (s, x) -> case
        when s.held is null then struct(s.lost as lost, s.won as won, {doc} as held, x.part as mass)
        when {new_up} then struct(s.lost as lost, concat(s.won, array({doc})) as won, s.held as held, {sum_} - 1 as mass)
        when {up} then struct(s.lost as lost, concat(s.won, array(s.held)) as won, {doc} as held, {sum_} - 1 as mass)
        when {takes} then struct(concat(s.lost, array(s.held)) as lost, s.won as won, {doc} as held, {sum_} as mass)
        else struct(concat(s.lost, array({doc})) as lost, s.won as won, s.held as held, {sum_} as mass) end)"""


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``, which tells rows that are alike apart. Many of them are made in stretches, dealt to many tasks."""
    names = rows.columns
    counts = Cut(rows.groupBy(*names).agg(F.count("*").alias("__n")), "counts").df
    many = counts.where(F.col("__n") > REPEATS).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(REPEATS).cast("long"))))
    many = many.repartition(*names, "__from").select(*names, "__from", F.least(F.col("__n"), F.col("__from") + REPEATS).alias("__end"))
    few = counts.where(F.col("__n") <= REPEATS).select(*names, F.lit(0).cast("long").alias("__from"), F.col("__n").alias("__end"))
    return few.unionByName(many).select(*names, F.explode(F.sequence(F.col("__from"), F.col("__end") - 1)).alias("nth"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (= copies times size) for each row of ``docs``."""
    rows = _numbered(docs.select(F.col(id_col).cast("long").alias("id"), "source", word_count("text").alias("size")))
    rows = Cut(rows, "sizes").df
    bins = F.when(F.col("size") > 0, (F.log2("size") * 4).cast("int")).otherwise(-1)
    rows = rows.withColumn("bin", bins)
    by_bin = Cut(rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "bins").df
    goals = Cut(targets(by_bin.groupBy("source").agg(F.sum("words").alias("words")), weights, share, most), "targets").df
    goals = goals.withColumn("number", F.xxhash64("source", F.col("source").isNull()))
    ways = by_bin.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.ceil(F.col("docs") / GROUP).alias("ways"))
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    x = rows.join(ways, rows["source"].eqNullSafe(F.col("s")) & (rows["bin"] == F.col("b"))).drop("s", "b")
    x = x.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    x = x.withColumn("rate", F.least(rate, F.lit(most))).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate"))
    spread = F.pmod(F.xxhash64("id", "size", "nth", F.lit(seed)), F.col("ways"))
    settled = [x.where("size = 0 or part = 0").select("number", "id", "size", "nth", F.lit(0).alias("up"))]

    now = x.where("size > 0 and part > 0").select("number", "bin", spread.alias("slot"), "id", "size", "nth", "part")
    depth = by_bin.agg(F.max("docs")).first()[0] or 0
    level, groups = 0, max(1, -(-depth // GROUP))
    while True:
        key = ["number", "bin", "slot"] if level < 100 else ["number"]
        draw = _draw(level, seed, "id", "size", "nth")
        docs_ = F.sort_array(F.collect_list(F.struct("size", draw.alias("draw"), "id", "nth", "part"))).alias("docs")
        folded = now.groupBy(*key).agg(docs_).select(*key, F.expr(_fold(level)).alias("f"))
        folded = Cut(folded, f"level{level}").df
        for name, up in (("lost", 0), ("won", 1)):
            settled.append(folded.select("number", F.explode(f"f.{name}").alias("d")).select("number", "d.id", "d.size", "d.nth", F.lit(up).alias("up")))
        left = folded.select(*key, "f.held.id", "f.held.size", "f.held.nth", F.col("f.mass").alias("part"))
        if level == 100:
            break
        if groups > 1:
            now = left.withColumn("slot", F.floor(F.col("slot") / GROUP))
            groups, level = -(-groups // GROUP), level + 1
        else:  # one group a size class is left: the classes of a source, of which there are a hundred at most, meet
            now, level = left, 100
    # What remains of a source is rounded by itself.
    settled.append(left.select("number", "id", "size", "nth", (_draw(101, seed, "id", "size", "nth") < F.col("part")).cast("int").alias("up")))
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    goals = goals.select("number", F.col("words").alias("source_size"), "target", F.floor(F.least(rate, F.lit(most))).alias("whole"))
    out = done.join(goals, "number").withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("up")).otherwise(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
