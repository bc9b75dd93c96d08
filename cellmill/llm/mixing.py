"""Mixing sources to target weights, with DataFrame functions only.

The mix shall hold a share of all words, dealt to sources by weight. A source gives each document `epochs` times at most, so
its target stops at that many times its size; what it can't take is dealt to the others by their weights, until none is above. That level
is found in one pass: in the order of limit over weight, a source is full if its limit is not above its part of what is left
after all before it, and those that aren't full share the rest.

A target is met by whole repetitions, which every document gets, and a fractional one. For the fraction, documents of a source stand in a
seeded random order (a hash of seed and id) and are taken until the words are there; the last of them is taken in part, by its
first words, so a source meets its rounded target exactly. Where it ends is a threshold for each source, so documents are
neither sorted nor numbered: sums by source and slice of the hash (SLICES) name the slice in which a source ends, and only
documents of those slices (one in SLICES) are sorted. Documents of equal id and size at the threshold share its words evenly.

Edge cases: a null or empty text has size zero and is taken zero times; a null source is a source and comes last; a null id is hashed as
"-"; repeated rows are documents each and get the same decision; a source without words has target zero, one without a
positive weight too; if all limits together are below the share, every source is full; an empty table gives an empty result; other
columns are untouched, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmill.llm.common import cut, running_sums

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
EPOCHS = 2
SEED = 42
#: Hexadecimal digits of a hash that name its slice.
SLICE_DIGITS = 3
#: A plan of up to so many sources is broadcast; beyond, Spark joins by shuffle and splits hot sources.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: Column, seed: int = SEED) -> Column:
    """Where an id stands in the seeded order: 16 hexadecimal digits."""
    return F.substr(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("-")))), F.lit(1), F.lit(16))


def cycle_weights(sizes: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """sizes (source, size) with weight: the cycle's numbers in turn, for sources in the order of code points, null last."""
    ranked = running_sums(sizes, [], [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % len(cycle) + 1).cast("int"))).drop("rank")


def water_fill(sources: DataFrame, share: float, epochs: int = EPOCHS) -> DataFrame:
    """sources (source, size, weight: a whole number) with target, a double: `share` times all sizes dealt by weight, none above `epochs` times its size."""
    weighted = sources.select("source", "size", F.greatest(F.coalesce(F.col("weight").cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("weight"))
    sums = weighted.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    wanted, weights = share * (sums["size"] or 0), sums["weight"] or 0
    heavy = weighted.filter("weight > 0").withColumn("limit", F.col("size") * epochs).withColumn("ratio", F.col("limit") / F.col("weight"))
    in_order = running_sums(heavy, [], ["ratio", "source"], {"limits_before": F.col("limit"), "weights_before": F.col("weight")})
    full = F.col("limit") * (F.lit(weights) - F.col("weights_before")) <= (F.lit(wanted) - F.col("limits_before")) * F.col("weight")
    judged = cut(in_order.select("source", "size", "weight", "limit", full.alias("full")))
    done = judged.agg(F.sum(F.when(F.col("full"), F.col("limit"))).alias("limits"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weights")).first()
    level = (wanted - (done["limits"] or 0)) / done["weights"] if done["weights"] else 0.0
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.lit(level))
    filled = judged.select("source", "size", "weight", target.alias("target"))
    return filled.unionByName(weighted.filter("weight <= 0").withColumn("target", F.lit(0.0)))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def plan(sized: DataFrame, cycle: tuple[int, ...], share: float, epochs: int = EPOCHS) -> DataFrame:
    """How each source is taken. sized: id, source, size, draw. Returns of_source, source_size, weight, target, whole (repetitions that every
    document gets) and the threshold of the fractional one: end_draw, end_id, end_size and end_words, what documents
    just there get of it (null where there is no fraction)."""
    slices = cut(sized.groupBy("source", F.substr("draw", F.lit(1), F.lit(SLICE_DIGITS)).alias("slice")).agg(F.sum("size").alias("sum")))
    sizes = slices.groupBy("source").agg(F.sum("sum").alias("size"))
    filled = water_fill(cycle_weights(sizes, cycle), share, epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    taken = filled.select(F.col("source").alias("of_source"), F.col("size").alias("source_size"), "weight", "target", whole.alias("whole"))
    sources = cut(taken.withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))
    # a source has as many slices as SLICE_DIGITS allow, at most
    so_far = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = slices.withColumn("before", so_far).join(sources, _same("source", "of_source")).filter("before < extra AND extra <= before + sum")
    ends = cut(ends.select(F.col("of_source").alias("in_source"), F.col("slice").alias("in_slice"), (F.col("extra") - F.col("before")).alias("rest")))
    there = sized.withColumn("slice", F.substr("draw", F.lit(1), F.lit(SLICE_DIGITS))).join(ends, _same("source", "in_source") & (F.col("slice") == F.col("in_slice")))
    equal = there.groupBy("source", "draw", "id", "size", "rest").agg(F.count(F.lit(1)).alias("n")).withColumn("sum", F.col("size") * F.col("n"))
    ordered = running_sums(equal, ["source"], ["draw", "id", "size"], {"before": F.col("sum")})
    last = ordered.filter("before < rest AND rest <= before + sum").select(
        F.col("source").alias("in_source"), F.col("draw").alias("end_draw"), F.col("id").alias("end_id"), F.col("size").alias("end_size"),
        F.expr("(rest - before) div n").alias("end_words"),
    )
    return cut(sources.drop("extra").join(last, _same("of_source", "in_source"), "left").drop("in_source"))


def _extra(own: dict[str, Column]) -> Column:
    """Words of the fractional repetition that a document gets; own: its draw, id and size. In the order of draw, id (null first), size."""
    same_draw, same_id = own["draw"] == F.col("end_draw"), own["id"].eqNullSafe(F.col("end_id"))
    earlier_id = (own["id"].isNull() & F.col("end_id").isNotNull()) | F.coalesce(own["id"] < F.col("end_id"), F.lit(False))
    earlier = (own["draw"] < F.col("end_draw")) | (same_draw & (earlier_id | (same_id & (own["size"] < F.col("end_size")))))
    there = same_draw & same_id & (own["size"] == F.col("end_size"))
    return F.when(F.col("end_draw").isNull(), F.lit(0)).when(earlier, own["size"]).when(there, F.col("end_words")).otherwise(F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """id, source, size and draw of every row; settled, so that texts are read once."""
    return cut(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), words(docs[text_col]).alias("size"), draw(docs[id_col], seed).alias("draw")))


def _with_plan(rows: DataFrame, plans: DataFrame) -> DataFrame:
    small = plans.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(plans) if small else plans, _same("source", "of_source"))


def mix(docs: DataFrame, cycle: tuple[int, ...], share: float, epochs: int = EPOCHS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per row of docs: id_col, source, size, source_size, weight, target, whole (repetitions), extra (words of a further one), taken
    (words in all)."""
    rows = sized(docs, id_col, source_col, text_col, seed)
    own = {c: F.col(c) for c in ("draw", "id", "size")}
    planned = _with_plan(rows, plan(rows, cycle, share, epochs)).withColumn("extra", _extra(own))
    return planned.select(F.col("id").alias(id_col), "source", "size", "source_size", "weight", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def sample(docs: DataFrame, cycle: tuple[int, ...], share: float, epochs: int = EPOCHS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The mix itself: two columns, `doc` (a struct of the row as it was, the text of a repetition in part cut after its last word taken) and
    `repetition` (from 0). Documents that the mix doesn't take have no row."""
    plans = plan(sized(docs, id_col, source_col, text_col, seed), cycle, share, epochs)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[source_col].alias("source"), docs[id_col].alias("id"), words(docs[text_col]).alias("size"), draw(docs[id_col], seed).alias("draw"))
    own = {c: F.col(c) for c in ("draw", "id", "size")}
    planned = _with_plan(packed, plans).withColumn("extra", _extra(own)).filter("size > 0")
    times = (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")
    each = planned.filter(times > 0).withColumn("repetition", F.explode(F.sequence(F.lit(0), times - 1)))
    pieces = F.slice(F.regexp_extract_all(f"doc.`{text_col}`", F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), F.lit(1), F.col("extra").cast("int"))
    part = F.when((F.col("repetition") == F.col("whole")) & (F.col("extra") < F.col("size")), F.array_join(pieces, "")).otherwise(F.col(f"doc.`{text_col}`"))
    return each.select(F.col("doc").withField(f"`{text_col}`", part).alias("doc"), "repetition")
