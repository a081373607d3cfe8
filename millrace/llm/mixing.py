"""Mixing sources to target weights along a time-varying curriculum, all in DataFrame operations.

Every source has a weight schedule over training time t in [0, 1], a straight
line from its opening to its closing weight, scaled so that its integral is the
source's target in words. The integral is the source's cumulative demand; the
document occurrence that starts at cumulative word c of its source's stream is
trained at the t where the demand reaches c. Ordering all occurrences by t is
the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fresh, pin, row_key

#: Weights by the source's rank, repeating, and the most passes over a source.
WEIGHTS, MAX_EPOCHS = (1.0, 2.0, 3.0), 3
#: Opening and closing weight of a schedule relative to its mean, by the same rank.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SEED = 17
#: Documents of one (source, slice) that a window orders; the number of slices follows the input.
SLICE_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls that sorts like the source by code point, null last."""
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def order_key(doc_id: Column, seed: int) -> Column:
    """60 bits that order a source's stream: the head of md5 of the seed and the id."""
    told = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, size)``, source by ``source_key`` → a row per source: ``source, source_size, rank, weight, target``.

    Shares of all words follow the weights; a target stops at ``max_epochs``
    times its source, and the excess goes to the others by weight until none is
    above. That is one water level: sorted by cap per weight, a source is capped
    exactly if the level reached with those before it capped is at or over its
    own ratio. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").cast("binary"))) - 1
    per = per.withColumn("rank", rank).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    cap = F.col("source_size") * F.lit(float(max_epochs))
    everyone = Window.partitionBy()
    before = Window.orderBy(F.col("ratio"), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.col("caps_before")) / F.col("weights_left")
    out = (
        per.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everyone).cast("double"))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", level)
        .withColumn("capped", F.col("ratio") <= F.col("level"))
    )
    # the level that holds is the one of the first uncapped source
    free_level = F.min(F.when(~F.col("capped"), F.struct("ratio", "rank", "level"))).over(everyone)["level"]
    target = F.when(F.col("capped") | free_level.isNull(), F.col("cap")).otherwise(F.col("weight") * free_level)
    return out.withColumn("target", F.round(target, 6)).select("source", "source_size", "rank", "weight", "target")


def demand_time(words: Column, target: Column, opening: Column, closing: Column) -> Column:
    """The t at which a linear schedule with integral ``target`` has asked for ``words``: inverts
    target * (opening * t + (closing - opening) * t**2 / 2)."""
    share, slope = words / target, closing - opening
    root = F.sqrt(F.greatest(opening * opening + 2 * slope * share, F.lit(0.0)))
    return F.when(target <= 0, F.lit(0.0)).otherwise(2 * share / (opening + root))


def _ramp(ramps, i: int, rank: Column | None = None) -> Column:
    """The opening (0) or closing (1) weight of the schedule of a source's rank."""
    rank = F.col("rank") if rank is None else rank
    return F.element_at(F.array(*(F.lit(float(r[i])) for r in ramps)), (rank % len(ramps) + 1).cast("int"))


def own_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of text and source, which tell rows with one doc_id apart."""
    return row_key(F.concat_ws("\0", source_key(F.col("source")), F.col("text").isNotNull().cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))))


def mix_documents(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, ramps=RAMPS, max_epochs: int = MAX_EPOCHS, keyed: bool = False) -> DataFrame:
    """One row per row of ``docs``, range-sorted by training position.

    ``doc_id, size, source_size, target, taken, position``: a source's stream
    runs over its documents in seeded hash order, as often as its target asks;
    ``taken`` is what the stream takes of the document, whole passes plus what
    the last, partial pass reaches, so a source takes its target to the word.
    ``position`` is the t of the first occurrence (null if nothing is taken).
    Null text: size 0; null source: a source, ranked last; null doc_id and ties
    in the order: by size; rows alike in all of these are interchangeable.
    ``keyed`` adds ``k1, k2`` of ``own_keys``, which then break such ties. No
    rows give no rows. Prefix sums go through hash slices, so a source that
    holds most rows is spread like any other.
    """
    keys = ["k1", "k2"] if keyed else []
    own = [k.alias(n) for k, n in zip(own_keys(docs), keys)]
    slim = pin(docs.select("doc_id", source_key(F.col("source")).alias("source"), word_count(F.col("text")).alias("size"), *own))
    slices = 256
    rows = slim.count()
    while slices < 65536 and rows / slices > SLICE_ROWS:
        slices *= 2
    targets = pin(source_targets(slim, weights, max_epochs))
    cut = slim.withColumn("key", order_key(F.col("doc_id"), seed)).withColumn("slice", F.shiftright("key", 60 - slices.bit_length() + 1))
    per_slice = cut.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.withColumn("slice_at", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0))).drop("slice_size")
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, ["source", "slice"]).withColumn("at", F.col("at") + F.col("slice_at"))
    joined = placed.join(targets, "source").withColumn("whole", F.floor("target").cast("long"))
    passes = F.when(F.col("source_size") > 0, F.expr("whole div source_size")).otherwise(F.lit(0))
    joined = joined.withColumn("passes", passes).withColumn("rest", F.col("whole") - F.col("passes") * F.col("source_size"))
    partial = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("at")))
    taken = (F.col("passes") * F.col("size") + partial).cast("long")
    joined = joined.withColumn("taken", taken).withColumn(
        "position", F.when(F.col("taken") > 0, F.round(demand_time(F.col("at").cast("double"), F.col("target"), _ramp(ramps, 0), _ramp(ramps, 1)), 6))
    )
    return joined.select("doc_id", "size", "source_size", "target", "taken", "position", "at", "rank", *keys).orderBy(
        F.col("position").asc_nulls_last(), "rank", "at", "doc_id"
    )


def mix_corpus(docs: DataFrame, ramps=RAMPS, **options) -> DataFrame:
    """``docs`` as the mix trains them: each document as often as the mix takes it, a started pass as a whole one.

    Every occurrence has a training position of its own: pass k over a source
    starts k source sizes further on in its stream, and the demand is inverted
    there. Occurrences are range-sorted by that position. A document of which
    nothing is taken goes, unless it has no words: such documents stay, first.
    Null text: no words; null source: a source, ranked last. Rows that share a
    doc_id, null too, have verdicts of their own by text and source; rows alike
    in all three share one, the most that is taken of one of them. No rows give
    no rows.
    """
    names = fresh(docs, "mix_id", "mix_k1", "mix_k2", "mix_own_k1", "mix_own_k2", "mix_times", "mix_start", "mix_pass", "mix_position")
    key, k1, k2, own1, own2, times, start, turn, place = names
    occurrences = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    stream = F.struct("position", "at", "rank", "source_size", "target")
    mixed = mix_documents(docs, ramps=ramps, keyed=True, **options).select(
        F.col("doc_id").alias(key), F.col("k1").alias(k1), F.col("k2").alias(k2), stream.alias(start), occurrences.alias(times)
    )
    chosen = mixed.where(F.col(times) > 0).groupBy(key, k1, k2).agg(F.max(times).alias(times), F.min(start).alias(start))
    whose = docs.withColumns(dict(zip((own1, own2), own_keys(docs))))
    out = whose.join(chosen, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own1) == F.col(k1)) & (F.col(own2) == F.col(k2)))
    of = lambda name: F.col(start)[name]
    words = of("at") + (F.col(turn) - 1) * of("source_size")
    position = demand_time(words.cast("double"), of("target"), _ramp(ramps, 0, of("rank")), _ramp(ramps, 1, of("rank")))
    order = F.col(place).asc_nulls_first()
    return (
        out.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times))))
        .withColumn(place, F.when(of("position").isNotNull(), position))
        .repartitionByRange(order)
        .sortWithinPartitions(order, of("rank"), words)
        .select(docs.columns)
    )
