"""Which sets of entries contain which, by counting the entries they share.

Both sides are cut into (name, value) entries and meet entry by entry, an equi-
join; the count of a pair's shared entries against the sizes of its two sets
tells whether one holds the other. Sets without entries share none and are told
from one summary row a group. No pair is made that shares nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _entries(df: DataFrame, columns: list[str], entries: str) -> DataFrame:
    """A row an entry: ``_name, _value``; null values equal null values."""
    each = df.select(*columns, F.explode(F.map_entries(entries)).alias("_e"))
    value = F.when(F.col("_e.value").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("_e.value").cast("string")))
    return each.select(*columns, F.col("_e.key").alias("_name"), value.alias("_value"))


def _size(entries: str) -> Column:
    """The number of entries, -1 for null."""
    return F.when(F.col(entries).isNull(), F.lit(-1)).otherwise(F.size(entries))


def match_sets(rows: DataFrame, rules: DataFrame, props: str, wanted: str, order: str, key: list[str], kind: list[str]) -> DataFrame:
    """Each row with ``rule, outcome, n_full, n_half``: how rules of its kind match its ``props`` map.

    A rule matches in full if all its ``wanted`` entries are there, and by half
    if some are. ``rule`` is the first full one by ``order``; the outcome is
    ``full``, ``ambiguous`` for several full ones, ``half`` or ``none``. ``key``
    tells rows apart. A rule without entries is full for every row of its kind;
    null maps have and match nothing.
    """
    rules = rules.select(*kind, F.col(order).alias("_ord"), "rule", _size(wanted).alias("_n"), wanted)
    pairs = _entries(rows, [*key, *kind], props).join(_entries(rules, [*kind, "_ord", "rule", "_n"], wanted), [*kind, "_name", "_value"])
    shared = pairs.groupBy(*key, "_ord", "rule", "_n").agg(F.count(F.lit(1)).alias("_shared"))
    full = F.col("_shared") == F.col("_n")
    counted = shared.groupBy(*key).agg(F.min(F.when(full, F.struct("_ord", "rule"))).alias("_best"), F.count_if(full).alias("_full"), F.count_if(~full).alias("_half"))
    always = rules.where("_n = 0").groupBy(*kind).agg(F.min(F.struct("_ord", "rule")).alias("_first"), F.count(F.lit(1)).alias("_always"))
    out = rows.join(counted, key, "left").join(always, kind, "left")
    n_full = F.coalesce("_full", F.lit(0)) + F.coalesce("_always", F.lit(0))
    out = out.withColumns({"n_full": n_full, "n_half": F.coalesce("_half", F.lit(0)), "rule": F.least("_best", "_first")["rule"]})
    outcome = F.when(F.col("n_full") > 1, "ambiguous").when(F.col("n_full") == 1, "full").when(F.col("n_half") > 0, "half").otherwise("none")
    return out.select(rows["*"], "rule", outcome.alias("outcome"), "n_full", "n_half")


#: Arguments that tell an event on their own.
LINKS = ("uri", "intentName")


def match_events(handlers: DataFrame, candidates: DataFrame, case: str) -> DataFrame:
    """``handlers(case, handler, call, args map)`` with ``candidate, rule, n_fits, n_half`` from ``candidates(case, pos, call, args map)`` of the same case and call.

    A candidate fits if its arguments contain the handler's or are contained,
    or share a link or intent name. ``candidate`` is the place of an exact one
    (rule 0), else of the first that fits (1), else of the only one of that
    call (2). ``n_half`` counts those that share arguments and do not fit. Null
    arguments share and contain nothing. ``case`` and ``handler`` tell rows apart.
    """
    by = [case, "call"]
    n, m = F.col("_n"), F.col("_m")
    h = handlers.select(*by, "handler", _size("args").alias("_n"), "args")
    c = candidates.select(*by, "pos", _size("args").alias("_m"), "args")
    pairs = _entries(h, [*by, "handler", "_n"], "args").join(_entries(c, [*by, "pos", "_m"], "args"), [*by, "_name", "_value"])
    link = F.col("_name").isin(*LINKS) & (F.length("_value") > 1)
    shared = pairs.groupBy(*by, "handler", "_n", "pos", "_m").agg(F.count(F.lit(1)).alias("_shared"), F.max(link).alias("_linked"))
    in_one, in_other = F.col("_shared") == n, F.col("_shared") == m
    rank = F.when(in_one & in_other, 0).when(in_one | in_other | F.col("_linked"), 1)
    ranked = shared.withColumn("_rank", rank)
    counted = ranked.groupBy(*by, "handler").agg(
        F.min(F.when(F.col("_rank").isNotNull(), F.struct(F.col("_rank").alias("rule"), "pos"))).alias("_best"), F.count("_rank").alias("_fits"), F.count_if(F.col("_rank").isNull()).alias("_half")
    )
    # what needs no shared entry, by one row a case and call
    calls = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(m >= 0).alias("_told"), F.min("pos").alias("_any"), F.min(F.when(m >= 0, F.col("pos"))).alias("_first"),
        F.min(F.when(m == 0, F.col("pos"))).alias("_empty"), F.count_if(m == 0).alias("_empties"),
    )
    at = lambda rule, pos: F.when(F.col(pos).isNotNull(), F.struct(F.lit(rule).alias("rule"), F.col(pos).alias("pos")))
    both = h.drop("args").join(counted, [*by, "handler"], "left").join(calls, by, "left")
    alone = F.when(F.col("_all") == 1, at(2, "_any"))
    best = F.when(n == 0, F.least(at(0, "_empty"), at(1, "_first"), alone)).when(n > 0, F.least("_best", at(1, "_empty"), alone)).otherwise(alone)
    fits = F.when(n == 0, F.col("_told")).when(n > 0, F.coalesce("_fits", F.lit(0)) + F.col("_empties"))
    told = both.select(case, "handler", best.alias("_m"), F.coalesce(fits, F.lit(0)).alias("n_fits"), F.coalesce("_half", F.lit(0)).alias("n_half"))
    return handlers.join(told, [case, "handler"], "left").select(handlers["*"], F.col("_m.pos").alias("candidate"), F.col("_m.rule").alias("rule"), "n_fits", "n_half")
