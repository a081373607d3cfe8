"""How the sources of a language differ in their words: triangular divergences of smoothed term shares.

Terms are counted by DuckDB where the texts are, a bounded block at a time,
and meet in shards by a hash of language and term. A shard sums its counts and
keeps the terms that enough documents have; once the totals are known it sums,
in SQL over its own terms, what they add to each pair of sources, and ranks its
own terms. Spark merges the shards' sums and rankings. All numbers are integers.

A term that neither of two sources has adds the same to their pair whichever it
is, and one that only one has adds what its count there says. So shards sum
terms that both have, and count how often a source has a term so many times;
the rest follows from these, and no source is paired with terms it has not.
"""

from __future__ import annotations

import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pin

#: Documents of a language that must have a term.
LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Fixed: what is no part of a term.
TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Code points of text that one counting query takes, and rows after which counts are merged or handed on.
BLOCK_CHARS, MERGE_ROWS = 4_000_000, 400_000

_COUNT = f"""
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS d FROM (
  SELECT row, any_value(lang) AS lang, any_value(source) AS source, term, count(*) AS n FROM (
    SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM_PATTERN}')) AS term FROM given)
  GROUP BY row, term)
GROUP BY lang, source, term"""
_MERGE = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS d FROM counts GROUP BY lang, source, term"
#: ``leads`` marks one row of each term.
_KEEP = """
SELECT lang, source, term, n, source = min(source) OVER (PARTITION BY lang, term) AS leads FROM counts
QUALIFY sum(d) OVER (PARTITION BY lang, term) >= {least}"""
_SHARE = f"CAST(1 + (CAST({SCALE} AS HUGEINT) * ({{count}} + 2)) // ({{total}} + 2 * v) AS BIGINT)"
_F = "(({p}) - ({q})) * (({p}) - ({q})) // (({p}) + ({q}))"
_SCORE = f"""
WITH c AS (SELECT lang, source, term, n,
    {_SHARE.format(count="n", total="n_source")} AS p, {_SHARE.format(count="0", total="n_source")} AS z,
    {_SHARE.format(count="CAST(sum(n) OVER (PARTITION BY lang, term) AS BIGINT)", total="n_lang")} AS q FROM cells),
joint AS (SELECT a.lang, a.source AS one, b.source AS other,
    CAST(sum({_F.format(p="a.p", q="b.p")} - {_F.format(p="a.p", q="b.z")} - {_F.format(p="a.z", q="b.p")} + {_F.format(p="a.z", q="b.z")}) AS BIGINT) AS value
  FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL),
held AS (SELECT lang, source, n, CAST(count(*) AS BIGINT) AS value FROM c GROUP BY ALL),
top AS (SELECT lang, source, term, {_F.format(p="p", q="q")} AS value FROM c WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(term)) <= {{top}})
SELECT 'pair' AS kind, lang, one AS source, other AS item, 0::BIGINT AS n, value FROM joint
UNION ALL SELECT 'held', lang, source, '', n, value FROM held
UNION ALL SELECT 'term', lang, source, term, 0::BIGINT, value FROM top"""

_CELLS = "lang string, source string, term string, n long"


class _Shard:
    """A DuckDB of one task: one thread, bounded memory, what does not fit in the task's own scratch folder, which goes with it."""

    def __enter__(self):
        import duckdb

        self.scratch = tempfile.TemporaryDirectory()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "temp_directory": self.scratch.name})
        self.rows: dict[str, int] = {}
        return self

    def __exit__(self, *_):
        self.db.close()
        self.scratch.cleanup()

    def add(self, table: str, select: str, source: pa.Table | None = None) -> None:
        """Append the rows of a query, over the Arrow table ``given`` if there is one, to a table, which is made if it is new."""
        if source is not None:
            self.db.register("given", source)
        start = f"INSERT INTO {table}" if table in self.rows else f"CREATE TABLE {table} AS"
        self.rows[table] = self.rows.get(table, 0) + self.db.execute(f"{start} {select}").fetchone()[0]
        if source is not None:
            self.db.unregister("given")

    def drop(self, table: str) -> None:
        self.db.execute(f"DROP TABLE {table}")
        del self.rows[table]

    def merge(self) -> None:
        """Sum up the counts so far in place."""
        self.add("merged", _MERGE)
        self.drop("counts")
        self.db.execute("ALTER TABLE merged RENAME TO counts")
        self.rows["counts"] = self.rows.pop("merged")

    def take(self, select: str):
        """A query's rows as Arrow batches."""
        yield from self.db.sql(select).to_arrow_reader(50_000)


def _blocks(batches):
    """Tables ``row, lang, source, text`` of about BLOCK_CHARS each, and at least one row."""
    names = ["lang", "source", "text"]
    held, weight, row = [], 0, 0
    for b in batches:
        sizes = pc.utf8_length(b.column(2)).to_pylist()
        start = 0
        for i, size in enumerate(sizes):
            weight += size
            if weight >= BLOCK_CHARS:
                held.append(b.slice(start, i + 1 - start))
                yield _numbered(held, names)
                held, weight, start = [], 0, i + 1
        if start < b.num_rows:
            held.append(b.slice(start))
    if held:
        yield _numbered(held, names)


def _numbered(held: list[pa.RecordBatch], names: list[str]) -> pa.Table:
    table = pa.Table.from_batches(held).rename_columns(names)
    return table.append_column("row", pa.array(range(table.num_rows), pa.int64()))


def _count_terms(batches):
    """``lang, source, term, n, d`` of a task's texts, merged over its blocks as far as memory allows."""
    with _Shard() as shard:
        for block in _blocks(batches):
            shard.add("counts", _COUNT, block)
            if shard.rows["counts"] < MERGE_ROWS:
                continue
            shard.merge()
            if shard.rows["counts"] >= MERGE_ROWS // 2:
                yield from shard.take("SELECT * FROM counts")
                shard.drop("counts")
        if shard.rows.get("counts"):
            yield from shard.take(_MERGE)


def _keep_terms(least: int):
    def run(batches):
        with _Shard() as shard:
            for b in batches:
                shard.add("counts", "SELECT * FROM given", pa.Table.from_batches([b]))
                if shard.rows["counts"] >= 4 * MERGE_ROWS:
                    shard.merge()
            if shard.rows.get("counts"):
                shard.merge()
                yield from shard.take(_KEEP.format(least=least))

    return run


def _score_terms(top: int):
    def run(batches):
        with _Shard() as shard:
            for b in batches:
                shard.add("cells", "SELECT * FROM given", pa.Table.from_batches([b]))
            if shard.rows.get("cells"):
                yield from shard.take(_SCORE.format(top=top))

    return run


def _share(count, total, v):
    return (1 + F.expr(f"cast((cast({SCALE} as decimal(38,0)) * ({count} + 2)) div ({total} + 2 * {v}) as long)")).cast("long")


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n, leads``: how often each source has each term that ``least_docs`` documents of its language have."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count_terms, f"{_CELLS}, d long")
    return counted.repartition("lang", "term").mapInArrow(_keep_terms(least_docs), f"{_CELLS}, leads boolean")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources by divergence, and the terms a source has more of than its language.

    Null lang, source and text are empty strings. Every (lang, source) group
    gives a ``pair`` row for each other source of its language, 0 without kept
    terms, and up to ``top`` ``term`` rows. Ranks go by value, then by the
    item's bytes. A document is a row: repeated rows count each. Other columns
    are not read; no rows give no rows.
    """
    kept = pin(term_counts(docs, least_docs))
    per_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.count_if("leads").alias("leads"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct().join(per_source, ["lang", "source"], "left").fillna(0)
    totals = per_source.groupBy("lang").agg(F.sum("n_source").alias("n_lang"), F.sum("leads").alias("v"))
    groups = pin(groups.drop("leads").join(totals, "lang", "left").fillna(0))

    cells = kept.drop("leads").join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "n_source", "n_lang", "v").repartition("lang", "term")
    scored = pin(cells.mapInArrow(_score_terms(top), "kind string, lang string, source string, item string, n long, value long"))

    f = lambda p, q: F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")
    known = groups.where("v > 0").withColumn("z", _share("0", "n_source", "v"))
    # what a source's own terms add to each other source of its language, by how often it has them
    held = scored.where("kind = 'held'").groupBy("lang", "source", "n").agg(F.sum("value").alias("terms"))
    held = held.join(known.select("lang", "source", "n_source", "v", "z"), ["lang", "source"]).withColumn("p", _share("n", "n_source", "v"))
    others = known.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"))
    alone = held.join(others, "lang").where(F.col("source") != F.col("item"))
    alone = alone.select("lang", F.least("source", "item").alias("one"), F.greatest("source", "item").alias("other"), (F.col("terms") * (f("p", "other_z") - f("z", "other_z"))).alias("value"))
    shared = scored.where("kind = 'pair'").select("lang", F.col("source").alias("one"), F.col("item").alias("other"), "value")
    sums = shared.unionByName(alone).groupBy("lang", "one", "other").agg(F.sum("value").alias("sum"))

    left = groups.select("lang", F.col("source").alias("one"), "n_source", "v")
    right = groups.select("lang", F.col("source").alias("other"), F.col("n_source").alias("n_other"))
    pairs = left.join(right, "lang").where("one < other").join(sums, ["lang", "one", "other"], "left")
    floor = F.when(F.col("v") > 0, F.col("v") * f(*(f"1 + ({2 * SCALE} div (greatest({n} + 2 * v, 1)))" for n in ("n_source", "n_other")))).otherwise(F.lit(0))
    value = (floor + F.coalesce("sum", F.lit(0))).cast("long")
    ways = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    paired = pairs.select("lang", value.alias("value"), ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    terms = scored.where("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = paired.unionByName(terms).withColumn("rank", place)
    return ranked.where(F.col("part").eqNullSafe("pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
