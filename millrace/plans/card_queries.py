"""Queries over cards made from parts: each part is a card with a title, a bar, a round icon and a button."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dsl import columns as C
from ..operators import audit
from .registry import Tables, query

_TASK = (
    '{"dataModelSchema":{"data":{"part":{"name":{"type":"string"},"size":{"type":"integer"}}}},"assetCandidates":[{"src":"resources/base/media/i.png"}],'
    '"eventCandidates":[{"call":"clickToDeeplink","args":{"uri":"app://x"}}]}'
)
_CARD_SPEC = '{"dataBindings":[{"writeResultTo":"/data/part"},{"writeResultTo":"/data/spare"}]}'
_EVENT = '"onClick":[{"call":"clickToDeeplink","args":{"uri":"app://x"}}]'


def _card(k: Column, name: Column, size: Column) -> Column:
    """Every tenth part's card is broken in one way; the others vary in form."""
    fault = F.pmod(k, F.lit(10))
    root_children = F.when(fault == 1, '["t","b","gone"]').otherwise('["t","b","i","a"]')
    text_props = F.when(fault == 2, '{"content":{"path":"/data/part/name"},"colour":"x"}').when(k % 2 == 0, '{"content":{"path":"/data/part/name"},"design":"title-s"}').otherwise('{"text":{"path":"/data/part/name"},"fontSize":20,"fontWeight":700,}')
    bar = F.when(fault == 3, '{"value":true,"total":50}').otherwise('{"value":{"path":"/data/part/size"},"total":50,"design":"linear-bar"}')
    icon = F.when(fault == 4, "http://x/i.png").otherwise("resources/base/media/i.png")
    path = F.when(fault == 5, "/data/other").otherwise("/data/part")
    lines = [
        F.concat(F.lit('["root","Column",{"width":160,"height":160},'), root_children, F.lit("]")),
        F.concat(F.lit('["t","Text",'), text_props, F.lit("]")),
        F.concat(F.lit('["b","Progress",'), bar, F.lit("]")),
        F.concat(F.lit('["i","ActionUnit",{"state":"icon-round","icon":"'), icon, F.lit('",' + _EVENT + "}]")),
        F.lit('["a","ActionUnit",{"state":"capsule","label":"Open",' + _EVENT + "}]"),
        F.concat(F.lit('["'), path, F.lit('",{"name":"'), name, F.lit('","size":'), size.cast("string"), F.lit("}]")),
    ]
    body = F.concat_ws("\n", *lines)
    return F.when(fault == 6, F.concat(F.lit("```genui\n"), body, F.lit("\n```"))).when(fault == 7, F.concat(F.lit("Here it is:\n"), body)).otherwise(body)


def _parts(t: Tables) -> DataFrame:
    return C.dealt(t.part.select("p_partkey", "p_size", "p_name"), "p_partkey")


def _cards(t: Tables) -> DataFrame:
    return _parts(t).select("p_partkey", "p_size", "p_name", _card(F.col("p_partkey"), F.col("p_name"), F.col("p_size")).alias("card"))


_KIND = "CASE p_partkey % 10 WHEN 1 THEN 'order' WHEN 2 THEN 'property' WHEN 3 THEN 'value' WHEN 4 THEN 'source' WHEN 5 THEN 'unbound' END"
_GOOD = "p_partkey % 10 NOT IN (1, 2, 3, 4, 5)"


@query(f"SELECT p_partkey, {_GOOD} AS ok, {_KIND} AS error_type FROM part", python=True)
def card_documents(t: Tables) -> DataFrame:
    made = _cards(t).select("p_partkey", C.to_document(F.col("card"), F.lit("2x2")).alias("r"))
    return made.select("p_partkey", "r.ok", "r.error_type")


@query(f"SELECT p_partkey, 'pass' AS roundtrip, 0 AS n_differences FROM part WHERE {_GOOD}", python=True)
def compact_roundtrip(t: Tables) -> DataFrame:
    made = _cards(t).select("p_partkey", C.to_document(F.col("card"), F.lit("2x2")).alias("r")).where("r.ok")
    told = made.select("p_partkey", C.verify(F.col("r.text"), F.lit("2x2")).alias("v"))
    report = F.from_json("v.text", "roundtrip string, differences array<string>")
    return told.select("p_partkey", report.alias("x")).select("p_partkey", "x.roundtrip", F.size("x.differences").alias("n_differences"))


@query(f"""SELECT p_partkey, p_partkey % 2 = 0 AS by_design, sha256('["/",{{"data":{{"part":{{"name":"' || p_name || '","size":' || p_size || '}}}}}}]') AS model_sha FROM part WHERE {_GOOD}""", python=True)
def reverse_cards(t: Tables) -> DataFrame:
    made = _cards(t).select("p_partkey", C.to_document(F.col("card"), F.lit("2x2")).alias("r")).where("r.ok")
    back = made.select("p_partkey", C.to_card(F.col("r.text"), F.lit("2x2"))["text"].alias("card"))
    lines = F.split("card", "\n")
    was_named = F.col("p_partkey") % 2 == 0
    return back.select("p_partkey", (was_named & F.col("card").contains('"design":"title-s"')).alias("by_design"), F.sha2(F.element_at(lines, -1), 256).alias("model_sha"))


@query(f"SELECT p_partkey, {_GOOD.replace(', 5', '')} AS ok, CASE WHEN p_partkey % 10 IN (1, 2, 3, 4, 5) THEN false ELSE true END AS expanded FROM part".replace(_GOOD.replace(", 5", ""), "p_partkey % 10 NOT IN (1, 2, 3, 4)"), python=True)
def token_expansion(t: Tables) -> DataFrame:
    made = _cards(t).select("p_partkey", C.expand_tokens(F.col("card")).alias("r"))
    full = F.coalesce(F.col("r.text").contains('"fontSize":20') & ~F.col("r.text").contains('"design"') & (F.col("p_partkey") % 10 != 5), F.lit(False))
    return made.select("p_partkey", "r.ok", full.alias("expanded"))


@query(f"""SELECT p_partkey, {_GOOD} AS ok, {_KIND} AS error_type, CASE WHEN {_GOOD} THEN 1 ELSE NULL END AS warnings FROM part""", python=True)
def context_check(t: Tables) -> DataFrame:
    made = _cards(t).select("p_partkey", C.check_context(F.col("card"), F.lit(_TASK), F.lit(_CARD_SPEC)).alias("r"))
    return made.select("p_partkey", "r.ok", "r.error_type", F.size(F.from_json("r.text", "array<string>")).alias("warnings")).withColumn("warnings", F.when(F.col("ok"), F.col("warnings")))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 10 IN (1, 2, 3, 4) THEN NULL ELSE p_partkey % 10 <> 9 END AS unchanged FROM part""", python=True)
def card_mending(t: Tables) -> DataFrame:
    card = F.when(F.col("p_partkey") % 10 == 9, F.regexp_replace("card", "app://x", "app://wrong")).otherwise(F.col("card"))
    made = _cards(t).select("p_partkey", card.alias("card")).withColumn("r", C.mend(F.col("card"), F.lit(_TASK), F.lit(_CARD_SPEC)))
    return made.select("p_partkey", F.when(F.col("r.ok"), F.col("r.text") == F.col("card")).alias("unchanged"))


def _card_rows(t: Tables) -> DataFrame:
    return C.card_rows(_cards(t), "p_partkey", "card")


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS "case", {_KIND} AS error_type FROM part WHERE p_partkey % 10 IN (1, 2, 3, 4)""", python=True)
def unreadable_cards(t: Tables) -> DataFrame:
    return _card_rows(t).where("kind = 'error'").select("case", F.col("type").alias("error_type"))


@query("SELECT type, count(*) * k AS n, count(*) AS cases FROM part, (SELECT unnest([1, 1, 1, 2]) AS k, unnest(['Column', 'Text', 'Progress', 'ActionUnit']) AS type) WHERE p_partkey % 10 NOT IN (1, 2, 3, 4) GROUP BY type, k", python=True)
def component_counts(t: Tables) -> DataFrame:
    return audit.component_counts(_card_rows(t).where("kind = 'component'"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS \"case\", 5 AS components, 0 AS single_child_stacks, 0 AS empty_containers, 0 AS orphans, 2 AS max_depth FROM part WHERE p_partkey % 10 NOT IN (1, 2, 3, 4)", python=True)
def structure_stats(t: Tables) -> DataFrame:
    return audit.structure_stats(_card_rows(t).where("kind = 'component'").select("case", "id", "type", "children"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS \"case\", id, path FROM part, (SELECT unnest(['t', 'b']) AS id, unnest(['/data/part/name', '/data/part/size']) AS path) WHERE p_partkey % 10 NOT IN (1, 2, 3, 4)", python=True)
def binding_rows(t: Tables) -> DataFrame:
    return C.bindings(_card_rows(t)).select("case", "id", "path")


@query("SELECT CAST(p_partkey AS VARCHAR) AS \"case\", 'b' AS id FROM part WHERE p_partkey % 10 NOT IN (1, 2, 3, 4) AND p_partkey % 3 = 0", python=True)
def undeclared_bindings(t: Tables) -> DataFrame:
    size = F.when(F.col("p_partkey") % 3 == 0, '').otherwise(',"size":{"type":"integer"}')
    tasks = _parts(t).select(F.col("p_partkey").cast("string").alias("case"), F.concat(F.lit('{"data":{"part":{"name":{"type":"string"}'), size, F.lit("}}}")).alias("schema"))
    return C.undeclared_bindings(_card_rows(t), C.schema_paths(tasks, "case", "schema")).select("case", "id")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/a,/b/c' WHEN 1 THEN NULL WHEN 2 THEN '/a' ELSE NULL END AS paths FROM part""", python=True)
def expression_paths(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "${/a} > 0 ? ${/b/c} : 'none'").when(k == 1, "${/a}").when(k == 2, "${/a} + + )").otherwise("${/a} @ 1")
    return t.part.select("p_partkey", F.array_join(C.expression_paths(text), ",").alias("paths"))


@query("SELECT p_partkey, '{{ ${/p/' || p_partkey || '} }}' AS written, '/p/' || p_partkey AS path FROM part")
def binding_codec(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/p/"), "p_partkey")
    return t.part.select("p_partkey", C.written_binding(path).alias("written")).withColumn("path", C.bound_path(F.col("written")))
