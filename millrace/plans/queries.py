"""One query for each operator, over the driver's tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T
from ..operators import audit, best, checks, compare, containment, dictionary, messages, ordinals, pairing, ranking, stats
from ..streaming import best as streams
from .registry import Tables, query

# --- stand-ins: columns of the tables in the roles the operators need -----------------------------------------

_RUN_SQL = """SELECT event_id, ts, user_id, event_type, value, event_type <> 'error' AS ok,
  CASE WHEN event_id % 7 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, CAST(event_id % 97 AS BIGINT) AS prompt_tokens,
  CAST(event_id % 61 AS BIGINT) AS completion_tokens FROM events"""


def _runs(t: Tables) -> DataFrame:
    """Events as generation runs."""
    e = F.col("event_id")
    return t.events.select(
        "event_id", "ts", "user_id", "event_type", "value", (F.col("event_type") != "error").alias("ok"),
        F.when(e % 7 == 0, "length").otherwise("stop").alias("finish_reason"), (e % 97).alias("prompt_tokens"), (e % 61).alias("completion_tokens"),
    )


_LABEL_SQL = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '<Think>' || text WHEN 1 THEN '```' || text WHEN 2 THEN text || '```' WHEN 3 THEN '  ' ELSE text END AS label FROM documents"""


def _labels(t: Tables) -> DataFrame:
    d, x = F.col("doc_id") % 5, F.col("text")
    tagged = F.when(d == 0, F.concat(F.lit("<Think>"), x)).when(d == 1, F.concat(F.lit("```"), x)).when(d == 2, F.concat(x, F.lit("```"))).when(d == 3, F.lit("  ")).otherwise(x)
    return t.documents.select("doc_id", tagged.alias("label"))


_CHAT_SQL = "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, bool_and(trim(text) <> '') AS filled FROM conversations GROUP BY conv_id"


def _chats(t: Tables) -> DataFrame:
    row = F.struct("turn", "role", F.col("text").alias("content"))
    sorted_rows = F.array_sort(F.collect_list(row))
    return t.conversations.groupBy("conv_id").agg(F.transform(sorted_rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


# --- checks ---------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, v IS NOT NULL AND v <> '' AND regexp_full_match(v, '[^\\s](.*[^\\s])?', 's') AS id_ok FROM
  (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a' || doc_id WHEN 1 THEN ' ' || doc_id WHEN 2 THEN '' ELSE NULL END AS v FROM documents)""")
def id_validation(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    v = F.when(d % 4 == 0, F.concat(F.lit("a"), d)).when(d % 4 == 1, F.concat(F.lit(" "), d)).when(d % 4 == 2, "")
    return checks.id_check(t.documents.select("doc_id", v.alias("v")), "v").select("doc_id", "id_ok")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(t: Tables) -> DataFrame:
    return checks.duplicate_ids(t.events, "user_id")


@query("""SELECT event_id, event_id % 3 <> 0 AND json_valid(props) AS strict FROM events""", python=True)
def strict_json(t: Tables) -> DataFrame:
    p = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", r":\s*-?\d+", ": NaN")).otherwise(F.col("props"))
    return t.events.select("event_id", J.is_strict_json(p).alias("strict"))


@query(f"""SELECT doc_id, contains(lower(label), '<think>') OR contains(lower(label), '</think>') AS think_tag,
  starts_with(label, '```') OR ends_with(label, '```') AS fenced, regexp_full_match(label, '\\s*') AS blank FROM ({_LABEL_SQL})""")
def label_hygiene(t: Tables) -> DataFrame:
    return checks.label_checks(_labels(t), "label").drop("label")


@query(_CHAT_SQL)
def role_signature(t: Tables) -> DataFrame:
    return _chats(t).select("conv_id", checks.role_signature().alias("roles"), F.forall("messages", lambda m: ~T.is_blank(m["content"])).alias("filled"))


@query(f"SELECT conv_id FROM ({_CHAT_SQL}) WHERE filled AND roles IN ('user,assistant', 'system,user,assistant')")
def single_turn_filter(t: Tables) -> DataFrame:
    return _chats(t).where(checks.messages_ok()).select("conv_id")


@query(f"SELECT conv_id, filled AND roles = 'user,assistant' AND conv_id % 2 = 0 AS ok FROM ({_CHAT_SQL})")
def math_messages(t: Tables) -> DataFrame:
    last = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.concat(m["content"], F.when(F.col("conv_id") % 2 == 0, " #### 1").otherwise("")).alias("content")))
    return _chats(t).withColumn("messages", last).select("conv_id", checks.messages_ok(roles=checks.MATH_ROLES, marker="####", no_think=False).alias("ok"))


@query("SELECT event_id, event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AS ok FROM events")
def inference_input(t: Tables) -> DataFrame:
    e = F.col("event_id")
    spec = F.concat(F.lit('{"size":"'), F.when(e % 2 == 0, "2x2").otherwise("2x4"), F.lit('"}'))
    rows = t.events.select("event_id", F.concat(F.when(e % 3 == 0, "-").otherwise("t"), e).alias("id"), messages.chat_messages(spec, None, F.lit("s")).alias("messages"), (e % 5 == 0).alias("enable_thinking"))
    return rows.select("event_id", checks.inference_input_ok().alias("ok"))


@query("SELECT event_id, event_id % 4 = 0 AS ok FROM events")
def source_record(t: Tables) -> DataFrame:
    e = F.col("event_id") % 4
    size, query_text = F.when(e == 1, "9x9").otherwise("2x4"), F.when(e == 2, " ").otherwise("q")
    more = F.when(e == 3, ',"other":1').otherwise("")
    text = F.concat(F.lit('{"userQuery":"'), query_text, F.lit('","size":"'), size, F.lit('","dataModelSchema":{},"eventCandidates":[],"assetCandidates":[]'), more, F.lit("}"))
    return t.events.select("event_id", text.alias("record")).select("event_id", checks.task_record_ok("record").alias("ok"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 2")
def size_filter(t: Tables) -> DataFrame:
    return checks.size_filter(t.part.select("p_partkey", "p_size"), "p_size", 2)


@query("SELECT c_custkey, c_acctbal >= 0 AS not_negative, c_acctbal > 0 AS positive FROM customer")
def numeric_guards(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", checks.non_negative("c_acctbal").alias("not_negative"), checks.finite_positive("c_acctbal").alias("positive"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 4096")
def context_violations(t: Tables) -> DataFrame:
    return checks.context_violations(t.documents.select("doc_id", "n_chars"), "n_chars", 4096)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN false ELSE len(w) > len(w) // 2 END AS aligned FROM
  (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def prefix_alignment(t: Tables) -> DataFrame:
    ids = t.documents.select("doc_id", messages.word_token_ids(F.col("text")).alias("full"))
    half = F.slice("full", F.lit(1), F.floor(F.size("full") / 2).cast("int"))
    prompt = F.when(F.col("doc_id") % 3 == 0, F.concat(F.array(F.lit(-1).cast("long")), half)).otherwise(half)
    return ids.withColumn("prompt", prompt).select("doc_id", checks.prompt_is_prefix("prompt", "full").alias("aligned"))


@query("SELECT max(n_chars) AS longest_prompt, max(n_chars) + 1024 AS needed, max(n_chars) + 1024 <= 4096 AS fits FROM documents")
def capacity_check(t: Tables) -> DataFrame:
    return checks.capacity(t.documents, "n_chars", 1024, 4096)


@query(f"""SELECT coalesce(CASE WHEN finish_reason = 'length' THEN 'truncated' WHEN event_id % 5 = 0 THEN 'empty' WHEN NOT ok THEN 'conversion_error' ELSE 'unknown' END, '') AS kind,
  count(*) AS n FROM ({_RUN_SQL}) GROUP BY 1""")
def failure_histogram(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, " ").otherwise("dsl")
    kind = T.classify_failure(F.col("finish_reason"), text, F.when(~F.col("ok"), "error"))
    return _runs(t).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- projections ----------------------------------------------------------------------------------------------


@query("SELECT event_id, replace(props, ' ', '') AS canonical, replace(props, ' ', '') AS stable FROM events", python=True)
def canonical_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", J.canonical_json(F.col("props")).alias("canonical"), J.stable_json(F.col("props")).alias("stable"))


@query("""SELECT doc_id, 'system|4;user|' || length(text) || ';assistant|' || length(lang) AS told FROM documents WHERE length(trim(text)) > 0""")
def sft_messages_build(t: Tables) -> DataFrame:
    rows = messages.sft_rows(t.documents.where(F.length(F.trim("text")) > 0), "doc_id", "text", "lang", "rule")
    told = F.transform("messages", lambda m: F.concat_ws("|", m["role"], F.length(m["content"]).cast("string")))
    return rows.select(F.col("id").alias("doc_id"), F.array_join(told, ";").alias("told"))


@query("SELECT p_partkey, 'taskspec-' || lpad(CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR))) AS INTEGER), '0') AS id FROM part WHERE p_size = 2")
def numbered_ids(t: Tables) -> DataFrame:
    return messages.numbered_rows(t.part.where("p_size = 2").select("p_partkey"), ["p_partkey"])


@query("SELECT item_id, trim(text) || ' Show your steps.' AS prompt FROM benchmark")
def question_prompt(t: Tables) -> DataFrame:
    m = messages.question_messages(F.col("text"), F.lit("a"), "Show your steps.")
    return t.benchmark.select("item_id", F.element_at(m, 1)["content"].alias("prompt"))


_ANSWER = r"-?(?:\d[\d,]*(?:\.\d+)?|\.\d+)"


@query(f"""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' #### ' || n_chars ELSE text END AS x FROM documents),
f AS (SELECT doc_id, regexp_extract_all(string_split(x, '####')[-1], '{_ANSWER}')[-1] AS raw FROM g),
a AS (SELECT doc_id, replace(raw, ',', '') AS r FROM f),
b AS (SELECT doc_id, regexp_replace(CASE WHEN contains(r, '.') THEN regexp_replace(r, '\\.?0*$', '') ELSE r END, '^(-?)0+([0-9])', '\\1\\2') AS r FROM a)
SELECT doc_id, CASE WHEN r IN ('', '-', '0', '-0') THEN '0' ELSE regexp_replace(r, '^(-?)\\.', '\\10.') END AS answer FROM b""")
def answer_extract(t: Tables) -> DataFrame:
    x = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" #### "), "n_chars")).otherwise(F.col("text"))
    return t.documents.select("doc_id", T.final_answer(x).alias("answer"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, '-00' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || '0' AS r FROM lineitem),
b AS (SELECT *, regexp_replace(regexp_replace(r, '\\.?0*$', ''), '^(-?)0+([0-9])', '\\1\\2') AS s FROM a)
SELECT l_orderkey, l_linenumber, CASE WHEN s IN ('', '-', '0', '-0') THEN '0' ELSE regexp_replace(s, '^(-?)\\.', '\\10.') END AS number FROM b""")
def number_canonical(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("-00"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("0"))
    return t.lineitem.select("l_orderkey", "l_linenumber", T.canonical_number(raw).alias("number"))


_SCORED_SQL = """SELECT doc_id, doc_id % 2 = 0 AS format_valid, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS correct, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS strict_correct,
  doc_id % 7 = 0 AS truncated, n_chars AS completion_tokens FROM documents"""


def _scored(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rows = t.documents.select(
        "doc_id", F.when(d % 2 == 0, F.concat(F.lit("so #### "), "n_chars")).otherwise("no idea").alias("generation"),
        F.when(d % 3 == 0, "-1").otherwise(F.col("n_chars").cast("string")).alias("reference"), F.when(d % 7 == 0, "length").alias("finish_reason"), F.col("n_chars").alias("completion_tokens"),
    )
    return messages.score_answers(rows, "generation", "reference", "finish_reason").select("doc_id", "format_valid", "correct", "strict_correct", "truncated", "completion_tokens")


@query(_SCORED_SQL)
def correctness_flags(t: Tables) -> DataFrame:
    return _scored(t)


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents")
def tokenise(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(messages.word_token_ids(F.col("text"))).cast("long").alias("n_tokens"))


@query("""SELECT doc_id, CAST(n AS BIGINT) AS n_ids, CAST(n * (n - 1) // 2 AS BIGINT) AS position_sum, CAST(n - n // 2 AS BIGINT) AS mask_sum, n > 2048 AS too_long FROM
  (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)""")
def loss_mask_build(t: Tables) -> DataFrame:
    ids = t.documents.select("doc_id", messages.word_token_ids(F.col("text")).alias("full"))
    ids = ids.withColumn("prompt", F.slice("full", F.lit(1), F.floor(F.size("full") / 2).cast("int")))
    e = messages.encode_example(ids, "prompt", "full", 2048)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("doc_id", F.size("input_ids").cast("long").alias("n_ids"), total("position_ids").alias("position_sum"), total("loss_mask").alias("mask_sum"), "too_long")


@query("SELECT lang, greatest(4096, CAST(ceil(max(n_chars) / 256.0) * 256 AS BIGINT)) AS recommended FROM documents GROUP BY lang")
def align_recommendation(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.max("n_chars").alias("m")).select("lang", F.greatest(F.lit(4096).cast("long"), T.align_up(F.col("m"), 256)).alias("recommended"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256(text), 1, 4))::BIGINT % 8 AS INTEGER) AS palette FROM documents")
def palette_pick(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.palette_index(F.col("text")).alias("palette"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS k_text, CAST(NULL AS VARCHAR) AS absent FROM events", python=True)
def json_pointer(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select("event_id", J.pointer_value(p, "/k", "bigint").alias("k"), J.pointer_values(p, F.lit("/k")).alias("k_text"), J.pointer_values(p, F.lit("/k/0")).alias("absent"))


# --- joins ----------------------------------------------------------------------------------------------------


@query("""SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched, count(*) FILTER (WHERE l.doc_id IS NULL) AS left_only,
  count(*) FILTER (WHERE d.doc_id IS NULL) AS right_only FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def pair_gate(t: Tables) -> DataFrame:
    return pairing.pair_counts(t.documents, t.labels, "doc_id")


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(t: Tables) -> DataFrame:
    return pairing.unmatched(t.documents, t.labels, "doc_id")


@query("SELECT o_orderkey, o_orderstatus AS before_o_orderstatus, o_orderstatus AS after_o_orderstatus, o_totalprice AS before_o_totalprice, o_totalprice * 2 AS after_o_totalprice FROM orders")
def before_after_pairs(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return pairing.before_after(o, o.withColumn("o_totalprice", F.col("o_totalprice") * 2), "o_orderkey", ["o_orderstatus"], ["o_totalprice"])


@query("SELECT unnest(['n', 'seed']) AS field")
def run_settings(t: Tables) -> DataFrame:
    one = t.region.agg(F.count(F.lit(1)).alias("n"), F.lit("m").alias("model"), F.lit(None).cast("int").alias("limit"), F.lit(1).alias("seed"))
    other = t.nation.agg(F.count(F.lit(1)).alias("n"), F.lit("m").alias("model"), F.lit(None).cast("int").alias("limit"), F.lit(2).alias("seed"))
    return pairing.differing_settings(one, other, ["n", "model", "limit", "seed"])


@query("""SELECT place, dearest, oldest FROM (SELECT o_orderkey AS dearest, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders)
  JOIN (SELECT o_orderkey AS oldest, row_number() OVER (ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS place FROM orders) USING (place)""")
def positional_zip(t: Tables) -> DataFrame:
    """Orders by price and orders by date, side by side by their places."""
    dear, old = t.orders.select(F.col("o_orderkey").alias("dearest"), "o_totalprice"), t.orders.select(F.col("o_orderkey").alias("oldest"), "o_orderdate")
    return ordinals.zip_in_order(dear, old, [F.desc("o_totalprice"), F.col("dearest")], ["o_orderdate", "oldest"], "place", 1).select("place", "dearest", "oldest")


@query("SELECT event_id, row_number() OVER (ORDER BY value NULLS FIRST, event_id) AS place, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) - 1 AS nth FROM events")
def event_ordinals(t: Tables) -> DataFrame:
    """Every event's place by value among all, and by time among its user's."""
    placed = ordinals.with_ordinal(t.events.select("event_id", "user_id", "ts", "value"), ["value", "event_id"], "place", 1)
    return ordinals.with_ordinal(placed, ["ts", "event_id"], "nth", 0, ["user_id"]).select("event_id", "place", "nth")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def unlisted_members(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return pairing.missing_members(rows, t.part.where("p_size > 5"), ["p_partkey"]).select("l_orderkey", "l_linenumber", F.col("p_partkey").alias("l_partkey"))


_PATH_SQL = "SELECT page_id, CAST(0 AS BIGINT) AS c, regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages"
_ROOT_SQL = "SELECT unnest(['/en', '/fr', '/de/7', '/nowhere']) AS root"


def _paths(t: Tables) -> tuple[DataFrame, DataFrame]:
    paths = t.pages.select("page_id", F.lit(0).cast("long").alias("c"), F.regexp_replace("url", "^https?://[^/]*", "").alias("path"))
    roots = t.spark.createDataFrame([(0, r) for r in ("/en", "/fr", "/de/7", "/nowhere")], "c long, root string")
    return paths, roots


@query(f"""SELECT p.page_id, p.path, max(r.root) AS covering_root FROM ({_PATH_SQL}) p LEFT JOIN ({_ROOT_SQL}) r
  ON p.path = r.root OR starts_with(p.path, r.root || '/') GROUP BY ALL""")
def prefix_cover(t: Tables) -> DataFrame:
    paths, roots = _paths(t)
    return pairing.cover_by_prefix(paths, roots, ["c"]).select("page_id", "path", "covering_root").distinct()


@query(f"""SELECT r.root FROM ({_ROOT_SQL}) r WHERE NOT EXISTS (SELECT 1 FROM ({_PATH_SQL}) p WHERE p.path = r.root OR starts_with(p.path, r.root || '/'))""")
def unused_roots(t: Tables) -> DataFrame:
    return pairing.unused_roots(*_paths(t), ["c"]).select("root")


_RULES = [("t", 0, "a", {"brand": "Brand#1", "size": "1"}), ("t", 1, "b", {"brand": "Brand#1"}), ("t", 2, "d", {"brand": "none"}), ("t", 3, "e", {"brand": "Brand#2", "size": "3"})]


@query("""WITH r(ord, rule, brand, size) AS (VALUES (0, 'a', 'Brand#1', '1'), (1, 'b', 'Brand#1', NULL), (2, 'd', 'none', NULL), (3, 'e', 'Brand#2', '3')),
m AS (SELECT p_partkey, ord, rule, (p_brand = brand)::INT + coalesce((p_size::VARCHAR = size)::INT, 0) AS shared, 1 + (size IS NOT NULL)::INT AS n FROM part, r),
c AS (SELECT p_partkey, min_by(rule, ord) FILTER (WHERE shared = n) AS rule, count(*) FILTER (WHERE shared = n) AS n_full, count(*) FILTER (WHERE shared > 0 AND shared < n) AS n_half FROM m GROUP BY p_partkey)
SELECT p_partkey, rule, CASE WHEN n_full > 1 THEN 'ambiguous' WHEN n_full = 1 THEN 'full' WHEN n_half > 0 THEN 'half' ELSE 'none' END AS outcome, n_full, n_half FROM c""")
def token_match(t: Tables) -> DataFrame:
    """Parts against rules of one or two properties: full, half and ambiguous matches."""
    parts = t.part.select("p_partkey", F.lit("t").alias("kind"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("props"))
    rules = t.spark.createDataFrame(_RULES, "kind string, ord int, rule string, wanted map<string,string>")
    return containment.match_sets(parts, rules, "props", "wanted", "ord", ["p_partkey"], ["kind"]).select("p_partkey", "rule", "outcome", "n_full", "n_half")


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS token FROM nation")
def reverse_lookup(t: Tables) -> DataFrame:
    tokens = t.spark.createDataFrame([(0, 0, "zero"), (0, 1, "nil"), (1, 2, "one")], "value int, ord int, token string")
    return pairing.reverse_lookup(t.nation.select("n_nationkey", "n_regionkey"), "n_regionkey", tokens).select("n_nationkey", "token")


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'error' THEN 1 WHEN event_type = 'view' AND user_id % 10 = 7 THEN 2 END AS candidate,
  CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' AND user_id % 10 = 7 THEN 3 ELSE 0 END AS n_fits,
  CASE WHEN event_type = 'view' AND user_id % 10 <> 7 THEN 2 ELSE 0 END AS n_half FROM events""")
def event_match(t: Tables) -> DataFrame:
    """Events against candidates of their type: exact, contained, linked, sharing some, and the only one of its type."""
    args = F.create_map(F.lit("uri"), (F.col("user_id") % 10).cast("string"), F.lit("at"), F.lit("x"))
    h = t.events.select(F.lit(0).alias("c"), F.col("event_id").alias("handler"), F.col("event_type").alias("call"), args.alias("args"))
    offered = [(0, 0, "click", {}), (0, 1, "error", {"uri": "none"}), (0, 2, "view", {"uri": "7", "at": "x"}), (0, 3, "view", {"uri": "7", "at": "y"}), (0, 4, "view", {"uri": "7", "at": "x", "z": "1"})]
    c = t.spark.createDataFrame(offered, "c int, pos int, call string, args map<string,string>")
    return containment.match_events(h, c, "c").select(F.col("handler").alias("event_id"), "candidate", "n_fits", "n_half")


# --- aggregations ---------------------------------------------------------------------------------------------

_DISC = ", ".join(f"CAST(quantile_disc(n_chars, {q}) AS BIGINT) AS p{p}" for q, p in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))


@query(f"SELECT lang, count(*) AS count, min(n_chars) AS min, {_DISC}, max(n_chars) AS max FROM documents GROUP BY lang")
def token_stats_by_lang(t: Tables) -> DataFrame:
    return stats.length_report(t.documents, "n_chars", ["lang"])


@query("""SELECT event_type, CAST(min(value) AS DOUBLE) AS min, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95,
  CAST(max(value) AS DOUBLE) AS max, round(avg(value), 6) AS avg FROM events GROUP BY event_type""")
def numeric_summary(t: Tables) -> DataFrame:
    return stats.numeric_report(t.events, "value", ["event_type"]).withColumn("avg", F.round("avg", 6))


@query("""WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT share, n_chars AS value FROM s, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS share) WHERE i = round_even((n - 1) * share, 0)""")
def preflight_percentiles(t: Tables) -> DataFrame:
    return stats.rounded_rank_percentiles(t.documents, "n_chars", [0.5, 0.95, 0.99])


@query("SELECT lang, CAST(floor(median(n_chars)) AS BIGINT) AS median FROM documents GROUP BY lang")
def whole_median(t: Tables) -> DataFrame:
    return stats.group_medians(t.documents, ["lang"], "n_chars")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1")
def first_longest(t: Tables) -> DataFrame:
    return stats.first_longest(t.documents, "doc_id", "n_chars")


def _sql_summary(c: str, p: str) -> str:
    return (
        f"min({c})::DOUBLE AS {p}min, quantile_disc({c}, 0.5)::DOUBLE AS {p}p50, quantile_disc({c}, 0.95)::DOUBLE AS {p}p95, max({c})::DOUBLE AS {p}max, round(avg({c}), 6) AS {p}avg"
    )


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failed, round(avg(ok::INT), 6) AS success_rate,
  {_sql_summary('value', 'latency_')}, {_sql_summary('prompt_tokens', 'prompt_')}, {_sql_summary('completion_tokens', 'completion_')}, 90.0::DOUBLE AS wall_seconds,
  round(count(*) / 90.0, 6) AS requests_per_second, round(count(*) FILTER (WHERE ok) / 90.0, 6) AS successful_per_second, round(sum(completion_tokens) / 90.0, 6) AS tokens_per_second FROM ({_RUN_SQL})""")
def bench_report(t: Tables) -> DataFrame:
    r = stats.run_report(_runs(t), 90_000.0, latency="value")
    rounded = ("success_rate", "latency_avg", "prompt_avg", "completion_avg", "requests_per_second", "successful_per_second", "tokens_per_second")
    return r.withColumns({c: F.round(c, 6) for c in rounded})


@query(f"SELECT event_type, count(*) AS n FROM ({_RUN_SQL}) WHERE NOT ok GROUP BY event_type")
def failure_counts(t: Tables) -> DataFrame:
    return stats.failure_counts(_runs(t), kind="event_type")


@query(f"""SELECT count(*) AS total, CAST(sum(correct::INT) AS BIGINT) AS correct, round(avg(correct::INT), 6) AS accuracy, round(avg(format_valid::INT), 6) AS format_rate,
  round(avg(strict_correct::INT), 6) AS strict_accuracy, round(avg(completion_tokens), 6) AS mean_tokens, round(avg(truncated::INT), 6) AS truncation_rate FROM ({_SCORED_SQL})""")
def evaluation_summary(t: Tables) -> DataFrame:
    s = stats.evaluation_summary(_scored(t))
    return s.withColumns({c: F.round(c, 6) for c in ("accuracy", "format_rate", "strict_accuracy", "mean_tokens", "truncation_rate")})


def _flags(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", (F.col("quality") == 1).alias("before"), (F.col("toxic") == 1).alias("after"))


@query("""SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS wrong_to_right, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS right_to_wrong,
  count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS both_correct, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS both_wrong FROM labels""")
def paired_transitions(t: Tables) -> DataFrame:
    return compare.transitions(_flags(t), "before", "after")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'improved' ELSE 'regressed' END AS change FROM labels WHERE quality <> toxic")
def paired_turns(t: Tables) -> DataFrame:
    return compare.turned(_flags(t), "doc_id", "before", "after")


@query("SELECT round(avg(quality), 6) AS before_rate, round(avg(toxic), 6) AS after_rate, round(avg(toxic - quality), 6) AS delta FROM labels")
def paired_rates(t: Tables) -> DataFrame:
    return compare.rates(_flags(t), "before", "after").select(*(F.round(c, 6).alias(c) for c in ("before_rate", "after_rate", "delta")))


_DRAWN_SQL = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in compare.DRAWN)


@query(f"""WITH x AS (SELECT b, toxic - quality AS v, ('0x' || substr(md5('42|' || b || '|' || doc_id), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM labels, range(1000) t(b)),
m AS (SELECT b, sum(v * n) / sum(n)::DOUBLE AS mean FROM (SELECT b, v, {_DRAWN_SQL} AS n FROM x) GROUP BY b),
s AS (SELECT list(mean ORDER BY mean) AS l FROM m)
SELECT round(l[26], 6) AS low, round(l[975], 6) AS high FROM s""")
def bootstrap_ci_hash(t: Tables) -> DataFrame:
    d = t.labels.select("doc_id", (F.col("toxic") - F.col("quality")).alias("v"))
    return compare.bootstrap_by_hash(d, "doc_id", "v").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(python=True)
def bootstrap_ci_exact(t: Tables) -> DataFrame:
    return compare.bootstrap_exact(t.labels.select("doc_id", (F.col("toxic") - F.col("quality")).alias("v")), "doc_id", "v")


_REWARD_SQL = "SELECT event_id, user_id, (event_type <> 'error')::INT::DOUBLE AS reward FROM events"


def _rewards(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", (F.col("event_type") != "error").cast("int").cast("double").alias("reward"))


@query(f"""SELECT event_id, user_id, reward, round(CASE WHEN min(reward) OVER w = max(reward) OVER w THEN 0.0
  ELSE (reward - avg(reward) OVER w) / (coalesce(stddev_samp(reward) OVER w, 0.0) + 1e-6) END, 5) AS advantage FROM ({_REWARD_SQL}) WINDOW w AS (PARTITION BY user_id)""")
def group_advantage(t: Tables) -> DataFrame:
    return stats.group_advantage(_rewards(t), ["user_id"], "reward").withColumn("advantage", F.round("advantage", 5))


@query(f"SELECT user_id, count(*) AS n, round(avg(reward), 6) AS mean_reward, min(reward) = max(reward) AS flat, min(reward) >= 1 AS all_correct FROM ({_REWARD_SQL}) GROUP BY user_id")
def zero_variance_groups(t: Tables) -> DataFrame:
    return stats.flat_groups(_rewards(t), ["user_id"], "reward").withColumn("mean_reward", F.round("mean_reward", 6))


@query("SELECT event_type, round(sum(value), 4) AS total, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY event_type")
def stage_time_share(t: Tables) -> DataFrame:
    return stats.shares_of_total(t.events, "event_type", "value").select("event_type", F.round("total", 4).alias("total"), F.round("share", 6).alias("share"))


# --- ranking --------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT count(*) AS n FROM documents), k AS (SELECT least(greatest(32, (n * 0.05 + 16)::BIGINT // 32 * 32), (n - 32) // 32 * 32) AS k FROM
  (SELECT n, floor(n * 0.05 + 16) AS f FROM n)) SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) <= (SELECT least(greatest(32, CAST(floor(n * 0.05 + 16) AS BIGINT) // 32 * 32), (n - 32) // 32 * 32) FROM n) AS is_validation FROM documents""")
def split_hash_exact(t: Tables) -> DataFrame:
    return ranking.split_by_hash(t.documents.select("doc_id"), "doc_id", 0.05)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) <= (SELECT ceil(count(*) * 0.1) FROM documents) AS is_validation FROM documents")
def holdout_split(t: Tables) -> DataFrame:
    return ranking.holdout(t.documents.select("doc_id"), "doc_id", 0.1)


@query()
def split_shuffle_exact(t: Tables) -> DataFrame:
    return ranking.split_by_shuffle(t.documents.select("doc_id"), "doc_id", "doc_id", 0.05)


@query("""WITH p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents), k AS (SELECT * FROM p WHERE r < 8)
SELECT doc_id || '__oom_probe_' || lpad(CAST(i AS VARCHAR), 4, '0') AS doc_id, n_chars, CAST(i AS INTEGER) AS probe FROM range(256) t(i) JOIN k ON i % (SELECT count(*) FROM k) = r""")
def oom_probe(t: Tables) -> DataFrame:
    return ranking.memory_probe(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", 8, 256)


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, lang, doc_id LIMIT 10")
def longest_topk(t: Tables) -> DataFrame:
    return ranking.longest(t.documents.select("doc_id", "lang", "n_chars"), "n_chars", ["lang", "doc_id"])


@query("""WITH b AS (SELECT event_id, user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS batch FROM events)
SELECT event_id, user_id, value, batch, round(value / count(*) OVER (PARTITION BY user_id, batch), 6) AS row_latency FROM b""")
def batch_latency(t: Tables) -> DataFrame:
    b = ranking.batches(t.events.select("event_id", "user_id", "value"), ["event_id"], 16, ["user_id"])
    return ranking.latency_per_row(b, ["user_id", "batch"], "value").withColumn("row_latency", F.round("row_latency", 6))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE value IS NOT NULL),
f AS (SELECT user_id, 1::BIGINT AS r, value AS best, 1::BIGINT AS n FROM o WHERE r = 1 UNION ALL
 SELECT f.user_id, f.r + 1, CASE WHEN o.value < f.best - 0.5 THEN o.value ELSE f.best END, f.n + CASE WHEN o.value < f.best - 0.5 THEN 1 ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
SELECT user_id, min(best) AS best_loss, max(n) AS n_accepted FROM f GROUP BY user_id""", python=True)
def best_checkpoint(t: Tables) -> DataFrame:
    b = best.best_so_far(t.events, ["user_id"], "event_id", "value", 0.5)
    return b.select("user_id", "best_loss", F.col("n_accepted").cast("long").alias("n_accepted"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE value IS NOT NULL),
f AS (SELECT user_id, event_id, 1::BIGINT AS r, value AS best, true AS kept FROM o WHERE r = 1 UNION ALL
 SELECT f.user_id, o.event_id, f.r + 1, CASE WHEN o.value < f.best - 2.5 THEN o.value ELSE f.best END, o.value < f.best - 2.5 FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
SELECT user_id, event_id, best AS loss FROM f WHERE kept""", python=True)
def accepted_checkpoints(t: Tables) -> DataFrame:
    told = best.accepted_steps(t.events, ["user_id"], "event_id", "value", 2.5)
    return told.select("user_id", "event_id", F.col("value").alias("loss"))


@query("""SELECT event_id, user_id, value FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)
WHERE b IS NULL OR value < b""")
def new_minima(t: Tables) -> DataFrame:
    return best.improvements(t.events.select("event_id", "user_id", "value"), ["user_id"], "event_id", "value")


# --- sets -----------------------------------------------------------------------------------------------------


@query("SELECT 'customer' AS split, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def split_concat(t: Tables) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("split"), F.col("c_custkey").alias("id"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("split"), F.col("s_suppkey").alias("id")))


@query("""SELECT k, 'left' AS side FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT s_suppkey FROM supplier)
UNION ALL SELECT k, 'right' FROM (SELECT s_suppkey AS k FROM supplier EXCEPT SELECT o_custkey FROM orders)""")
def set_difference(t: Tables) -> DataFrame:
    return pairing.symmetric_difference(t.orders.select(F.col("o_custkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k")), "k")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_distinct(t: Tables) -> DataFrame:
    roles = F.transform("messages", lambda m: m["role"])
    return _chats(t).select("conv_id", F.array_join(pairing.ordered_distinct(roles), ",").alias("roles"))


# --- audits ---------------------------------------------------------------------------------------------------


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'size' ELSE 'sha256' END AS problem
  FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 IN (0, 1)""")
def manifest_check(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    files = t.documents.select("doc_id", d.cast("string").alias("path"), F.col("n_chars").alias("size"), F.concat(F.sha2("text", 256), d.cast("string")).alias("sha256"))
    listed = files.withColumn("size", F.when(d % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("sha256", F.when(d % 5 == 1, F.lit("other")).otherwise(F.col("sha256")))
    return audit.manifest_check(files.where("doc_id % 7 <> 0").drop("doc_id"), listed.drop("doc_id"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(t: Tables) -> DataFrame:
    return audit.exact_duplicates(t.documents, "text")


@query("""SELECT sha256(source) AS sha256, count(*) AS copies, min(quality) AS low, max(quality) AS high FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING min(quality) <> max(quality)""")
def conflicting_labels(t: Tables) -> DataFrame:
    return audit.conflicting_labels(t.documents.join(t.labels, "doc_id"), "source", "quality")


_GRAM_SQL = "list_distinct(list_transform(range(1, greatest(len(w) - {k} + 1, 1)), lambda i: array_to_string(w[i:i+{k}-1], ' ')))".replace("range(1, greatest(len(w) - {k} + 1, 1))", "range(1, greatest(len(w) - {k} + 2, least(len(w), 1) + 1))")
_WORDS_SQL = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '') AS w"


@query(f"""WITH t AS (SELECT min(doc_id) AS id, any_value(text) AS x FROM documents GROUP BY text), g AS (SELECT id, {_GRAM_SQL.format(k=5)} AS s FROM (SELECT id, {_WORDS_SQL.format(c='x')} FROM t)),
e AS (SELECT id, len(s) AS n, unnest(s) AS h FROM g), p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.id < b.id GROUP BY ALL)
SELECT a, b, round(k / (na + nb - k)::DOUBLE, 6) AS similarity FROM p WHERE k / (na + nb - k)::DOUBLE >= 0.8""", python=True)
def near_duplicates(t: Tables) -> DataFrame:
    return audit.near_duplicates(t.documents, "doc_id", "text").withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH d AS (SELECT doc_id AS doc, unnest({_GRAM_SQL.format(k=8)}) AS g FROM (SELECT doc_id, {_WORDS_SQL.format(c='text')} FROM documents)),
b AS (SELECT item_id AS item, unnest({_GRAM_SQL.format(k=8)}) AS g FROM (SELECT item_id, {_WORDS_SQL.format(c='text')} FROM benchmark))
SELECT doc, item, count(*) AS shared FROM d JOIN b USING (g) GROUP BY ALL""")
def benchmark_contamination(t: Tables) -> DataFrame:
    return audit.contamination(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


def _leak_sql() -> str:
    return ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {k}" for k, p in audit.LEAK_PATTERNS.items())


@query(f"SELECT doc_id, {_leak_sql()} FROM documents")
def leak_counts(t: Tables) -> DataFrame:
    return audit.leak_counts(t.documents, "doc_id", "text")


_PATTERN_SQL = """SELECT DISTINCT kind, pattern FROM (SELECT 'query' AS kind, substr(text, 1, 24) AS pattern FROM benchmark
  UNION ALL SELECT 'sample', substr(text, 1, 7) FROM conversations UNION ALL SELECT 'user', c_name FROM customer UNION ALL SELECT 'value', p_name FROM part) WHERE pattern <> ''"""


@query(f"SELECT doc_id AS id, kind, pattern, strpos(text, pattern) - 1 AS first_at FROM documents, ({_PATTERN_SQL}) WHERE contains(text, pattern)", python=True)
def dictionary_leaks(t: Tables) -> DataFrame:
    """Task queries, first words of conversations, customers and part names that stand in documents."""
    rows = [
        t.benchmark.select(F.lit("query").alias("kind"), F.substring("text", 1, 24).alias("pattern")), t.conversations.select(F.lit("sample").alias("kind"), F.substring("text", 1, 7).alias("pattern")),
        t.customer.select(F.lit("user").alias("kind"), F.col("c_name").alias("pattern")), t.part.select(F.lit("value").alias("kind"), F.col("p_name").alias("pattern")),
    ]
    patterns = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return dictionary.leaks(t.documents, "doc_id", "text", patterns).select("id", "kind", "pattern", "first_at")


_OFFER_SQL = "SELECT DISTINCT l_orderkey AS c, l_returnflag AS kind, l_partkey AS item FROM lineitem"
_USED_SQL = "SELECT DISTINCT l_orderkey AS c, l_returnflag AS kind, l_partkey AS item FROM lineitem WHERE l_quantity > 25"


def _offers(t: Tables) -> tuple[DataFrame, DataFrame]:
    cols = [F.col("l_orderkey").alias("c"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("item")]
    return t.lineitem.select(*cols), t.lineitem.where("l_quantity > 25").select(*cols)


@query(f"SELECT o.kind, count(*) AS offered, count(u.item) AS used, round(count(u.item) / count(*)::DOUBLE, 6) AS rate FROM ({_OFFER_SQL}) o LEFT JOIN ({_USED_SQL}) u USING (c, kind, item) GROUP BY o.kind")
def candidate_use(t: Tables) -> DataFrame:
    return audit.candidate_use(*_offers(t), "c", "kind", "item").withColumn("rate", F.round("rate", 6))


@query(f"""SELECT kind, class, count(*) AS cases FROM (SELECT o.c, o.kind, CASE WHEN count(u.item) = 0 THEN 'none' WHEN count(u.item) = count(*) THEN 'all' ELSE 'partial' END AS class
  FROM ({_OFFER_SQL}) o LEFT JOIN ({_USED_SQL}) u USING (c, kind, item) GROUP BY o.c, o.kind) GROUP BY ALL""")
def use_classes(t: Tables) -> DataFrame:
    return audit.use_classes(*_offers(t), "c", "kind", "item").groupBy("kind", "class").agg(F.count(F.lit(1)).alias("cases"))


@query("""SELECT l_linenumber AS pos, count(*) AS unused FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM lineitem u WHERE u.l_orderkey = l.l_orderkey AND u.l_partkey = l.l_partkey AND u.l_quantity > 25) GROUP BY 1""")
def unused_positions(t: Tables) -> DataFrame:
    cols = [F.col("l_orderkey").alias("c"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("pos")]
    return audit.unused_positions(t.lineitem.select(*cols), t.lineitem.where("l_quantity > 25").select(*cols), "c", "item", "pos")


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_s, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(t: Tables) -> DataFrame:
    """A table has no late rows, so all are counted."""
    return streams.windowed_counts(t.events, "ts", "event_type").select(F.unix_timestamp("window.start").alias("hour_s"), "event_type", "n")


@query("""SELECT p_type AS name, CAST(count(*) FILTER (WHERE p_size <= 3) AS BIGINT) AS token_hits, CAST(count(*) FILTER (WHERE p_size > 3) AS BIGINT) AS explicit, count(DISTINCT p_size) AS "values" FROM part GROUP BY 1""")
def style_stats(t: Tables) -> DataFrame:
    props = t.part.select(F.lit(0).alias("case"), F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.col("p_size").alias("value"))
    return audit.style_stats(props, t.spark.range(-10, 4).select(F.col("id").cast("int").alias("value")))


@query("""SELECT count(*) FILTER (WHERE event_type = 'error') AS p0, count(*) FILTER (WHERE event_type = 'click') AS p1, count(*) FILTER (WHERE event_type NOT IN ('error', 'click')) AS p2,
  (SELECT count(*) FROM region) AS stages, (SELECT count(*) FROM region WHERE r_regionkey > 0) AS passed, false AS batch_passes FROM events""")
def batch_gate(t: Tables) -> DataFrame:
    k = F.col("event_type")
    issues = t.events.select(F.when(k == "error", "P0").when(k == "click", "P1").otherwise("P2").alias("severity"))
    return audit.batch_gate(issues, t.region.select(F.when(F.col("r_regionkey") > 0, "pass").otherwise("not_run").alias("status")))


@query("SELECT c_custkey AS id, c_nationkey AS \"case\", c_mktsegment AS literal, 'p' || n_regionkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING'")
def frozen_facts(t: Tables) -> DataFrame:
    literals = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("case"), F.col("c_mktsegment").alias("literal"))
    samples = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("case"), F.lit("BUILDING").alias("sample"), F.concat(F.lit("p"), "n_regionkey").alias("path"))
    return audit.frozen_facts(literals, samples).select("id", "case", "literal", "path")
