"""Evaluation queries (E1-E13) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as EV
from ..operators import model as MD
from ..operators import induce
from . import message_queries as MQ
from . import sqltext as S
from .registry import query, table

R = 6  # decimals kept for float outputs on both sides


# E1 / E2 ------------------------------------------------------------------------------------
# Generations rendered from line items with faults that follow the data:
# a quantity of 50 truncates the JSON line, an open line with flag 'A'
# swaps two keys, and flag 'R' writes the quantity as a JSON number
# (the schema types it as integer, so "23.0" fails the type check).
SANITY_COLS = ["l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"]
SANITY_TYPES = ["integer", "integer", "integer", "string", "date"]


def _sanity_generations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q_text = F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("string")).otherwise(
        T.json_string(F.col("l_quantity").cast("bigint").cast("string")))
    vals = {"l_linenumber": T.json_string(F.col("l_linenumber").cast("string")),
            "l_partkey": T.json_string(F.col("l_partkey").cast("string")),
            "l_quantity": q_text,
            "l_returnflag": T.json_string(F.col("l_returnflag")),
            "l_shipdate": T.json_string(F.date_format("l_shipdate", "yyyy-MM-dd"))}
    normal = T.json_object([(c, vals[c]) for c in SANITY_COLS])
    swapped = T.json_object([(c, vals[c]) for c in ["l_partkey", "l_linenumber"] + SANITY_COLS[2:]])
    line = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), swapped).otherwise(normal)
    line = F.when(F.col("l_quantity") >= 50, F.regexp_replace(line, r"\}$", "")).otherwise(line)
    lines = li.select("l_orderkey", *MQ.LINE_ORDER, line.alias("line"))
    gen = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*MQ.LINE_ORDER, "line"))).alias("ls"))
    gen = gen.select("l_orderkey", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("g"))
    fields = F.concat(F.lit("["), F.lit(", ".join(
        '{"name": "%s", "type": "%s", "required": true}' % (c, t) for c, t in zip(SANITY_COLS, SANITY_TYPES))),
        F.lit("]"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    schema = T.json_object([("schema_id", T.json_string(F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")))),
                            ("fields", fields)])
    user = F.concat(F.lit("[SCHEMA]\n"), schema, F.lit("\n<|document|>\n[DOCUMENT]\nOrder."))
    msgs = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")))
    out = o.join(gen, o.o_orderkey == gen.l_orderkey, "left")  # orders without lines: empty generation
    return out.select(F.col("o_orderkey").alias("sample"), msgs.alias("messages"),
                      F.coalesce("g", F.lit("")).alias("generation_only"), F.lit(None).cast("string").alias("generation"))


_SANITY_SQL = f"""
WITH l AS (
  SELECT l_orderkey AS sample, l_quantity >= 50 AS broken,
         l_linestatus = 'O' AND l_returnflag = 'A' AS swapped, l_returnflag = 'R' AS badtype,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {MQ._LINE_ORDER_SQL}) AS i
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
f AS (SELECT sample, bool_or(broken) AS any_broken, min(i) FILTER (WHERE swapped) AS first_swap FROM l GROUP BY sample),
t AS (SELECT f.sample, NOT any_broken AS json_ok,
             NOT any_broken AND first_swap IS NULL AS keys_ok,
             NOT any_broken AND NOT EXISTS (SELECT 1 FROM l WHERE l.sample = f.sample AND l.badtype
                                             AND l.i < coalesce(f.first_swap, 1 << 30)) AS types_ok
      FROM f)
"""


@query("sanity_report", sql=_SANITY_SQL + f"""
SELECT count(*)::BIGINT AS samples,
       round(count(*) FILTER (WHERE json_ok) / count(*), {R}) AS json_valid_rate,
       round(count(*) FILTER (WHERE keys_ok) / count(*), {R}) AS key_order_pass_rate,
       round(count(*) FILTER (WHERE types_ok) / count(*), {R}) AS type_check_pass_rate
FROM t
""")
def sanity_report(spark, sf_dir):
    rep = EV.sanity_report(EV.sanity_flags(_sanity_generations(spark, sf_dir), "sample"))
    return rep.select("samples", *[F.round(c, R).alias(c) for c in
                                   ["json_valid_rate", "key_order_pass_rate", "type_check_pass_rate"]])


@query("sanity_failures", sql=_SANITY_SQL + """
, r AS (
  SELECT sample, 0 AS k, 'json_parse_error' AS reason FROM t WHERE NOT json_ok
  UNION ALL SELECT sample, 1, 'key_order_mismatch' FROM t WHERE json_ok AND NOT keys_ok
  UNION ALL SELECT sample, 2, 'type_mismatch' FROM t WHERE json_ok AND NOT types_ok)
SELECT sample, reason FROM r ORDER BY sample, k
""")
def sanity_failures(spark, sf_dir):
    return EV.sanity_failures(EV.sanity_flags(_sanity_generations(spark, sf_dir), "sample"), "sample")


# E3 ------------------------------------------------------------------------------------------
@query("aligned_ids", sql="""
SELECT DISTINCT doc_id AS id FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)
""")
def aligned_ids(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    pred = (lab.filter("quality = 1").select(F.col("doc_id").alias("id"))
            .unionByName(lab.filter("toxic = 1").select(F.col("doc_id").alias("id"))))
    gold = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return EV.aligned_ids(gold, pred)


# E4 - E9 on conversations ---------------------------------------------------------------------
# Gold statements: lines of user turns; predicted categories: assistant and
# system turns (category name = F7 display name of the role).  Position key
# is turn-major: turn * 1e6 + line index.
LINE_KEY = 1_000_000


def _turn_statements(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    st = F.filter(F.transform(T.py_lines("text"), T.py_strip), lambda x: x != "")
    x = c.select(F.col("conv_id").alias("id"), "turn", "role", F.posexplode(st).alias("i", "statement"))
    return x.withColumn("pos", F.col("turn") * LINE_KEY + F.col("i"))


def _eval_inputs(spark, sf_dir):
    st = _turn_statements(spark, sf_dir)
    gold = st.filter(F.col("role") == "user").select("id", "pos", "statement")
    pred = st.filter(F.col("role").isin("assistant", "system")).select(
        T.category_display_name("role").alias("category"), "id", "pos", "statement")
    c = table(spark, sf_dir, "conversations")
    gold_ids = c.filter(F.col("role") == "user").select(F.col("conv_id").alias("id"))
    pred_ids = c.filter(F.col("role").isin("assistant", "system")).select(F.col("conv_id").alias("id"))
    return gold, pred, EV.aligned_ids(gold_ids, pred_ids)


_EVAL_SQL = f"""
WITH c AS (SELECT conv_id AS id, turn, role,
                  list_filter(list_transform({S.lines('text')}, lambda y: {S.strip('y')}), lambda y: y <> '') AS st
           FROM conversations),
s AS (SELECT id, turn, role, unnest(st) AS statement, generate_subscripts(st, 1) - 1 AS i FROM c),
st AS (SELECT id, role, turn * {LINE_KEY} + i AS pos, statement,
              list_distinct(list_filter(regexp_split_to_array(lower(statement), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS toks
       FROM s),
gold AS (SELECT id, pos, toks FROM st WHERE role = 'user'),
pred AS (SELECT CASE role WHEN 'assistant' THEN 'Assistant' ELSE 'System' END AS category, id, pos, toks
         FROM st WHERE role IN ('assistant', 'system')),
cats AS (SELECT DISTINCT category, id FROM pred),
gold_c AS (SELECT cats.category, gold.id, gold.pos, gold.toks FROM gold JOIN cats ON gold.id = cats.id),
pbest AS (SELECT p.category, p.id, p.pos, CASE WHEN len(p.toks) = 0 THEN 0.0 ELSE
            coalesce(max(len(list_intersect(p.toks, g.toks))), 0) / len(p.toks) END AS score
          FROM pred p LEFT JOIN gold g ON p.id = g.id GROUP BY p.category, p.id, p.pos, p.toks),
gbest AS (SELECT g.category, g.id, g.pos, CASE WHEN len(g.toks) = 0 THEN 0.0 ELSE
            max(len(list_intersect(p.toks, g.toks))) / len(g.toks) END AS score
          FROM gold_c g JOIN pred p ON p.id = g.id AND p.category = g.category GROUP BY g.category, g.id, g.pos, g.toks),
prf0 AS (SELECT p.category, p.id, p.precision, r.recall FROM
           (SELECT category, id, avg(score) AS precision FROM pbest GROUP BY ALL) p
           JOIN (SELECT category, id, avg(score) AS recall FROM gbest GROUP BY ALL) r
           ON p.category = r.category AND p.id = r.id),
prf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM prf0),
ids AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE role = 'user'
        INTERSECT SELECT DISTINCT conv_id FROM conversations WHERE role IN ('assistant', 'system')),
grid AS (SELECT id, unnest(['Assistant', 'System']) AS category FROM ids),
ex AS (SELECT grid.id, grid.category, coalesce(prf.precision, 0.0) AS precision, coalesce(prf.recall, 0.0) AS recall,
              coalesce(prf.f1, 0.0) AS f1
       FROM grid LEFT JOIN prf ON grid.id = prf.id AND grid.category = prf.category),
macro AS (SELECT category, count(*)::BIGINT AS num_examples, avg(precision) * 100 AS correctness,
                 avg(recall) * 100 AS completeness, avg(f1) * 100 AS overall FROM ex GROUP BY category)
"""


@query("statement_best_scores", sql=_EVAL_SQL + f"""
SELECT category, id, 'pred' AS side, pos, round(score, {R}) AS score FROM pbest
UNION ALL SELECT category, id, 'gold', pos, round(score, {R}) FROM gbest
""")
def statement_best_scores(spark, sf_dir):
    gold, pred, _ = _eval_inputs(spark, sf_dir)
    pb, gb = EV.best_scores(pred, gold)
    return (pb.select("category", "id", F.lit("pred").alias("side"), "pos", F.round("score", R).alias("score"))
            .unionByName(gb.select("category", "id", F.lit("gold").alias("side"), "pos",
                                   F.round("score", R).alias("score"))))


def _per_example(spark, sf_dir):
    gold, pred, ids = _eval_inputs(spark, sf_dir)
    pb, gb = EV.best_scores(pred, gold)
    return EV.per_example(EV.soft_prf(pb, gb), ids, pred)


@query("statement_prf", sql=_EVAL_SQL + f"""
SELECT id, category, round(precision, {R}) AS precision, round(recall, {R}) AS recall, round(f1, {R}) AS f1 FROM ex
""")
def statement_prf(spark, sf_dir):
    ex = _per_example(spark, sf_dir)
    return ex.select("id", "category", *[F.round(c, R).alias(c) for c in ["precision", "recall", "f1"]])


@query("macro_scores", sql=_EVAL_SQL + f"""
SELECT category, num_examples, round(correctness, {R}) AS correctness, round(completeness, {R}) AS completeness,
       round(overall, {R}) AS overall FROM macro
""")
def macro_scores(spark, sf_dir):
    m = EV.macro_scores(_per_example(spark, sf_dir))
    return m.select("category", "num_examples", *[F.round(c, R).alias(c) for c in ["correctness", "completeness", "overall"]])


@query("eval_aliases", sql=_EVAL_SQL + f"""
SELECT round(max(correctness) FILTER (WHERE category = 'Assistant'), {R}) AS team_correctness,
       round(max(completeness) FILTER (WHERE category = 'Assistant'), {R}) AS team_completeness,
       round(max(overall) FILTER (WHERE category = 'Assistant'), {R}) AS team_overall,
       round(max(correctness) FILTER (WHERE category = 'System'), {R}) AS player_correctness,
       round(max(completeness) FILTER (WHERE category = 'System'), {R}) AS player_completeness,
       round(max(overall) FILTER (WHERE category = 'System'), {R}) AS player_overall
FROM macro
""")
def eval_aliases(spark, sf_dir):
    """Assistant turns stand in the folder ``team``, system turns in ``player``."""
    gold, pred, ids = _eval_inputs(spark, sf_dir)
    folder = F.when(F.col("category") == "Assistant", "team").otherwise("player")
    pred = pred.withColumn("category", T.category_display_name(folder))
    pb, gb = EV.best_scores(pred, gold)
    out = EV.team_player_aliases(EV.macro_scores(EV.per_example(EV.soft_prf(pb, gb), ids, pred)))
    return out.select(*[F.round(c, R).alias(c) for c in out.columns])


LONGEST_LINE = 300


@query("eval_errors", sql=f"""
WITH t AS (SELECT conv_id, turn, role, {S.lines('text')} AS ls FROM conversations),
bad AS (SELECT DISTINCT conv_id AS id FROM t WHERE role = 'user' AND len(list_filter(ls, lambda x: length(x) > {LONGEST_LINE})) > 0)
SELECT id, 'ValueError: a line beyond {LONGEST_LINE} characters' AS error FROM bad
WHERE id IN (SELECT conv_id FROM conversations WHERE role IN ('assistant', 'system'))
""")
def eval_errors(spark, sf_dir):
    """Gold turns go through a stand-in model that refuses long lines; the ids it fails on are listed, the run goes on."""
    _, _, ids = _eval_inputs(spark, sf_dir)
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(F.col("conv_id").alias("id"), "text")
    read = MD.call_model(c, "text", MD.ModelFactory(MD.LineReader, (LONGEST_LINE,)), "statements", retries=1, error_col="error")
    return EV.error_ledger(read, ids)


# E10 ---------------------------------------------------------------------------------------
@query("loss_summary", sql=f"""
WITH b AS (SELECT event_type, user_id, avg(value) AS raw, avg(value) / 10 AS scaled, count(*) AS n
           FROM events GROUP BY event_type, user_id),
u AS (SELECT event_type, 'raw' AS scale, raw AS loss, n FROM b UNION ALL SELECT event_type, 'scaled', scaled, n FROM b),
s AS (SELECT event_type, scale, sum(loss * n) / greatest(sum(n), 1) AS l, sum(n)::BIGINT AS num_samples FROM u GROUP BY ALL)
SELECT event_type, scale, round(l, {R}) AS eval_loss,
       CASE WHEN l < 30 THEN round(exp(l), {R}) ELSE 'inf'::DOUBLE END AS eval_ppl, num_samples FROM s
""")
def loss_summary(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    b = ev.groupBy("event_type", "user_id").agg(F.avg("value").alias("raw"), F.count(F.lit(1)).alias("n"))
    u = (b.select("event_type", F.lit("raw").alias("scale"), F.col("raw").alias("loss"), "n")
         .unionByName(b.select("event_type", F.lit("scaled").alias("scale"), (F.col("raw") / 10).alias("loss"), "n")))
    s = EV.loss_summary(u, group_cols=["event_type", "scale"])
    return s.select("event_type", "scale", F.round("eval_loss", R).alias("eval_loss"),
                    F.when(F.col("eval_ppl") == float("inf"), F.col("eval_ppl"))
                    .otherwise(F.round("eval_ppl", R)).alias("eval_ppl"), "num_samples")


# E11 ------------------------------------------------------------------------------------------
CELL_COLS = ["c_name", "c_acctbal", "c_mktsegment"]


@query("cell_f1", sql=f"""
WITH g AS (
  SELECT c_nationkey AS id, c_custkey AS row_key, 'c_name' AS col, c_name AS v FROM customer
  UNION ALL SELECT c_nationkey, c_custkey, 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer
  UNION ALL SELECT c_nationkey, c_custkey, 'c_mktsegment', c_mktsegment FROM customer),
p AS (
  SELECT c_nationkey AS id, c_custkey AS row_key, 'c_name' AS col, c_name AS v FROM customer
  UNION ALL SELECT c_nationkey, c_custkey, 'c_acctbal', CAST(round(c_acctbal, 1) AS VARCHAR) FROM customer
  UNION ALL SELECT c_nationkey, c_custkey, 'c_mktsegment',
                   CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END FROM customer),
gc AS (SELECT id, row_key, col, trim(v) AS v, count(*) AS n FROM g GROUP BY ALL),
pc AS (SELECT id, row_key, col, trim(v) AS v, count(*) AS n FROM p GROUP BY ALL),
j AS (SELECT coalesce(pc.id, gc.id) AS id, coalesce(pc.n, 0) AS pn, coalesce(gc.n, 0) AS gn
      FROM pc FULL OUTER JOIN gc ON pc.id = gc.id AND pc.row_key = gc.row_key AND pc.col = gc.col AND pc.v = gc.v),
s AS (SELECT id, sum(least(pn, gn)) AS tp, sum(pn) AS np, sum(gn) AS ng FROM j GROUP BY id),
q AS (SELECT id, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS p, CASE WHEN ng = 0 THEN 0.0 ELSE tp / ng END AS r FROM s)
SELECT id, round(p, {R}) AS precision, round(r, {R}) AS recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, {R}) AS f1 FROM q
""")
def cell_f1(spark, sf_dir):
    c = table(spark, sf_dir, "customer")

    def cells(df, acct, seg):
        arr = F.array(F.struct(F.lit("c_name").alias("column"), F.col("c_name").alias("value")),
                      F.struct(F.lit("c_acctbal").alias("column"), acct.cast("string").alias("value")),
                      F.struct(F.lit("c_mktsegment").alias("column"), seg.alias("value")))
        return df.select(F.col("c_nationkey").alias("id"), F.col("c_custkey").alias("row_key"),
                         F.explode(arr).alias("x")).select("id", "row_key", "x.column", "x.value")

    gold = cells(c, F.col("c_acctbal"), F.col("c_mktsegment"))
    pred = cells(c, F.round("c_acctbal", 1),
                 F.when(F.col("c_acctbal") < 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    r = EV.cell_prf(pred, gold)
    return r.select("id", *[F.round(x, R).alias(x) for x in ["precision", "recall", "f1"]])


# E12 / E13 ------------------------------------------------------------------------------------
@query("schema_reward", sql=f"""
WITH h AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [p_type]) AS hs,
                  list_concat(string_split(p_name, ' '), [p_brand]) AS gs FROM part),
u AS (SELECT p_partkey, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM h),
s AS (SELECT p_partkey, i, {S.snake('h')} AS sn FROM u),
w AS (SELECT p_partkey, i, sn,
             count(*) OVER (PARTITION BY p_partkey, sn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
      FROM s),
n AS (SELECT p_partkey, list(CASE WHEN k = 1 THEN sn ELSE sn || '_' || k END ORDER BY i) AS names FROM w GROUP BY p_partkey),
g AS (SELECT p_partkey, list_distinct(list_transform(gs, lambda x: {S.snake_plain('x')})) AS gold FROM h)
SELECT n.p_partkey, 1.0::DOUBLE AS json_valid,
       round(len(list_distinct(list_filter(names, lambda x: x <> ''))) / len(names), {R}) AS unique_names,
       1.0::DOUBLE AS allowed_types,
       round(len(list_intersect(list_distinct(names), gold)) / len(gold), {R}) AS coverage
FROM n JOIN g ON n.p_partkey = g.p_partkey
""")
def schema_reward(spark, sf_dir):
    """Schema reward of the A3 schema of each part against gold names from
    the F4 form of its name words and brand; kept apart from the table
    reward (E13: one output per policy)."""
    p = table(spark, sf_dir, "part")
    headers = F.concat(F.split("p_name", " "), F.array("p_type"))
    sch = induce.minimal_schema(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")), headers)
    js = induce.minimal_schema_json(sch)
    gold = F.transform(F.concat(F.split("p_name", " "), F.array("p_brand")), T.snake_case_plain)
    from ..functions.strict_json import is_strict_json
    x = p.select("p_partkey", js.alias("js"), gold.alias("gold"))
    x = x.select("p_partkey", EV.schema_reward(F.col("js"), is_strict_json(F.col("js")), F.col("gold")).alias("r"))
    return x.select("p_partkey", *[F.round(F.col("r")[k], R).alias(k)
                                   for k in ["json_valid", "unique_names", "allowed_types", "coverage"]])
