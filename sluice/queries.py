"""Registered queries: each exercises library operators over the driver's tables.

Every query takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables; ``ORACLE`` holds an equivalent DuckDB SQL text per query (same output
column names and types).
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.runner import PipelineRun, PipelineSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ F10 end to end

def end_to_end_spec(sf_dir: str) -> PipelineSpec:
    """events -> 4-column map with casts and a DROP rule -> SQL average per type."""
    silver_rule = [{"validation_rule": "amount >= 5.0", "validation_action": "DROP"}]
    return PipelineSpec(
        sources=[{"origin": f"{sf_dir.rstrip('/')}/events.parquet", "datatype": "parquet",
                  "target": "vw__bronze__events", "params": '{"mergeSchema": false}'}],
        transformations=[
            {"origin": "vw__bronze__events", "target": "vw__silver__events", "column_order": 1,
             "source_column_name": "event_id", "source_column_type": None,
             "dest_column_name": "event_id", "dest_column_type": "int", "validations": silver_rule},
            {"origin": "vw__bronze__events", "target": "vw__silver__events", "column_order": 2,
             "source_column_name": "event_type", "dest_column_name": "kind", "dest_column_type": "string"},
            {"origin": "vw__bronze__events", "target": "vw__silver__events", "column_order": 3,
             "source_column_name": "value", "source_column_type": "double",
             "dest_column_name": "amount", "dest_column_type": "double", "default_value": "0"},
            {"origin": "vw__bronze__events", "target": "vw__silver__events", "column_order": 4,
             "source_column_name": "ts", "dest_column_name": "event_ts", "dest_column_type": "timestamp"},
            # declared before its input exists: the runner orders stages by what the SQL reads
            {"origin": "vw__silver__events", "target": "vw__gold__event_stats",
             "sql_query": "SELECT kind AS event_type, count(*) AS n, round(avg(amount), 6) AS avg_value "
                          "FROM vw__silver__events GROUP BY kind"},
        ],
    )


@register("end_to_end", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value
FROM events WHERE value >= 5.0 GROUP BY event_type
""")
def q_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = PipelineRun(spark, end_to_end_spec(sf_dir))
    return run.run(write=False).relations["vw__gold__event_stats"]


# ------------------------------------------------------------------ sources, mapping, SQL stages

from sluice.functions.text import WHITESPACE_CLASS, digit_parse, path_identity, resolve_against  # noqa: E402
from sluice.operators.mapping import ColumnSpec, apply_column_map, run_sql  # noqa: E402
from sluice.operators.quality import (Rule, audit, audit_constraints, conflicting_rules,  # noqa: E402
                                      drop_violations, duplicate_keys, without_match)
from sluice.sources.declared import read_source  # noqa: E402

_WS = WHITESPACE_CLASS  # the same class text is valid in Java regex and RE2 (DuckDB)


def _duck_strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"


@register("source_read", "SELECT * FROM events")
def q_source_read(spark, sf_dir):
    return read_source(spark, f"{sf_dir.rstrip('/')}/events.parquet", "parquet",
                       '{"mergeSchema": false, "datetimeRebaseMode": "CORRECTED"}')


@register("map_project", """
SELECT CAST(o_orderkey AS INTEGER) AS order_key, CAST(o_custkey AS INTEGER) AS customer_key,
       CAST(o_orderdate AS DATE) AS order_date, o_orderstatus AS status, o_totalprice AS total_price
FROM orders
""")
def q_map_project(spark, sf_dir):
    specs = [  # listed out of order on purpose; column_order decides
        ColumnSpec("o_orderstatus", "status", "string", "string", column_order=4),
        ColumnSpec("o_orderkey", "order_key", None, "int", column_order=1),
        ColumnSpec("o_totalprice", "total_price", "double", "double", column_order=5),
        ColumnSpec("o_custkey", "customer_key", None, "int", column_order=2),
        ColumnSpec("o_orderdate", "order_date", "timestamp", "date", column_order=3),
    ]
    return apply_column_map(table(spark, sf_dir, "orders"), specs)


@register("map_cast_default", """
SELECT o_orderkey,
       coalesce(TRY_CAST(o_orderpriority AS INTEGER), -1) AS priority_code,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority_rank,
       CAST(trunc(o_totalprice) AS INTEGER) AS total_int,
       DATE '1970-01-01' AS fallback_date,
       CAST(o_orderstatus = 'F' AS BOOLEAN) AS is_final
FROM orders
""")
def q_map_cast_default(spark, sf_dir):
    specs = [
        ColumnSpec("o_orderkey", column_order=1),
        ColumnSpec("o_orderpriority", "priority_code", "string", "int", default_value="-1", column_order=2),
        ColumnSpec(None, "priority_rank", None, "int", transform_function="substring(o_orderpriority, 1, 1)",
                   column_order=3),
        ColumnSpec("o_totalprice", "total_int", "double", "int", column_order=4),
        ColumnSpec("o_orderpriority", "fallback_date", "string", "date", default_value="1970-01-01",
                   column_order=5),
        ColumnSpec(None, "is_final", None, "boolean", transform_function="F.col('o_orderstatus') == 'F'",
                   column_order=6),
    ]
    return apply_column_map(table(spark, sf_dir, "orders"), specs)


@register("map_transform_ts", """
SELECT event_id, strftime(ts, '%d-%m-%Y %H:%M:%S') AS ts_text, date_trunc('second', ts) AS ts_parsed
FROM events
""")
def q_map_transform_ts(spark, sf_dir):
    fmt = "dd-MM-yyyy HH:mm:ss"
    spec = PipelineSpec(
        sources=[{"origin": f"{sf_dir.rstrip('/')}/events.parquet", "datatype": "parquet", "target": "raw"}],
        transformations=[
            {"origin": "raw", "target": "as_text", "column_order": 1, "source_column_name": "event_id"},
            {"origin": "raw", "target": "as_text", "column_order": 2, "dest_column_name": "ts_text",
             "dest_column_type": "string", "transform_function": f"F.date_format(F.col('ts'), '{fmt}')"},
            {"origin": "as_text", "target": "parsed", "column_order": 1, "source_column_name": "event_id"},
            {"origin": "as_text", "target": "parsed", "column_order": 2, "source_column_name": "ts_text"},
            {"origin": "as_text", "target": "parsed", "column_order": 3, "dest_column_name": "ts_parsed",
             "dest_column_type": "timestamp",
             "transform_function": f"F.to_timestamp_ntz(F.col('ts_text'), F.lit('{fmt}'))"},
        ],
    )
    parsed = PipelineRun(spark, spec).run(write=False).relations["parsed"]
    return parsed.withColumn("ts_parsed", F.col("ts_parsed").cast("timestamp_ntz"))  # compared without a zone


def _sql_stage_spec(sf_dir: str) -> PipelineSpec:
    """orders -> spending per customer and priority -> the urgent part of it (declared in reverse)."""
    return PipelineSpec(
        sources=[{"origin": f"{sf_dir.rstrip('/')}/orders.parquet", "datatype": "parquet", "target": "vw__bronze__orders"}],
        transformations=[
            {"origin": "vw__silver__spending", "target": "vw__gold__urgent_spending",
             "sql_query": "SELECT * FROM vw__silver__spending WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
             "validations": [{"validation_rule": "mean_price > 1000", "validation_action": "DROP"}]},
            {"origin": "vw__bronze__orders", "target": "vw__silver__spending",
             "sql_query": "SELECT o_custkey, o_orderpriority, count(*) AS n_orders, round(avg(o_totalprice), 6) AS mean_price "
                          "FROM vw__bronze__orders GROUP BY o_custkey, o_orderpriority"},
        ],
    )


_SQL_GROUP_AVG = """
SELECT o_custkey, o_orderpriority, count(*) AS n_orders, round(avg(o_totalprice), 6) AS mean_price
FROM orders GROUP BY o_custkey, o_orderpriority
"""


@register("sql_group_avg", _SQL_GROUP_AVG)
def q_sql_group_avg(spark, sf_dir):
    return PipelineRun(spark, _sql_stage_spec(sf_dir)).run(write=False).relations["vw__silver__spending"]


@register("sql_in_filter", f"SELECT * FROM ({_SQL_GROUP_AVG}) WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND mean_price > 1000")
def q_sql_in_filter(spark, sf_dir):
    return PipelineRun(spark, _sql_stage_spec(sf_dir)).run(write=False).relations["vw__gold__urgent_spending"]


@register("sql_stage_join", """
SELECT n_name AS nation, count(*) AS suppliers, round(sum(s_acctbal), 2) AS acctbal
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
""")
def q_sql_stage_join(spark, sf_dir):
    """A SQL stage reading two published sources (run_sql with explicit views)."""
    child = spark.newSession()
    views = {"sup": read_source(child, f"{sf_dir.rstrip('/')}/supplier.parquet", "parquet"),
             "nat": read_source(child, f"{sf_dir.rstrip('/')}/nation.parquet", "parquet")}
    return run_sql(child, "SELECT n_name AS nation, count(*) AS suppliers, round(sum(s_acctbal), 2) AS acctbal "
                          "FROM sup JOIN nat ON s_nationkey = n_nationkey GROUP BY n_name", views)


# ------------------------------------------------------------------ data-quality rules

@register("validate_drop", "SELECT * FROM lineitem WHERE l_discount > 0")
def q_validate_drop(spark, sf_dir):
    return drop_violations(table(spark, sf_dir, "lineitem"), [Rule("l_discount > 0", "DROP")])


@register("validate_log", """
SELECT 'value >= 5.0' AS rule, 'LOG' AS action, count(*) AS checked,
       count(*) FILTER (WHERE NOT coalesce(value >= 5.0, false)) AS violations
FROM events
""")
def q_validate_log(spark, sf_dir):
    return audit(table(spark, sf_dir, "events"), [Rule("value >= 5.0", "LOG")])


_MULTI = [Rule("value >= 5.0", "LOG"), Rule("event_type <> 'error'", "DROP")]


@register("validate_multi", "SELECT * FROM events WHERE event_type <> 'error'")
def q_validate_multi(spark, sf_dir):
    return drop_violations(table(spark, sf_dir, "events"), _MULTI)


@register("validate_multi_audit", """
SELECT 'value >= 5.0' AS rule, 'LOG' AS action, count(*) AS checked,
       count(*) FILTER (WHERE NOT coalesce(value >= 5.0, false)) AS violations FROM events
UNION ALL
SELECT 'event_type <> ''error''', 'DROP', count(*),
       count(*) FILTER (WHERE NOT coalesce(event_type <> 'error', false)) FROM events
""")
def q_validate_multi_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "events"), _MULTI)


@register("validate_fail_audit", """
SELECT 'l_quantity > 0' AS rule, 'FAIL' AS action, count(*) AS checked,
       count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) AS violations FROM lineitem
UNION ALL
SELECT 'l_shipdate < ''2001-10-01''', 'FAIL', count(*),
       count(*) FILTER (WHERE NOT coalesce(l_shipdate < '2001-10-01', false)) FROM lineitem
""")
def q_validate_fail_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "lineitem"),
                 [Rule("l_quantity > 0", "FAIL"), Rule("l_shipdate < '2001-10-01'", "FAIL")])


@register("conflicting_rules", f"""
WITH k AS (SELECT doc_id, lang, {_duck_strip('text')} AS rule_key FROM documents),
     g AS (SELECT rule_key, count(*) AS n_actions FROM k GROUP BY rule_key HAVING count(*) > 1)
SELECT md5(rule_key) AS rule_md5, n_actions, doc_id, lang FROM k JOIN g USING (rule_key)
""")
def q_conflicting_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = conflicting_rules(docs, "text", "lang", "doc_id", key="md5")
    return out.select(F.col("rule_key").alias("rule_md5"), "n_actions", "doc_id", "lang")


@register("constraint_audit", f"""
SELECT c_custkey, concat_ws(',',
    CASE WHEN c_acctbal < 0 THEN 'negative_balance' END,
    CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') THEN 'segment_not_allowed' END,
    CASE WHEN regexp_matches(c_name, '^{_WS}*$') THEN 'blank_name' END) AS violations
FROM customer
""")
def q_constraint_audit(spark, sf_dir):
    from sluice.functions.text import is_blank
    cust = table(spark, sf_dir, "customer")
    checks = {
        "negative_balance": F.col("c_acctbal") < 0,
        "segment_not_allowed": ~F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"),
        "blank_name": is_blank("c_name"),
    }
    return audit_constraints(cust, checks).select("c_custkey", F.array_join("violations", ",").alias("violations"))


@register("xor_audit", """
WITH t AS (
  SELECT event_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'src_col' END AS source_column_name,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'dst_col' END AS dest_column_name,
         CASE WHEN event_type IN ('click', 'error') THEN 'SELECT 1' END AS sql_query
  FROM events)
SELECT event_id, concat_ws(',',
    CASE WHEN source_column_name IS NULL AND dest_column_name IS NULL AND sql_query IS NULL
         THEN 'no_transformation' END,
    CASE WHEN source_column_name <> '' AND dest_column_name <> '' AND sql_query <> ''
         THEN 'mapping_and_sql' END) AS violations,
  concat_ws(',',
    CASE WHEN source_column_name IS NULL AND dest_column_name IS NULL AND sql_query IS NULL
         THEN 'no_transformation' END,
    CASE WHEN sql_query <> '' AND (source_column_name <> '' OR dest_column_name <> '')
         THEN 'mapping_and_sql' END) AS strict_violations
FROM t
""")
def q_xor_audit(spark, sf_dir):
    from sluice.operators.stages import xor_checks
    ev = table(spark, sf_dir, "events")
    rows = ev.select(
        "event_id",
        F.when(F.col("event_type").isin("click", "view"), F.lit("src_col")).alias("source_column_name"),
        F.when(F.col("event_type").isin("click", "purchase"), F.lit("dst_col")).alias("dest_column_name"),
        F.when(F.col("event_type").isin("click", "error"), F.lit("SELECT 1")).alias("sql_query"),
    )
    out = audit_constraints(rows, xor_checks(False), "v1")
    out = audit_constraints(out, xor_checks(True), "v2")
    return out.select("event_id", F.array_join("v1", ",").alias("violations"),
                      F.array_join("v2", ",").alias("strict_violations"))


@register("destination_audit", """
WITH d AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'F' THEN 'upsert' WHEN o_orderstatus = 'O' THEN 'append' ELSE 'merge' END AS mode,
         CASE WHEN o_orderpriority LIKE '1%' THEN [] ELSE ['o_custkey'] END AS keys,
         CASE WHEN o_orderpriority LIKE '2%' THEN NULL ELSE 'o_orderdate' END AS sequence_by
  FROM orders)
SELECT o_orderkey, concat_ws(',',
    CASE WHEN mode NOT IN ('append', 'upsert') THEN 'bad_mode' END,
    CASE WHEN mode = 'upsert' AND (len(keys) = 0 OR sequence_by IS NULL)
         THEN 'upsert_without_keys_or_sequence' END) AS violations
FROM d
""")
def q_destination_audit(spark, sf_dir):
    from sluice.operators.stages import upsert_incomplete
    o = table(spark, sf_dir, "orders")
    d = o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "upsert").when(F.col("o_orderstatus") == "O", "append")
         .otherwise("merge").alias("mode"),
        F.when(F.col("o_orderpriority").startswith("1"), F.array().cast("array<string>"))
         .otherwise(F.array(F.lit("o_custkey"))).alias("keys"),
        F.when(~F.col("o_orderpriority").startswith("2"), F.lit("o_orderdate")).alias("sequence_by"),
    )
    checks = {"bad_mode": ~F.col("mode").isin("append", "upsert"),
              "upsert_without_keys_or_sequence": upsert_incomplete(F.col("mode"), F.col("keys"), F.col("sequence_by"))}
    return audit_constraints(d, checks).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@register("no_stage", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_no_stage(spark, sf_dir):
    return without_match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@register("duplicate_targets", """
SELECT target, count(*) AS n FROM (
  SELECT n_nationkey AS target FROM nation
  UNION ALL SELECT r_regionkey FROM region
  UNION ALL SELECT s_nationkey FROM supplier)
GROUP BY target HAVING count(*) > 1
""")
def q_duplicate_targets(spark, sf_dir):
    from sluice.operators.stages import duplicate_targets
    targets = (table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("target"))
               .unionByName(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("target")))
               .unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("target"))))
    return duplicate_targets(targets, [])


@register("ambiguous_keys", """
SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1
""")
def q_ambiguous_keys(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"])


# ------------------------------------------------------------------ reconciliation

from sluice.operators import reconcile as R  # noqa: E402

_CUTOFF = "1998-01-01"
_DUCK_DEPLOYED = f"""
deployed AS (
  SELECT 'cust-' || o_custkey AS name, CAST(arg_max(o_orderkey, o_orderkey) AS VARCHAR) AS pipeline_id
  FROM orders WHERE o_orderdate < TIMESTAMP '{_CUTOFF}' GROUP BY o_custkey),
declared AS (
  SELECT DISTINCT 'main' AS target_catalog_name, 'sales' AS target_schema_name, 'cust-' || o_custkey AS name,
         CAST(NULL AS VARCHAR) AS pipeline_id
  FROM orders WHERE o_orderdate >= TIMESTAMP '{_CUTOFF}')
"""


def _deployed_raw(spark, sf_dir):
    """Every old order is a 'deployed pipeline' record; names repeat, later records win."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit(_CUTOFF).cast("timestamp_ntz"))
    return o.select(F.concat(F.lit("cust-"), F.col("o_custkey")).alias("name"),
                    F.col("o_orderkey").cast("string").alias("pipeline_id"), F.col("o_orderkey").alias("pos"))


def _deployed(spark, sf_dir):
    return R.last_by(_deployed_raw(spark, sf_dir), "name", "pipeline_id", "pos")


def _declared(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit(_CUTOFF).cast("timestamp_ntz"))
    stage = o.select(F.lit("main").alias("target_catalog_name"), F.lit("sales").alias("target_schema_name"),
                     F.concat(F.lit("cust-"), F.col("o_custkey")).alias("pipeline_name"))
    return R.inventory(spark, stage)


@register("reconcile_obsolete", f"WITH {_DUCK_DEPLOYED} SELECT * FROM deployed WHERE name NOT IN (SELECT name FROM declared)")
def q_reconcile_obsolete(spark, sf_dir):
    return R.obsolete(_deployed(spark, sf_dir), _declared(spark, sf_dir))


@register("reconcile_new", f"WITH {_DUCK_DEPLOYED} SELECT * FROM declared WHERE name NOT IN (SELECT name FROM deployed)")
def q_reconcile_new(spark, sf_dir):
    return R.new(_declared(spark, sf_dir), _deployed(spark, sf_dir))


@register("reconcile_matching", f"""WITH {_DUCK_DEPLOYED}
SELECT target_catalog_name, target_schema_name, name, deployed.pipeline_id
FROM declared JOIN deployed USING (name)""")
def q_reconcile_matching(spark, sf_dir):
    return R.matching(_declared(spark, sf_dir), _deployed_raw(spark, sf_dir), order="pos")


_DUCK_WANTED = """
SELECT target_catalog_name, target_schema_name, declared.name AS name, coalesce(declared.pipeline_id, deployed.pipeline_id) AS pipeline_id,
       CASE WHEN coalesce(declared.pipeline_id, deployed.pipeline_id) IS NULL THEN 'create' ELSE 'update' END AS action
FROM declared LEFT JOIN deployed ON declared.name = deployed.name
"""


@register("deploy_plan", f"""WITH {_DUCK_DEPLOYED} {_DUCK_WANTED}
UNION ALL
SELECT NULL, NULL, 'cust-' || o_custkey, CAST(o_orderkey AS VARCHAR), 'delete' FROM orders
WHERE o_orderdate < TIMESTAMP '{_CUTOFF}' AND 'cust-' || o_custkey NOT IN (SELECT name FROM declared)""")
def q_deploy_plan(spark, sf_dir):
    return R.deploy_plan(_declared(spark, sf_dir), _deployed_raw(spark, sf_dir), order="pos")


@register("deploy_plan_safe", f"WITH {_DUCK_DEPLOYED} {_DUCK_WANTED}")
def q_deploy_plan_safe(spark, sf_dir):
    return R.deploy_plan(_declared(spark, sf_dir), _deployed_raw(spark, sf_dir), order="pos", destructive=False)


@register("deploy_targets", f"""WITH {_DUCK_DEPLOYED}
SELECT * FROM declared WHERE name NOT IN (SELECT name FROM deployed)
UNION ALL
SELECT target_catalog_name, target_schema_name, name, deployed.pipeline_id FROM declared JOIN deployed USING (name)""")
def q_deploy_targets(spark, sf_dir):
    """New pipelines (no id yet) plus matching ones (deployed id): the create-or-update input list."""
    return R.deploy_targets(_declared(spark, sf_dir), _deployed_raw(spark, sf_dir), order="pos")


@register("or_semi_join", f"""
SELECT * FROM supplier s WHERE EXISTS (
  SELECT 1 FROM customer c WHERE c.c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{_CUTOFF}')
    AND (c.c_custkey = s.s_suppkey OR c.c_nationkey = s.s_nationkey))
""")
def q_or_semi_join(spark, sf_dir):
    """Suppliers that share key or nation with an obsolete customer: one that no order since the cutoff names."""
    declared = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit(_CUTOFF).cast("timestamp_ntz"))
    obsolete = R.obsolete(table(spark, sf_dir, "customer"), declared.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return R.or_semi_join(table(spark, sf_dir, "supplier"), obsolete,
                          [("s_suppkey", "c_custkey"), ("s_nationkey", "c_nationkey")])


@register("lookup_first", """
SELECT c_custkey, f.first_price FROM customer LEFT JOIN
  (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price FROM orders GROUP BY o_custkey) f
  ON c_custkey = f.o_custkey
""")
def q_lookup_first(spark, sf_dir):
    return R.lookup(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"),
                    "o_custkey", "o_totalprice", "o_orderkey", first=True, out="first_price",
                    left_key="c_custkey")


@register("lookup_last", """
SELECT c_custkey, f.last_price FROM customer LEFT JOIN
  (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY o_custkey) f
  ON c_custkey = f.o_custkey
""")
def q_lookup_last(spark, sf_dir):
    return R.lookup(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"),
                    "o_custkey", "o_totalprice", "o_orderkey", first=False, out="last_price",
                    left_key="c_custkey")


@register("inventory", """
SELECT DISTINCT 'events' AS target_catalog_name, event_type AS target_schema_name,
       'user-' || user_id AS name, CAST(NULL AS VARCHAR) AS pipeline_id
FROM events WHERE value < 5 OR value >= 3 OR event_type = 'click'
""")
def q_inventory(spark, sf_dir):
    ev = table(spark, sf_dir, "events")

    def stage(pred):
        return ev.filter(pred).select(F.lit("events").alias("target_catalog_name"),
                                      F.col("event_type").alias("target_schema_name"),
                                      F.concat(F.lit("user-"), F.col("user_id")).alias("pipeline_name"))
    return R.inventory(spark, stage("value < 5"), stage("value >= 3"), stage("event_type = 'click'"))


@register("top1_under_predicate", """
SELECT * FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')
ORDER BY p_size, p_retailprice, p_partkey LIMIT 1
""")
def q_top1(spark, sf_dir):
    return R.top1(table(spark, sf_dir, "part"), F.col("p_type").isin("ECONOMY", "STANDARD"),
                  ["p_size", "p_retailprice", "p_partkey"])


# ------------------------------------------------------------------ arrays, paths, JSON

from sluice.functions.text import file_suffix  # noqa: E402
from sluice.operators.stages import (expand_column_maps, explode_elements, first_element_field,  # noqa: E402
                                     fold_validation, has_elements)


@register("first_element", """
SELECT conv_id, turn, t[1] AS first_line, CAST(len(t) AS INTEGER) AS n_tasks
FROM (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS t FROM conversations)
WHERE len(t) > 0
""")
def q_first_element(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    tasks = F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""),
                        lambda x, i: F.struct(i.alias("idx"), x.alias("line")))
    rows = conv.select("conv_id", "turn", tasks.alias("tasks"))
    return rows.filter(has_elements("tasks")).select(
        "conv_id", "turn", first_element_field("tasks", "line").alias("first_line"),
        F.size("tasks").alias("n_tasks"))


@register("stage_flatten", """
SELECT conv_id, turn, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS line
FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations)
""")
def q_stage_flatten(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return explode_elements(conv, F.split("text", "\n"), "pos", "line", keep=["conv_id", "turn"])


@register("path_identity", """
SELECT page_id, string_split(url, '/')[-4] AS target_catalog_name, string_split(url, '/')[-3] AS target_schema_name,
       string_split(url, '/')[-2] AS pipeline_name FROM pages
""")
def q_path_identity(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *path_identity("url"))


@register("path_resolve", """
WITH p AS (
  SELECT page_id, '/srv/pages/' || page_id AS base,
         CASE WHEN regexp_extract(url, '^https?://[^/]+/(.*)$', 1) LIKE 'en%'
              THEN '/' || regexp_extract(url, '^https?://[^/]+/(.*)$', 1)
              ELSE regexp_extract(url, '^https?://[^/]+/(.*)$', 1) END AS rel
  FROM pages)
SELECT page_id,
       CASE WHEN rel IS NULL OR rel = '' THEN NULL
            WHEN starts_with(rel, '/') THEN regexp_replace(rel, '/(\\./)+', '/', 'g')
            ELSE regexp_replace(base || '/' || rel, '/(\\./)+', '/', 'g') END AS config_path,
       lower(regexp_extract(rel, '[^/](\\.[^./]*)$', 1)) AS suffix
FROM p
""")
def q_path_resolve(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rel0 = F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1)
    rel = F.when(rel0.startswith("en"), F.concat(F.lit("/"), rel0)).otherwise(rel0)
    base = F.concat(F.lit("/srv/pages/"), F.col("page_id"))
    return pages.select("page_id", resolve_against(rel, base).alias("config_path"),
                        file_suffix(rel).alias("suffix"))


@register("config_expand", """
WITH r AS (
  SELECT n_regionkey, n_nationkey, n_name, 'length(' || n_name || ') > 3' AS rule,
         CASE WHEN n_name < 'F' THEN 'DROP' WHEN n_name < 'P' THEN 'LOG' ELSE '' END AS action FROM nation)
SELECT r_name AS origin, 'vw__' || lower(r_name) AS target, n_nationkey AS column_order, n_name AS source_column_name,
       CASE WHEN action <> '' THEN 1 ELSE 0 END AS n_validations,
       CASE WHEN action <> '' THEN rule END AS first_rule
FROM region JOIN r ON r_regionkey = n_regionkey
""")
def q_config_expand(spark, sf_dir):
    parents = table(spark, sf_dir, "region").select(
        "r_regionkey", F.col("r_name").alias("origin"),
        F.concat(F.lit("vw__"), F.lower("r_name")).alias("target"))
    n = table(spark, sf_dir, "nation")
    rows = n.select(
        "n_regionkey", F.col("n_nationkey").alias("column_order"), F.col("n_name").alias("source_column_name"),
        fold_validation(F.concat(F.lit("length("), F.col("n_name"), F.lit(") > 3")),
                        F.when(F.col("n_name") < "F", "DROP").when(F.col("n_name") < "P", "LOG")
                         .otherwise("")).alias("validations"))
    out = expand_column_maps(parents, rows, "r_regionkey", "n_regionkey", ["origin", "target"])
    return out.select("origin", "target", "column_order", "source_column_name",
                      F.coalesce(F.size("validations"), F.lit(0)).alias("n_validations"),
                      first_element_field("validations", "validation_rule").alias("first_rule"))


@register("digit_parse", """
SELECT o_orderkey,
  CASE WHEN regexp_full_match(split_part(o_orderpriority, '-', 1), '[0-9]+')
       THEN TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) END AS priority_digit,
  CASE WHEN regexp_full_match(o_orderstatus, '[0-9]+') THEN TRY_CAST(o_orderstatus AS INTEGER) END AS status_digit,
  CASE WHEN regexp_full_match(o_orderpriority, '[0-9]+') THEN TRY_CAST(o_orderpriority AS INTEGER) END AS priority_whole
FROM orders
""")
def q_digit_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", digit_parse(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("priority_digit"),
                    digit_parse("o_orderstatus").alias("status_digit"),
                    digit_parse("o_orderpriority").alias("priority_whole"))


@register("json_params", """
SELECT event_id, json_extract_string(props, '$.k') AS k,
       CAST(to_json(map(['k'], [json_extract_string(props, '$.k')])) AS VARCHAR) AS params_json
FROM events
""")
def q_json_params(spark, sf_dir):
    from sluice.functions.json import decode_params, encode_params
    ev = table(spark, sf_dir, "events").select("event_id", decode_params("props").alias("params"))
    return ev.select("event_id", F.col("params")["k"].alias("k"),
                     encode_params("params", ev.schema["params"].dataType).alias("params_json"))


# ------------------------------------------------------------------ sanitize

from sluice.functions.sanitize import is_empty, sanitize_frame  # noqa: E402


def _nested_conversations(spark, sf_dir):
    """Nested values with blanks, derived from the conversation turns."""
    conv = table(spark, sf_dir, "conversations")
    body = (F.when(F.col("turn") % 4 == 0, F.lit(""))
            .when(F.col("turn") % 4 == 1, F.lit(" 　\t")).otherwise(F.col("text")))
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) < 25, F.lit("")).otherwise(x))
    meta = F.struct(F.when(F.col("role") != "user", F.col("role")).alias("who"),
                    (F.col("turn") % 2).cast("double").alias("parity"))
    tags = F.create_map(F.lit("role"), F.col("role"), F.lit("pad"),
                        F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.lit("x")))
    return conv.select("conv_id", "turn", body.alias("body"), lines.alias("lines"), meta.alias("meta"),
                       tags.alias("tags"))


_DUCK_NESTED = f"""
nested AS (
  SELECT conv_id, turn, role,
         CASE WHEN turn % 4 = 0 THEN '' WHEN turn % 4 = 1 THEN ' ' || chr(12288) || chr(9) ELSE text END AS body,
         list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) < 25 THEN '' ELSE x END) AS lines
  FROM conversations)
"""


@register("is_empty", f"""WITH {_DUCK_NESTED}
SELECT conv_id, turn, regexp_matches(body, '^{_WS}*$') AS body_empty,
       len(list_filter(lines, lambda x: x IS NOT NULL AND x <> '')) = 0 AS lines_empty,
       (role = 'user' AND turn % 2 = 0) AS meta_empty,
       turn % 2 = 0 AS tags_empty_after_role_blanked
FROM nested
""")
def q_is_empty(spark, sf_dir):
    df = _nested_conversations(spark, sf_dir)
    s = df.schema
    blanked = F.map_filter("tags", lambda k, v: k != "role")
    return df.select("conv_id", "turn", is_empty(F.col("body"), s["body"].dataType).alias("body_empty"),
                     is_empty(F.col("lines"), s["lines"].dataType).alias("lines_empty"),
                     is_empty(F.col("meta"), s["meta"].dataType).alias("meta_empty"),
                     is_empty(blanked, s["tags"].dataType).alias("tags_empty_after_role_blanked"))


def _sanitized_summary(df):
    return df.select(
        "conv_id", "turn", "body",
        F.col("lines").isNull().alias("lines_null"),
        F.size(F.filter("lines", lambda x: x.isNull())).alias("n_null_lines"),
        F.size("lines").alias("n_lines"),
        F.col("meta").isNull().alias("meta_null"),
        F.col("meta.who").alias("meta_who"),
        F.array_join(F.sort_array(F.map_keys("tags")), ",").alias("tag_keys"),
    )


@register("sanitize_null", f"""WITH {_DUCK_NESTED}, f AS (
  SELECT *, len(list_filter(lines, lambda x: x <> '')) = 0 AS lines_empty FROM nested)
SELECT conv_id, turn, CASE WHEN regexp_matches(body, '^{_WS}*$') THEN NULL ELSE body END AS body,
       lines_empty AS lines_null,
       CASE WHEN lines_empty THEN NULL ELSE CAST(len(list_filter(lines, lambda x: x = '')) AS INTEGER) END AS n_null_lines,
       CASE WHEN lines_empty THEN NULL ELSE CAST(len(lines) AS INTEGER) END AS n_lines,
       (role = 'user' AND turn % 2 = 0) AS meta_null,
       CASE WHEN role <> 'user' THEN role END AS meta_who,
       'pad,role' AS tag_keys
FROM f
""")
def q_sanitize_null(spark, sf_dir):
    return _sanitized_summary(sanitize_frame(_nested_conversations(spark, sf_dir), drop_empty=False))


@register("sanitize_drop", f"""WITH {_DUCK_NESTED}, f AS (
  SELECT *, len(list_filter(lines, lambda x: x <> '')) = 0 AS lines_empty FROM nested)
SELECT conv_id, turn, CASE WHEN regexp_matches(body, '^{_WS}*$') THEN NULL ELSE body END AS body,
       lines_empty AS lines_null,
       CASE WHEN lines_empty THEN NULL ELSE 0 END AS n_null_lines,
       CASE WHEN lines_empty THEN NULL ELSE CAST(len(list_filter(lines, lambda x: x <> '')) AS INTEGER) END AS n_lines,
       (role = 'user' AND turn % 2 = 0) AS meta_null,
       CASE WHEN role <> 'user' THEN role END AS meta_who,
       CASE WHEN turn % 2 = 0 THEN 'role' ELSE 'pad,role' END AS tag_keys
FROM f
""")
def q_sanitize_drop(spark, sf_dir):
    return _sanitized_summary(sanitize_frame(_nested_conversations(spark, sf_dir), drop_empty=True))


@register("key_rename", """
SELECT event_id, user_id, CAST(user_id AS VARCHAR) AS kx, 1 AS n_keys, event_type AS s_ab FROM events
""")
def q_key_rename(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("user.id"),
        F.create_map(F.lit("k.x"), F.col("event_type"), F.lit("k_x"), F.col("user_id").cast("string")).alias("m.props"),
        F.struct(F.col("event_type").alias("a.b"), F.col("value").alias("c")).alias("s"))
    clean = sanitize_frame(ev)
    return clean.select("event_id", "user_id", F.col("m_props")["k_x"].alias("kx"),
                        F.size("m_props").alias("n_keys"), F.col("s.a_b").alias("s_ab"))


# ------------------------------------------------------------------ sinks and upsert

from sluice.operators.upsert import upsert  # noqa: E402
from sluice.session import scratch_root  # noqa: E402
from sluice.sinks import batches  # noqa: E402
from sluice.sinks.tables import append, create_database, overwrite_table  # noqa: E402
from sluice.sinks.upsert_store import UpsertStore  # noqa: E402


@register("append_sink", "SELECT * FROM orders UNION ALL SELECT * FROM orders")
def q_append_sink(spark, sf_dir):
    path = scratch_root(spark, "append_sink")
    orders = table(spark, sf_dir, "orders")
    append(orders, path=path)
    append(orders, path=path)
    return batches.read_batches(spark, path)


@register("metadata_roundtrip", "SELECT * FROM orders")
def q_metadata_roundtrip(spark, sf_dir):
    """CREATE DATABASE + overwrite twice (the second replaces the first) + table scan."""
    path = scratch_root(spark, "metadata_roundtrip")
    name = f"sluice_roundtrip.orders_{path.rsplit('/', 1)[1]}"  # of this call alone: sessions may share the catalog
    create_database(spark, "sluice_roundtrip")
    orders = table(spark, sf_dir, "orders")
    overwrite_table(orders.where(F.lit(False)).drop("o_orderpriority"), name, path=path)
    overwrite_table(orders, name, path=path)
    return spark.table(name)


_SPLIT = "1996-01-01"
_LATEST_ORDER = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_orderdate DESC, o_orderkey DESC, o_orderstatus DESC, o_totalprice DESC, o_orderpriority DESC) AS rn
  FROM orders) WHERE rn = 1
"""


def _order_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    split = F.lit(_SPLIT).cast("timestamp_ntz")
    return o.filter(F.col("o_orderdate") < split), o.filter(F.col("o_orderdate") >= split)


@register("upsert_batch", _LATEST_ORDER)
def q_upsert_batch(spark, sf_dir):
    """Stored history (before the split date) + a newer batch: latest order per customer."""
    older, newer = _order_history(spark, sf_dir)
    return upsert(older, newer, ["o_custkey"], "o_orderdate")


@register("upsert_out_of_order", _LATEST_ORDER)
def q_upsert_out_of_order(spark, sf_dir):
    """The newer rows arrive first, the older batch later: the result must not change."""
    older, newer = _order_history(spark, sf_dir)
    return upsert(upsert(None, newer, ["o_custkey"], "o_orderdate"), older, ["o_custkey"], "o_orderdate")


@register("upsert_persisted", _LATEST_ORDER)
def q_upsert_persisted(spark, sf_dir):
    """Two appended batches of one stream, the second replayed: it replaces itself."""
    older, newer = _order_history(spark, sf_dir)
    store = UpsertStore(spark, scratch_root(spark, "upsert_persisted"), ["o_custkey"], "o_orderdate")
    store.merge(older, "stream-a", 0)
    store.merge(newer, "stream-a", 1)
    store.merge(newer, "stream-a", 1)
    return store.read().select(*table(spark, sf_dir, "orders").columns)


@register("upsert_compacted", _LATEST_ORDER)
def q_upsert_compacted(spark, sf_dir):
    """Batch 0 of two streams and a run of its own in one store, compacted, then one of them again."""
    older, newer = _order_history(spark, sf_dir)
    store = UpsertStore(spark, scratch_root(spark, "upsert_compacted"), ["o_custkey"], "o_orderdate")
    store.merge(newer, "stream-b", 0)
    store.merge(older, "stream-a", 0)
    store.merge(older)
    store.compact()
    store.merge(older, "stream-a", 0)
    return store.read().select(*table(spark, sf_dir, "orders").columns)


@register("upsert_new_column", """
SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderdate >= '1996-01-01' THEN o_orderpriority END AS o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
""")
def q_upsert_new_column(spark, sf_dir):
    """The second batch adds a column: kept where it is known, NULL in rows stored before."""
    older, newer = (df.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority") for df in _order_history(spark, sf_dir))
    store = UpsertStore(spark, scratch_root(spark, "upsert_new_column"), ["o_custkey"], "o_orderdate")
    store.merge(older.drop("o_orderpriority"), "stream-a", 0)
    store.merge(newer, "stream-a", 1)
    return store.read()


# ------------------------------------------------------------------ streaming

from sluice.streaming.stream import append_stream, stream_source, upsert_stream  # noqa: E402


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return stream_source(spark, sf_dir.rstrip("/"), "parquet", {"pathGlobFilter": "events.parquet"}, schema=schema)


@register("stream_append", """
SELECT event_id, user_id, event_type AS kind, value AS amount, ts FROM events WHERE value >= 5.0
""")
def q_stream_append(spark, sf_dir):
    root = scratch_root(spark, "stream_append")
    mapped = apply_column_map(_event_stream(spark, sf_dir), [
        ColumnSpec("event_id", column_order=1), ColumnSpec("user_id", column_order=2),
        ColumnSpec("event_type", "kind", column_order=3), ColumnSpec("value", "amount", "double", "double", column_order=4),
        ColumnSpec("ts", column_order=5)])
    q = append_stream(mapped, f"{root}/out", f"{root}/chk", [Rule("amount >= 5.0", "DROP")])
    q.awaitTermination()
    return batches.read_batches(spark, f"{root}/out")


@register("two_stream_append", "SELECT * FROM events UNION ALL SELECT * FROM events WHERE value >= 5.0 UNION ALL SELECT * FROM events")
def q_two_stream_append(spark, sf_dir):
    """Two streams with checkpoints of their own and a batch run append to one path: all rows of all three."""
    root = scratch_root(spark, "two_stream_append")
    events = _event_stream(spark, sf_dir)
    append_stream(events, f"{root}/out", f"{root}/chk_a").awaitTermination()
    append_stream(events, f"{root}/out", f"{root}/chk_b", [Rule("value >= 5.0", "DROP")]).awaitTermination()
    append(table(spark, sf_dir, "events"), path=f"{root}/out")
    return batches.read_batches(spark, f"{root}/out")


@register("two_stream_upsert", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_id DESC, event_type DESC, value DESC, props DESC) AS rn FROM events) WHERE rn = 1
""")
def q_two_stream_upsert(spark, sf_dir):
    """Two streams, each with a part of the events, upsert into one store."""
    root = scratch_root(spark, "two_stream_upsert")
    store = UpsertStore(spark, f"{root}/table", ["user_id"], "ts")
    for name, part in (("a", "event_type = 'click'"), ("b", "event_type IS DISTINCT FROM 'click'")):
        upsert_stream(_event_stream(spark, sf_dir).filter(part), store, f"{root}/chk_{name}").awaitTermination()
    return store.read().select(*table(spark, sf_dir, "events").columns)


@register("stream_audit", """
SELECT 'events' AS stage, 'value >= 5.0' AS rule, 'LOG' AS action, count(*) AS checked, count(*) FILTER (WHERE NOT coalesce(value >= 5.0, FALSE)) AS violations FROM events
UNION ALL
SELECT 'events', 'user_id % 2 = 0', 'DROP', count(*), count(*) FILTER (WHERE NOT coalesce(user_id % 2 = 0, FALSE)) FROM events
""")
def q_stream_audit(spark, sf_dir):
    """Rule counts of all micro-batches of a stream, LOG too."""
    from sluice.sinks.audits import read_counts
    root = scratch_root(spark, "stream_audit")
    rules = [Rule("value >= 5.0", "LOG"), Rule("user_id % 2 = 0", "DROP")]
    append_stream(_event_stream(spark, sf_dir), f"{root}/out", f"{root}/chk", rules, audit_path=f"{root}/audit").awaitTermination()
    return (read_counts(spark, f"{root}/audit").groupBy(F.lit("events").alias("stage"), "rule", "action")
            .agg(F.sum("checked").alias("checked"), F.sum("violations").alias("violations")))


@register("audit_under_limit", """
SELECT stage, 'o_totalprice > 100000' AS rule, 'LOG' AS action, count(*) AS checked,
       count(*) FILTER (WHERE NOT coalesce(o_totalprice > 100000, FALSE)) AS violations
FROM orders, (VALUES ('o'), ('unread')) s(stage) GROUP BY stage
""")
def q_audit_under_limit(spark, sf_dir):
    """Counts cover the whole stage though the destination reads five rows of it, and come for an unread stage, too."""
    from sluice.sinks.audits import read_counts
    root = scratch_root(spark, "audit_under_limit")
    log = [{"validation_rule": "o_totalprice > 100000", "validation_action": "LOG"}]
    orders = {"origin": f"{sf_dir.rstrip('/')}/orders.parquet", "datatype": "parquet", "validations": log}
    spec = PipelineSpec(
        sources=[{**orders, "target": "o"}, {**orders, "target": "unread"}],
        transformations=[{"origin": "o", "target": "few", "sql_query": "SELECT * FROM o LIMIT 5"}],
        destinations=[{"origin": "few", "target": "few_out", "mode": "append", "path": f"{root}/few"}])
    run = PipelineRun(spark, spec)
    run.run()
    run.write_audit(f"{root}/audit")
    return read_counts(spark, f"{root}/audit").select("stage", "rule", "action", "checked", "violations")


@register("stale_table", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def q_stale_table(spark, sf_dir):
    """A catalog table has the name of a declared stage, and the stage that reads it is listed first."""
    name = "stale_" + scratch_root(spark, "stale_table").rsplit("/", 1)[1]
    overwrite_table(table(spark, sf_dir, "nation").select(F.lit("old").alias("o_orderpriority")), name,
                    path=scratch_root(spark, "stale_table"))
    spec = PipelineSpec(
        sources=[{"origin": f"{sf_dir.rstrip('/')}/orders.parquet", "datatype": "parquet", "target": "o"}],
        transformations=[
            {"origin": name, "target": "counted", "sql_query": f"SELECT o_orderpriority, count(*) AS n FROM {name} GROUP BY o_orderpriority"},
            {"origin": "o", "target": name, "sql_query": "SELECT o_orderpriority FROM o"}])
    return PipelineRun(spark, spec).run(write=False).relations["counted"]


@register("stream_upsert", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_id DESC, event_type DESC, value DESC, props DESC) AS rn FROM events) WHERE rn = 1
""")
def q_stream_upsert(spark, sf_dir):
    root = scratch_root(spark, "stream_upsert")
    store = UpsertStore(spark, f"{root}/table", ["user_id"], "ts")
    q = upsert_stream(_event_stream(spark, sf_dir), store, f"{root}/chk")
    q.awaitTermination()
    return store.read().select(*table(spark, sf_dir, "events").columns)


@register("job_plan", f"""WITH {_DUCK_DEPLOYED},
kept AS (
  SELECT declared.name AS name, coalesce(declared.pipeline_id, deployed.pipeline_id) AS pipeline_id
  FROM declared LEFT JOIN deployed ON declared.name = deployed.name),
jobs AS (
  SELECT 'cust-' || o_custkey AS job_name, arg_min(o_orderkey, o_orderkey) AS job_id
  FROM orders GROUP BY o_custkey)
SELECT kept.name, jobs.job_id, kept.pipeline_id,
       CASE WHEN jobs.job_id IS NULL THEN 'create' ELSE 'update' END AS action
FROM kept LEFT JOIN jobs ON kept.name = jobs.job_name""")
def q_job_plan(spark, sf_dir):
    """Jobs of kept pipelines: first job per name (orders play the job listing)."""
    from sluice.plans.deploy import job_actions
    kept = R.deploy_plan(_declared(spark, sf_dir), _deployed_raw(spark, sf_dir), order="pos", destructive=False)
    jobs = table(spark, sf_dir, "orders").select(F.concat(F.lit("cust-"), F.col("o_custkey")).alias("job_name"), F.col("o_orderkey").alias("job_id"))
    return job_actions(kept, jobs, "job_id")


@register("stream_declared", """
SELECT event_id, user_id, ts, amount FROM (
  SELECT event_id, user_id, ts, value AS amount,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, value DESC) AS rn
  FROM events WHERE value >= 2) WHERE rn = 1
""")
def q_stream_declared(spark, sf_dir):
    """A declared pipeline run on a stream: column map + DROP rule -> upsert destination."""
    from sluice.plans.runner import run_stream
    root = scratch_root(spark, "stream_declared")
    spec = PipelineSpec(
        sources=[{"origin": sf_dir.rstrip("/"), "datatype": "parquet", "target": "ev",
                  "params": '{"pathGlobFilter": "events.parquet"}'}],
        transformations=[
            {"origin": "ev", "target": "mapped", "column_order": i + 1, "source_column_name": c,
             "dest_column_name": d}
            for i, (c, d) in enumerate([("event_id", "event_id"), ("user_id", "user_id"), ("ts", "ts"),
                                        ("value", "amount")])
        ],
        destinations=[{"origin": "mapped", "target": "latest", "mode": "upsert", "path": f"{root}/latest",
                       "keys": ["user_id"], "sequence_by": "ts",
                       "validations": [{"validation_rule": "amount >= 2", "validation_action": "DROP"}]}],
    )
    run_stream(spark, spec, f"{root}/chk").awaitTermination()
    return UpsertStore(spark, f"{root}/latest", ["user_id"], "ts").read().select("event_id", "user_id", "ts", "amount")


# ------------------------------------------------------------------ relation scope, running aggregates, several streams, refresh


@register("sql_cte_order", """
WITH mid AS (SELECT * FROM orders WHERE o_totalprice > 100000)
SELECT o_orderpriority, count(*) AS n, max(k) AS k FROM mid, (SELECT count(*) AS k FROM orders) GROUP BY 1
""")
def q_sql_cte_order(spark, sf_dir):
    """``WITH`` names equal to names of stages: the first stage's hides a later target, the second's shadows the relation it is made of."""
    spec = PipelineSpec(
        sources=[{"origin": f"{sf_dir.rstrip('/')}/orders.parquet", "datatype": "parquet", "target": "a"}],
        transformations=[
            {"origin": "a", "target": "counted", "sql_query": "WITH mid AS (WITH b AS (SELECT * FROM a) SELECT count(*) AS k FROM b) SELECT * FROM mid"},
            {"origin": "mid", "target": "out", "sql_query":
                "WITH mid AS (SELECT * FROM mid) SELECT o_orderpriority, count(*) AS n, (SELECT max(k) FROM counted) AS k FROM mid GROUP BY 1"},
            {"origin": "a", "target": "mid", "sql_query": "SELECT * FROM a WHERE o_totalprice > 100000"}])
    return PipelineRun(spark, spec).run(write=False).relations["out"]


def _in_files(df, path: str, files: int) -> str:
    """A table as several files, for streams of several micro-batches."""
    df.repartition(files, *df.columns[:1]).write.parquet(path)
    return path


@register("stream_running_avg", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(ts) AS last FROM events WHERE value >= 2 GROUP BY event_type
""")
def q_stream_running_avg(spark, sf_dir):
    """An aggregate over many micro-batches and a restart with more files equals the batch: Spark keeps the state, the store the last row per group."""
    from sluice.plans.stream_runner import run_stream
    root = scratch_root(spark, "stream_running_avg")
    events = table(spark, sf_dir, "events")
    spec = PipelineSpec(
        sources=[{"origin": f"{root}/in", "datatype": "parquet", "target": "ev", "params": {"maxFilesPerTrigger": 2, "recursiveFileLookup": "true"},
                  "validations": [{"validation_rule": "value >= 2", "validation_action": "DROP"}]}],
        transformations=[{"origin": "ev", "target": "stats", "sql_query":
                          "SELECT event_type, count(*) AS n, avg(value) AS mean, max(ts) AS last FROM ev GROUP BY event_type"}],
        destinations=[{"origin": "stats", "target": "stats_out", "mode": "upsert", "path": f"{root}/out", "keys": ["event_type"], "sequence_by": "last"}])
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        _in_files(events.filter(part), f"{root}/in/{part[-1]}", 5)
        run_stream(spark, spec, f"{root}/chk").awaitTermination()
    return UpsertStore(spark, f"{root}/out", ["event_type"], "last").read().withColumn("mean", F.round("mean", 6))


@register("stream_two_sources", """
SELECT o_orderkey, o_totalprice, count(l_linenumber) AS n_lines, sum(l_quantity) AS quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 25 GROUP BY 1, 2
""")
def q_stream_two_sources(spark, sf_dir):
    """Two streamed sources joined by one SQL stage, in several micro-batches and with a restart between; the matches of all batches are counted up."""
    from sluice.plans.stream_runner import run_stream
    root = scratch_root(spark, "stream_two_sources")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    files = {"maxFilesPerTrigger": 3, "recursiveFileLookup": "true"}
    spec = PipelineSpec(
        sources=[{"origin": f"{root}/o", "datatype": "parquet", "target": "o", "params": files},
                 {"origin": f"{root}/l", "datatype": "parquet", "target": "l", "params": files}],
        transformations=[{"origin": "o", "target": "matched", "sql_query":
                          "SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity FROM o JOIN l ON o_orderkey = l_orderkey WHERE l_quantity > 25"}],
        destinations=[{"origin": "matched", "target": "m", "mode": "append", "path": f"{root}/out"}])
    for k in range(2):  # lines of the first half meet orders of the second half only in the state
        _in_files(orders.filter(f"o_orderkey % 2 = {k}"), f"{root}/o/{k}", 4)
        _in_files(lines.filter(f"l_linenumber % 2 = {k}"), f"{root}/l/{k}", 4)
        run_stream(spark, spec, f"{root}/chk", stream_target="*").awaitTermination()
    return (batches.read_batches(spark, f"{root}/out").groupBy("o_orderkey", "o_totalprice")
            .agg(F.count("l_linenumber").alias("n_lines"), F.sum("l_quantity").alias("quantity")))


@register("stream_table_append", "SELECT * FROM events UNION ALL SELECT * FROM events WHERE value >= 5.0")
def q_stream_table_append(spark, sf_dir):
    """A stream and a batch run append to one catalog table; a replayed micro-batch adds nothing."""
    from sluice.plans.stream_runner import run_stream
    from sluice.sinks.tables import append_batch, destination_table, write_destination
    root = scratch_root(spark, "stream_table_append")
    dest = {"origin": "ev", "target": "t_" + root.rsplit("/", 1)[1], "mode": "append", "target_schema_name": "sluice_streams"}
    spec = PipelineSpec(
        sources=[{"origin": _in_files(table(spark, sf_dir, "events"), f"{root}/in", 4), "datatype": "parquet", "target": "ev",
                  "params": {"maxFilesPerTrigger": 2}}], destinations=[dest])
    run_stream(spark, spec, f"{root}/chk").awaitTermination()
    write_destination(table(spark, sf_dir, "events").filter("value >= 5.0"), dest)
    name = destination_table(spark, dest)
    from sluice.sinks.tables import destination_tag
    writer = f"{batches.stream_writer(spark, f'{root}/chk')}-{destination_tag(dest)}"
    first = spark.read.schema(table(spark, sf_dir, "events").schema).parquet(f"{root}/in")
    seen = spark.read.json(f"{root}/chk/sources/0/0").filter("path IS NOT NULL").select(F.element_at(F.split("path", "/"), -1).alias("file"))
    append_batch(first.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).join(seen, "file", "left_semi").drop("file"), name, writer, 0)
    return spark.table(name)


@register("upsert_replay_order", """
SELECT o_custkey, 'b' AS batch, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey
""")
def q_upsert_replay_order(spark, sf_dir):
    """Batch 0 of writer a, then of writer b, then a's again: on equal sequences b's rows stay."""
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    store = UpsertStore(spark, scratch_root(spark, "upsert_replay_order"), ["o_custkey"], "o_orderdate")
    for writer in ("a", "b", "a"):
        store.merge(latest.withColumn("batch", F.lit(writer)), f"stream-{writer}", 0)
    return store.read().select("o_custkey", "batch", "o_orderdate")


@register("stream_full_refresh", """
SELECT 'before' AS seen, event_id, value FROM events UNION ALL SELECT 'after', event_id, value FROM events WHERE value >= 5.0
""")
def q_stream_full_refresh(spark, sf_dir):
    """A refresh that fails half-way leaves the old rows readable, the next one replaces them."""
    from sluice.plans.stream_runner import run_stream
    root = scratch_root(spark, "stream_full_refresh")
    source = {"origin": _in_files(table(spark, sf_dir, "events").select("event_id", "value"), f"{root}/in", 4), "datatype": "parquet", "target": "ev",
              "params": {"maxFilesPerTrigger": 1}}
    dest = {"origin": "ev", "target": "out", "mode": "append", "path": f"{root}/out"}

    def run(rules, **options):
        spec = PipelineSpec(sources=[{**source, "validations": [{"validation_rule": r, "validation_action": a} for r, a in rules]}], destinations=[dest])
        run_stream(spark, spec, f"{root}/chk", **options).awaitTermination()

    run([])
    ids = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    try:
        run([("value >= 5.0", "DROP"), (f"event_id < {ids}", "FAIL")], full_refresh=True)
    except Exception as exc:  # noqa: BLE001 - the failure that is meant
        if "validation failed" not in str(exc):
            raise
    before = batches.read_batches(spark, f"{root}/out").withColumn("seen", F.lit("before"))
    before.write.parquet(f"{root}/before")
    run([("value >= 5.0", "DROP")], full_refresh=True)
    return spark.read.parquet(f"{root}/before").unionByName(batches.read_batches(spark, f"{root}/out").withColumn("seen", F.lit("after")))


# ------------------------------------------------------------------ ingestion on the shipped path


def _pipelines(spark, sf_dir):
    """One pipeline per supplier: its folders ``c=<region>/s=<nation>/p=<flow>`` and its key."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.concat(F.lit("r_"), "n_regionkey").alias("c"), F.concat(F.lit("n_"), "n_nationkey").alias("s"),
                    F.concat(F.lit("flow_"), "s_suppkey").alias("p"), F.col("s_suppkey").alias("k"), "n_regionkey")


def _folder():
    """A pipeline's folder below the root."""
    return F.concat_ws("/", F.lit("pipelines"), F.concat(F.lit("c="), "c"), F.concat(F.lit("s="), "s"), F.concat(F.lit("p="), "p"))


def _documents(df, **stages):
    """One definition document per row, as a line of text with its pipeline's folder."""
    doc = [F.expr(v).alias(n) if isinstance(v, str) else v.alias(n) for n, v in stages.items()]
    return df.select(_folder().alias("folder"), F.to_json(F.struct(*doc)).alias("line"))


def _definitions(documents, root: str):
    """Write one definition file per pipeline (documents of one pipeline go to one file, a line each)."""
    files = documents.groupBy("folder").agg(F.array_join(F.collect_list("line"), "\n").alias("lines"))
    _named_files(files.select(F.concat("folder", F.lit("/definition.json")).alias("path"), F.concat("lines", F.lit("\n")).alias("content")), root)


@register("ingest_stage_rows", """
WITH f AS (SELECT 'c=r_' || n_regionkey AS catalog, 's=n_' || n_nationkey AS "schema", 'p=flow_' || s_suppkey AS pipeline, s_suppkey AS k, n_regionkey AS r
           FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'sources' AS stage, catalog, "schema", pipeline, '/data/' || k AS origin, 'raw_' || k AS target, NULL::INTEGER AS column_order, NULL AS detail,
       'k > 0:LOG' AS rules FROM f
UNION ALL SELECT 'transformations', catalog, "schema", pipeline, 'raw_' || k, 'mapped_' || k, n_nationkey, n_name || '>' || lower(n_name) || ':string',
       CASE WHEN n_name < 'F' THEN 'length(' || n_name || ') > 3:DROP' END FROM f JOIN nation ON n_regionkey = r
UNION ALL SELECT 'transformations', catalog, "schema", pipeline, 'mapped_' || k, 'agg_' || k, 1, 'SELECT count(*) AS n FROM mapped', NULL FROM f
UNION ALL SELECT 'transformations', catalog, "schema", pipeline, 'agg_' || k, 'more_' || k, 1, 'SELECT n + ' || k || ' AS n FROM agg_' || k, NULL FROM f
UNION ALL SELECT 'destinations', catalog, "schema", pipeline, 'more_' || k, 'out_' || k, NULL,
       CASE WHEN k % 2 = 0 THEN 'append|/pipelines/' || catalog || '/' || "schema" || '/' || pipeline || '/out|' ELSE 'upsert||n' END, NULL FROM f
""")
def q_ingest_stage_rows(spark, sf_dir):
    """Definition files written from the tables, with column maps by CSV, SQL files and inline SQL, read back as stage rows."""
    from sluice.functions.text import normalize_path
    from sluice.plans.ingest import load_configs
    root = scratch_root(spark, "ingest_stage_rows")
    n = table(spark, sf_dir, "nation")
    drop = F.col("n_name") < "F"
    (n.select("n_regionkey", F.col("n_nationkey").alias("column_order"), F.col("n_name").alias("source_column_name"), F.lit("string").alias("source_column_type"),
              F.lower("n_name").alias("dest_column_name"), F.lit("string").alias("dest_column_type"), F.lit("").alias("transform_function"),
              F.when(drop, F.concat(F.lit("length("), F.col("n_name"), F.lit(") > 3"))).alias("validation_rule"), F.when(drop, "DROP").alias("validation_action"))
     .repartition("n_regionkey").write.partitionBy("n_regionkey").option("header", "true").csv(f"{root}/maps"))
    maps = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(f"{root}/maps")
            .select(normalize_path(F.col("path")).alias("map")).withColumn("n_regionkey", F.regexp_extract("map", r"n_regionkey=(\d+)", 1).cast("int")))
    batches.write_text(spark, f"{root}/agg.sql", "SELECT count(*) AS n FROM mapped")
    rule = "array(named_struct('validation_rule', 'k > 0', 'validation_action', 'LOG'))"
    _definitions(_documents(
                 _pipelines(spark, sf_dir).join(maps, "n_regionkey"),
                 sources=f"array(named_struct('origin', concat('/data/', k), 'datatype', 'parquet', 'target', concat('raw_', k), 'validations', {rule}))",
                 transformations=f"""array(named_struct('origin', concat('raw_', k), 'target', concat('mapped_', k), 'config', map, 'sql_query', null),
                     named_struct('origin', concat('mapped_', k), 'target', concat('agg_', k), 'config', '{root}/agg.sql', 'sql_query', null),
                     named_struct('origin', concat('agg_', k), 'target', concat('more_', k), 'config', null, 'sql_query', concat('SELECT n + ', k, ' AS n FROM agg_', k)))""",
                 destinations="""array(named_struct('origin', concat('more_', k), 'target', concat('out_', k), 'mode', if(k % 2 = 0, 'append', 'upsert'),
                     'path', if(k % 2 = 0, 'out', null), 'keys', if(k % 2 = 0, null, array('n')), 'sequence_by', if(k % 2 = 0, null, 'n')))"""), root)
    got = load_configs(spark, root)
    plain = normalize_path(F.lit(root))
    mapped = F.concat("source_column_name", F.lit(">"), F.col("dest_column_name"), F.lit(":"), F.col("dest_column_type"))
    written = F.concat("mode", F.lit("|"), F.coalesce(F.replace(F.col("path"), plain, F.lit("")), F.lit("")), F.lit("|"), F.array_join(F.coalesce("keys", F.array()), ","))

    def rows(stage, df, order, detail, rules):
        return df.select(F.lit(stage).alias("stage"), F.col("target_catalog_name").alias("catalog"), F.col("target_schema_name").alias("schema"),
                         F.col("pipeline_name").alias("pipeline"), "origin", "target", order.cast("int").alias("column_order"),
                         detail.cast("string").alias("detail"), F.when(F.size(rules) > 0, _rule_text(rules)).alias("rules"))

    def _rule_text(v):
        return F.array_join(F.transform(v, lambda x: F.concat(x.validation_rule, F.lit(":"), x.validation_action)), ";")

    none = F.lit(None)
    return (rows("sources", got.sources, none, none, F.col("validations"))
            .unionByName(rows("transformations", got.transformations, F.col("column_order"), F.coalesce("sql_query", mapped), F.col("validations")))
            .unionByName(rows("destinations", got.destinations, none, written, F.col("validations"))))


@register("ingest_problems", """
SELECT ['', 'parse_error', 'invalid_shape', 'no_stage', 'bad_config_file', 'missing_config_file', 'invalid_source', 'invalid_destination', 'duplicate_target',
        'conflicting_rules', 'invalid_transformation'][s_suppkey % 11 + 1] AS kind, 'p=flow_' || s_suppkey AS pipeline, 1 AS n
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 11 <> 0
""")
def q_ingest_problems(spark, sf_dir):
    """Files with one problem each (a tenth of the pipelines per kind), and as many without any."""
    from sluice.plans.ingest import load_configs
    root = scratch_root(spark, "ingest_problems")
    flows = _pipelines(spark, sf_dir)

    def source(target="'raw'", datatype="'parquet'"):
        return f"named_struct('origin', '/data', 'datatype', {datatype}, 'target', {target})"

    def stage(**fields):
        names = ("origin", "target", "config", "sql_query", "source_column_name", "validations")
        return "named_struct(" + ", ".join(f"'{n}', {fields.get(n, 'null')}" for n in names) + ")"

    def rule(action):
        return f"array(named_struct('validation_rule', 'x > 0', 'validation_action', '{action}'))"

    clash = ", ".join(stage(origin="'a'", target="'t'", source_column_name=f"'{c}'", validations=rule(a)) for c, a in (("x", "LOG"), ("y", "DROP")))
    cases = [
        {"sources": f"array({source()})"}, {"sources": f"array({source()})"}, {"sources": source()}, {"other": "1"},
        {"transformations": f"array({stage(origin=chr(39) + 'a' + chr(39), target=chr(39) + 't' + chr(39), config=chr(39) + 'map.txt' + chr(39))})"},
        {"transformations": f"array({stage(origin=chr(39) + 'a' + chr(39), target=chr(39) + 't' + chr(39), config=chr(39) + 'gone.csv' + chr(39))})"},
        {"sources": f"array({source(datatype=chr(39) * 2)})"},
        {"destinations": "array(named_struct('origin', 'a', 'target', 't', 'mode', 'sideways'))"},
        {"sources": f"array({source()}, {source()})"},
        {"transformations": f"array({clash})"},
        {"transformations": f"array({stage(origin=chr(39) + 'a' + chr(39), target=chr(39) + 't' + chr(39))})"}]
    documents = []
    for i, stages in enumerate(cases):
        own = flows.filter(F.col("k") % len(cases) == i)
        documents.append(_documents(own.unionByName(own) if i == 1 else own, **stages))  # two documents in one file are not one
    _definitions(reduce(DataFrame.unionByName, documents), root)
    found = load_configs(spark, root).problems
    return found.groupBy("kind", F.regexp_extract("path", "(p=flow_[0-9]+)", 1).alias("pipeline")).agg(F.count(F.lit(1)).cast("int").alias("n"))


def _named_files(df, root: str):
    """Write one file per row (``path`` below ``root``, ``content``), dealt over the tasks; a repeated task writes the same bytes again."""
    from sluice.sources.files import tasks_for
    files = df.select("path", "content")

    def put(batches):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(content.encode())
            yield batch
    files.repartition(tasks_for(df.sparkSession, files.count())).mapInArrow(put, "path string, content string").write.format("noop").mode("overwrite").save()


@register("ambiguous_definitions", """
WITH f AS (SELECT s_suppkey AS k, 'p=flow_' || s_suppkey AS pipeline FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT pipeline, 'stage' AS stem, 'source' AS found, 3 AS n FROM f WHERE k % 4 = 0
UNION ALL SELECT pipeline, 'stage', 'ambiguous_file', 1 FROM f WHERE k % 4 = 0
UNION ALL SELECT pipeline, 'stage', 'source', 1 FROM f WHERE k % 4 <> 0
UNION ALL SELECT pipeline, 'more', 'source', 1 FROM f WHERE k % 4 = 1
""")
def q_ambiguous_definitions(spark, sf_dir):
    """Pipelines with one definition three times (JSON, YAML and TOML), with two of different stems, and with one."""
    from sluice.plans.ingest import load_configs
    root = scratch_root(spark, "ambiguous_definitions")
    flows = _pipelines(spark, sf_dir)
    as_json = F.format_string('{"sources": [{"origin": "/data", "datatype": "parquet", "target": "%s_%d"}]}', F.col("name"), F.col("i"))
    as_toml = F.format_string('[[sources]]\norigin = "/data"\ndatatype = "parquet"\ntarget = "%s_%d"\n', F.col("name"), F.col("i"))
    kinds = [(0, "stage.json"), (0, "stage.yaml"), (0, "stage.toml"), (1, "stage.json"), (1, "more.yaml"), (2, "stage.toml"), (3, "stage.yml")]
    named = spark.createDataFrame([(k, f, f.split(".")[0], i) for i, (k, f) in enumerate(kinds)], "part int, file string, name string, i int")
    files = flows.join(named, F.col("k") % 4 == F.col("part"))
    _named_files(files.select(F.concat_ws("/", _folder(), "file").alias("path"), F.when(F.col("file").endswith(".toml"), as_toml).otherwise(as_json).alias("content")), root)
    got = load_configs(spark, root)
    pipeline = F.regexp_extract("path", "(p=flow_[0-9]+)", 1).alias("pipeline")
    bad = got.problems.select(pipeline, F.regexp_extract("path", "([a-z]+)(\\.[a-z]+)?$", 1).alias("stem"), F.col("kind").alias("found"))
    read = got.sources.select(F.col("pipeline_name").alias("pipeline"), F.regexp_extract("target", "^([a-z]+)", 1).alias("stem"), F.lit("source").alias("found"))
    return bad.unionByName(read).groupBy("pipeline", "stem", "found").agg(F.count(F.lit(1)).cast("int").alias("n"))


@register("settings_files", """
WITH f AS (SELECT s_suppkey AS k, 'p=flow_' || s_suppkey AS pipeline FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT pipeline, 'settings' AS found, k % 5 = 0 AS continuous FROM f WHERE k % 5 <> 4
UNION ALL SELECT pipeline, 'settings', false FROM f WHERE k % 5 = 3
UNION ALL SELECT pipeline, ['invalid_settings', 'ambiguous_file', 'parse_error'][k % 5 - 1], NULL FROM f WHERE k % 5 >= 2
""")
def q_settings_files(spark, sf_dir):
    """Settings files beside definitions: two run modes, an unknown one, two files for one pipeline, a file that does not parse."""
    from sluice.sources.settings import load_settings
    root = scratch_root(spark, "settings_files")
    texts = [(0, "json", '{"continuous": "Yes", "clusters": []}'), (1, "yaml", "continuous: false\n"), (2, "json", '{"continuous": "perhaps"}'),
             (3, "json", "{}"), (3, "toml", 'name = "x"\n'), (4, "json", '{"continuous": ')]
    files = _pipelines(spark, sf_dir).join(spark.createDataFrame(texts, "part int, suffix string, content string"), F.col("k") % 5 == F.col("part"))
    _named_files(files.select(F.concat(_folder(), F.lit("/_pipeline_settings."), "suffix").alias("path"), "content"), root)
    settings, problems = load_settings(spark, root)
    pipeline = F.regexp_extract("path", "(p=flow_[0-9]+)", 1).alias("pipeline")
    return (settings.select(pipeline, F.lit("settings").alias("found"), "continuous")
            .unionByName(problems.select(pipeline, F.col("kind").alias("found"), F.lit(None).cast("boolean").alias("continuous"))))


@register("deployed_jobs", """
SELECT 'job-' || c_custkey AS job_name, c_custkey AS job_id, min(o_orderkey)::VARCHAR AS pipeline_id
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def q_deployed_jobs(spark, sf_dir):
    """Job listing records with nested tasks: the first task's pipeline, jobs without tasks dropped."""
    tasks = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.struct(
        F.col("o_orderkey").alias("pipeline_id")).alias("pipeline_task")))).alias("tasks"))
    jobs = table(spark, sf_dir, "customer").join(tasks, F.col("c_custkey") == F.col("o_custkey"), "left")
    listing = jobs.select(F.col("c_custkey").alias("job_id"), F.struct(F.concat(F.lit("job-"), "c_custkey").alias("name"),
                                                                       F.coalesce("tasks", F.array().cast(jobs.schema["tasks"].dataType)).alias("tasks")).alias("settings"))
    return R.deployed_jobs(listing)


@register("higher_order_map", """
SELECT conv_id, turn, list_transform(list_filter(string_split(text, ' '), lambda x: length(x) > 4), lambda x: x || '!') AS long_words FROM conversations
""")
def q_higher_order_map(spark, sf_dir):
    """A column map whose transform is a lambda in the functions' spelling."""
    return apply_column_map(table(spark, sf_dir, "conversations"), [
        ColumnSpec("conv_id", column_order=1), ColumnSpec("turn", column_order=2),
        ColumnSpec(dest_column_name="long_words", column_order=3, transform_function=(
            "F.transform(F.filter(F.split(F.col('text'), ' '), lambda x: F.length(x) > 4), lambda x: F.concat(x, F.lit('!')))"))])
