"""Rule documents of the parts: each part's values make a document, some of which break the rule language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import documents, gates, rules
from tickloom.plans import tables as t
from tickloom.plans.registry import query

SYMBOLS = ("SPY", "QQQ", "IWM")
#: The document, as Spark and DuckDB read alike.
_TEXT = """'{"strategy_id":"' || CASE WHEN p_size = 2 THEN '' ELSE 'v' || CAST(p_partkey AS STRING) END || '","dsl_version":"' || CASE WHEN p_size = 3 THEN '2.0.0' ELSE '1.0.0' END || '","symbols":[' || CASE WHEN p_size = 4 THEN '' WHEN p_size = 5 THEN '"SPY",7' ELSE '"SPY","' || CASE WHEN p_size > 46 THEN p_brand ELSE 'QQQ' END || '"' END || '],'
    || '"signal_bar_size":"15min","entry":{"all":[{"indicator":"rsi","op":"gt","value":' || CAST(p_size AS STRING) || '},{"any":[{"indicator":"' || CASE WHEN p_size = 6 THEN p_brand ELSE 'ema_spread' END || '","op":"' || CASE WHEN p_size = 7 THEN 'eq' ELSE 'lt' END || '","value":0.5},'
    || CASE WHEN p_size > 47 THEN '{"any":[{"indicator":"rsi","op":"lt","value":"9"}]}' ELSE '{"indicator":"rsi","op":"lt","value":9}' END || ']}]},"exit":{"indicator":"minutes_from_open","op":"gte","value":' || CAST(p_retailprice AS STRING) || CASE WHEN p_size = 8 THEN ',"targetPosition":3' ELSE '' END || '},'
    || '"risk":{"stop_loss_bps":' || CAST(p_size * 250 AS STRING) || ',"take_profit_bps":' || CASE WHEN p_size = 9 THEN '0' ELSE '80' END || ',"max_holding_minutes":60,' || CASE WHEN p_size = 10 THEN '' ELSE '"cooldown_minutes":15,' END || '"max_entries_per_session":' || CAST(p_size % 5 AS STRING) || ',"sizing_preset":"' || CASE WHEN p_size = 1 THEN 'all_in' ELSE 'equal_risk_conservative' END || '"}'
    || CASE WHEN p_size = 11 THEN ',"pythonCode":"x"' WHEN p_size = 12 THEN ',"meta":{"deep":[{"callBack":1,"sourceUrl":2}]}' WHEN p_size = 13 THEN ',"limitPrice":3' WHEN p_size = 14 THEN ',"note":"a \\u0022url\\u0022: in a text"' WHEN p_size = 15 THEN ',"\\u0075rl":1' ELSE '' END || ',"order_type":"' || CASE WHEN p_size = 16 THEN 'stop' ELSE 'market' END || '"' || CASE WHEN p_size = 17 THEN '' ELSE '}' END"""
_NODES = f"""SELECT p_partkey, CASE WHEN fullkey = '$' THEN '' ELSE substr(fullkey, 3) END AS path, CASE WHEN fullkey = '$' OR fullkey LIKE '%]' THEN NULL ELSE key END AS name, type, CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE atom ->> '$' END AS value,
        CASE WHEN fullkey = '$' THEN 0 ELSE len(regexp_extract_all(fullkey, '[.\\[]')) END AS depth, CASE type WHEN 'ARRAY' THEN json_array_length(value) END AS size
    FROM (SELECT p_partkey, {_TEXT} AS doc FROM part WHERE p_size <> 17), json_tree(doc)"""
_BAD = f"SELECT p_partkey FROM part WHERE NOT json_valid({_TEXT})"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.spread(t.read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), "p_partkey")
    docs = parts.select("p_partkey", F.expr(_TEXT.replace("\\u", "\\\\u")).alias("doc"))
    return documents.walked(docs, "p_partkey", "doc")


@query(f"""WITH n AS ({_NODES}), c AS (SELECT *, regexp_replace(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g') AS c FROM n WHERE name IS NOT NULL)
    SELECT p_partkey, 'DSL_INVALID_JSON' AS code, '' AS path FROM ({_BAD})
    UNION ALL SELECT p_partkey, CASE WHEN list_contains(w, 'limit') AND list_contains(w, 'price') THEN 'DSL_UNSUPPORTED_LIMIT_OFFSET' WHEN path LIKE 'exit.%' AND c IN ({", ".join(f"'{x}'" for x in documents.EXPOSURE)}) THEN 'DSL_EXIT_CAN_INCREASE_EXPOSURE' ELSE 'DSL_FORBIDDEN_FIELD' END, path
    FROM (SELECT *, string_split(CASE c WHEN 'call_back' THEN 'callback' ELSE c END, '_') AS w FROM c) WHERE (list_contains(w, 'limit') AND list_contains(w, 'price')) OR (path LIKE 'exit.%' AND c IN ({", ".join(f"'{x}'" for x in documents.EXPOSURE)}))
        OR len(list_intersect(string_split(c, '_'), [{", ".join(f"'{x}'" for x in documents.FORBIDDEN)}])) > 0""")
def g8_forbidden_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the parts' documents that no rule may have, wherever they stand and however they are spelt."""
    return documents.forbidden_fields(nodes(spark, sf_dir), "p_partkey")


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(f"""WITH n AS MATERIALIZED ({_NODES}), i AS (SELECT *, CASE WHEN type IN ('UBIGINT', 'BIGINT') THEN CAST(value AS BIGINT) END AS v, path LIKE 'entry%' OR path LIKE 'exit%' AS tree FROM n)
    SELECT p_partkey, 'DSL_MISSING_FIELD' AS code, f AS path FROM (SELECT p_partkey, list(path) AS own FROM n GROUP BY 1), (SELECT unnest([{_listed(documents.FIELDS)}, {_listed(tuple(f"risk.{x}" for x in documents.RISK_FIELDS))}]) AS f) WHERE NOT list_contains(own, f)
    UNION ALL SELECT p_partkey, 'DSL_UNEXPECTED_FIELD', path FROM n WHERE depth = 1 AND name NOT IN ({_listed(documents.FIELDS)}) OR depth = 2 AND path LIKE 'risk.%' AND name NOT IN ({_listed(documents.RISK_FIELDS)})
    UNION ALL SELECT p_partkey, 'DSL_INVALID_STRATEGY_ID', path FROM n WHERE path = 'strategy_id' AND value = ''
    UNION ALL SELECT p_partkey, 'DSL_UNSUPPORTED_DSL_VERSION', path FROM n WHERE path = 'dsl_version' AND value <> '1.0.0'
    UNION ALL SELECT p_partkey, 'DSL_UNSUPPORTED_ORDER_TYPE', path FROM n WHERE path = 'order_type' AND value NOT IN ('market', 'limit')
    UNION ALL SELECT p_partkey, 'DSL_INVALID_SIZING_PRESET', path FROM n WHERE path = 'risk.sizing_preset' AND value NOT LIKE 'equal_%'
    UNION ALL SELECT p_partkey, 'DSL_EMPTY_SYMBOLS', path FROM n WHERE path = 'symbols' AND size = 0
    UNION ALL SELECT p_partkey, CASE WHEN type <> 'VARCHAR' THEN 'DSL_INVALID_SYMBOL_TYPE' ELSE 'DSL_UNSUPPORTED_SYMBOL' END, path FROM n WHERE path LIKE 'symbols[%' AND (type <> 'VARCHAR' OR value NOT IN ({_listed(SYMBOLS)}))
    UNION ALL SELECT p_partkey, CASE WHEN name = 'max_entries_per_session' THEN CASE WHEN v <= 0 THEN 'DSL_NON_POSITIVE_MAX_ENTRIES' ELSE 'DSL_MAX_ENTRIES_EXCEEDED' END WHEN v <= 0 THEN 'DSL_NON_POSITIVE_RISK_CONTROL' ELSE 'DSL_RISK_CONTROL_EXCEEDED' END, path FROM i
        WHERE path LIKE 'risk.%' AND name <> 'sizing_preset' AND (v <= 0 OR v > CASE WHEN name LIKE '%bps' THEN 10000 WHEN name LIKE '%minutes' THEN 1440 ELSE 3 END)
    UNION ALL SELECT p_partkey, 'DSL_UNKNOWN_INDICATOR', path FROM i WHERE tree AND name = 'indicator' AND value NOT IN ({_listed(rules.INDICATORS)})
    UNION ALL SELECT p_partkey, 'DSL_UNKNOWN_COMPARISON', path FROM i WHERE tree AND name = 'op' AND value NOT IN ({_listed(tuple(rules.COMPARISONS))})
    UNION ALL SELECT p_partkey, 'DSL_INVALID_VALUE', path FROM i WHERE tree AND name = 'value' AND type = 'VARCHAR'
    UNION ALL SELECT p_partkey, 'DSL_CONDITION_DEPTH_EXCEEDED', path FROM i WHERE tree AND type = 'OBJECT' AND len(string_split(path, '[')) > {rules.MAX_DEPTH}""")
def g7_rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.rule_issues(nodes(spark, sf_dir), "p_partkey", SYMBOLS)


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hypothesis for each supplier: nine parameters of ten values each, a thousand million cells."""
    rows = t.spread(t.read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey").select("s_suppkey", F.floor(F.abs("s_acctbal")).cast("double").alias("b"))
    step = lambda i: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.col("b") + k * (i + 1))
    ranges = F.create_map(*[x for i in range(9) for x in (F.lit(f"p{i}"), step(i))])
    middle = F.create_map(*[x for i in range(9) for x in (F.lit(f"p{i}"), F.col("b") + 5.0 * (i + 1))])
    return rows.select("s_suppkey", ranges.alias("ranges"), middle.alias("baseline"), F.lit(12).alias("budget"), F.col("s_suppkey").alias("seed"))


@query()
def l9_variants_of_large_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve variants of every supplier's hypothesis; the tests hold them against brute force."""
    return gates.spread_variants(hypotheses(spark, sf_dir), "s_suppkey")
