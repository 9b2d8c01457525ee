"""Rules as data: comparisons under all/any, evaluated as columns for many rules in one pass (SURVEY G)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Indicators that a rule may name, its comparisons, and the limits of a rule.
INDICATORS = ("return_1", "return_3", "ema_spread", "rsi", "atr_bps", "volume_ratio", "vwap_distance_bps", "range_position", "minutes_from_open")
COMPARISONS = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
MAX_DEPTH, MAX_LEAVES, MAX_BRANCHES = 3, 12, 16

Rule = dict


def condition(rule: Rule) -> Column:
    """A rule's column: {"indicator", "op", "value"}, {"all": [...]} or {"any": [...]}. Null, NaN and infinite indicators compare false."""
    if "all" in rule or "any" in rule:
        kind = "all" if "all" in rule else "any"
        parts = [condition(r) for r in rule[kind]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if kind == "all" else out | p
        return out
    x = F.col(rule["indicator"])
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(finite & getattr(x, COMPARISONS[rule["op"]])(F.lit(float(rule["value"]))), F.lit(False))


def branches(rule: Rule) -> list[list[Rule]]:
    """The rule as alternatives of comparisons that must all hold."""
    if "any" in rule:
        return [b for r in rule["any"] for b in branches(r)]
    if "all" in rule:
        return [sum(combo, []) for combo in product(*(branches(r) for r in rule["all"]))]
    return [[rule]]


def signals(frame: DataFrame, rules: dict[str, Rule], keep: tuple[str, ...]) -> DataFrame:
    """(strategy_id, *keep) for each rule and row that satisfies it: all rules are one array of booleans over a single scan."""
    fired = F.array(*[F.when(condition(r), F.lit(s)) for s, r in sorted(rules.items())])
    return frame.select(*keep, F.explode(F.array_compact(fired)).alias("strategy_id"))


def marks(frame: DataFrame, rules: dict[str, Rule], keep: tuple[str, ...]) -> DataFrame:
    """(strategy_id, entered, *keep) for every rule and row, in one scan: an opportunity, and whether the rule takes it."""
    every = F.array(*[F.struct(F.lit(s).alias("strategy_id"), condition(r).alias("entered")) for s, r in sorted(rules.items())])
    return frame.select(*keep, F.explode(every).alias("_m")).select("_m.*", *keep)


def nudged(rule: Rule, factor: float) -> Rule:
    """The rule with every value times factor: a neighbour in its parameters."""
    if "all" in rule or "any" in rule:
        return {k: [nudged(r, factor) for r in parts] for k, parts in rule.items()}
    return rule | {"value": round(rule["value"] * factor, 9)}


def rule_table(spark: SparkSession, rules: dict[str, Rule]) -> DataFrame:
    """Rules as rows: strategy_id, branch, indicator, op, value."""
    rows = [(s, i, c["indicator"], c["op"], float(c["value"])) for s, r in sorted(rules.items()) for i, b in enumerate(branches(r)) for c in b]
    return spark.createDataFrame(rows, "strategy_id string, branch int, indicator string, op string, value double")


def contradictions(table: DataFrame) -> DataFrame:
    """Branches in which some indicator's lower bound meets or passes its upper bound."""
    lower, upper = F.col("op").isin("gt", "gte"), F.col("op").isin("lt", "lte")
    bounds = table.groupBy("strategy_id", "branch", "indicator").agg(
        F.max(F.when(lower, F.struct("value", (F.col("op") == "gt").alias("strict")))).alias("low"),
        F.min(F.when(upper, F.struct("value", (F.col("op") == "lte").alias("open")))).alias("high"),
    )
    strict = F.col("low.strict") | ~F.col("high.open")
    return bounds.where((F.col("low.value") > F.col("high.value")) | ((F.col("low.value") == F.col("high.value")) & strict)).select("strategy_id", "branch", "indicator")


def lint(table: DataFrame) -> DataFrame:
    """One row for each fault of a rule table: unknown indicators and comparisons, too many leaves or branches."""
    sizes = table.groupBy("strategy_id").agg(F.count("*").alias("leaves"), (F.max("branch") + 1).alias("branches"))
    issue = lambda df, code, path: df.select("strategy_id", F.lit(code).alias("code"), path.cast("string").alias("path"))
    return (
        issue(table.where(~F.col("indicator").isin(*INDICATORS)), "UNKNOWN_INDICATOR", F.col("indicator"))
        .unionByName(issue(table.where(~F.col("op").isin(*COMPARISONS)), "UNKNOWN_COMPARISON", F.col("op")))
        .unionByName(issue(sizes.where(F.col("leaves") > MAX_LEAVES), "TOO_MANY_LEAVES", F.col("leaves")))
        .unionByName(issue(sizes.where(F.col("branches") > MAX_BRANCHES), "TOO_MANY_BRANCHES", F.col("branches")))
        .distinct()
    )


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
