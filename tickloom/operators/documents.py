"""Rule documents as rows: every value of a JSON text with its path and depth, and what the closed rule language forbids."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.rules import COMPARISONS, INDICATORS, MAX_DEPTH, MAX_LEAVES

# What a document must have and may hold, the words that a field's name may not have, and limits.
FIELDS = ("strategy_id", "dsl_version", "symbols", "signal_bar_size", "entry", "exit", "risk", "order_type")
RISK_FIELDS = ("stop_loss_bps", "take_profit_bps", "max_holding_minutes", "cooldown_minutes", "max_entries_per_session", "sizing_preset")
RISK_MAXIMA = {"stop_loss_bps": 10_000, "take_profit_bps": 10_000, "max_holding_minutes": 1_440, "cooldown_minutes": 1_440, "max_entries_per_session": 3}
ENUMS = {"dsl_version": ("1.0.0",), "signal_bar_size": ("15min",), "order_type": ("market", "limit"), "risk.sizing_preset": ("equal_cash_conservative", "equal_risk_conservative")}
ENUM_CODES = {"dsl_version": "DSL_UNSUPPORTED_DSL_VERSION", "signal_bar_size": "DSL_UNSUPPORTED_SIGNAL_BAR", "order_type": "DSL_UNSUPPORTED_ORDER_TYPE", "risk.sizing_preset": "DSL_INVALID_SIZING_PRESET"}
FORBIDDEN = ("python", "sql", "template", "url", "uri", "file", "filepath", "path", "import", "callable", "callback")
EXPOSURE = ("action", "side", "quantity", "exposure", "target_position", "enter", "buy", "short", "leverage")
ALIASES = {"limitprice": "limit_price", "limitoffset": "limit_offset", "limitoffsetbps": "limit_offset_bps", "limitpriceoffset": "limit_price_offset", "limitpriceoffsetbps": "limit_price_offset_bps", "priceoffset": "price_offset", "priceoffsetbps": "price_offset_bps", "targetposition": "target_position", "pythoncode": "python_code", "importmodule": "import_module"}
MOST_DEPTH, MOST_NODES = 16, 1_024

KINDS = {bool: "boolean", int: "integer", float: "number", str: "string", dict: "object", list: "array", type(None): "null"}


def _nodes(text: str | None) -> Iterator[tuple]:
    """(path, name, depth, kind, value, size) of every value of a JSON text, in page order; depth 0 is the whole. A text that is no JSON is one row
    of kind "invalid"; beyond MOST_NODES or MOST_DEPTH a row of kind "too_many" or "too_deep" takes the place of what is left out."""
    try:
        stack = [("", None, 0, json.loads(text or ""))]
    except (ValueError, RecursionError):
        yield "", None, 0, "invalid", None, 0
        return
    seen = 0
    while stack:
        path, name, depth, value = stack.pop()
        seen += 1
        if seen > MOST_NODES:
            yield path, name, depth, "too_many", None, 0
            return
        if depth > MOST_DEPTH:
            yield path, name, depth, "too_deep", None, 0
            continue
        kind, inner = KINDS[type(value)], []
        if kind == "object":
            inner = [(f"{path}.{k}" if path else k, k, v) for k, v in value.items()]
        elif kind == "array":
            inner = [(f"{path}[{i}]", None, v) for i, v in enumerate(value)]
        plain = None if kind in ("object", "array", "null") else value if kind == "string" else json.dumps(value)
        yield path, name, depth, kind, plain, len(inner)
        stack += [(p, k, depth + 1, v) for p, k, v in reversed(inner)]


def walked(documents: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each value of each document: key, path, name (of a field), depth, kind, value (as text), size (of objects and arrays). A null
    text is no JSON."""
    kind_of = dict(documents.dtypes)[key]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(own, *node) for own, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for node in _nodes(doc)]
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "path", "name", "depth", "kind", "value", "size"])

    rows = documents.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind_of}, path string, name string, depth int, kind string, value string, size int").withColumnRenamed("id", key)


def canonical(name: Column) -> Column:
    """A field's name in lower case, its words apart by underscores, whatever way it is written in."""
    split = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    plain = F.regexp_replace(F.regexp_replace(F.lower(split), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.regexp_replace(F.lower(name), r"[^a-z0-9]", "")), plain)


def forbidden_fields(nodes: DataFrame, key: str) -> DataFrame:
    """(key, code, path): fields that set limit prices, fields under exit that can raise the exposure, fields named for code or places; too many
    values, too much depth, and texts that are no JSON. Names count in any spelling: targetPosition as target_position."""
    # canonical names and their words are columns, so they are made once for a field and not in each condition
    nodes = nodes.select(key, "path", "name", "depth", "kind", canonical(F.col("name")).alias("_name")).select("*", F.split("_name", "_").alias("_words"))
    name, words = F.col("_name"), F.col("_words")
    both = lambda a, b: F.array_contains(words, a) & F.array_contains(words, b)
    limit = both("limit", "offset") | both("price", "offset") | both("limit", "price")
    inside = F.lower(F.split("path", r"[.\[]")[0]) == "exit"
    code = (
        F.when(F.col("kind") == "invalid", "DSL_INVALID_JSON").when(F.col("kind") == "too_many", "DSL_RAW_PAYLOAD_NODE_BUDGET_EXCEEDED").when(F.col("kind") == "too_deep", "DSL_RAW_PAYLOAD_DEPTH_EXCEEDED")
        .when(F.col("name").isNull(), None).when(limit, "DSL_UNSUPPORTED_LIMIT_OFFSET").when(name.isin(*EXPOSURE) & (F.col("depth") > 1) & inside, "DSL_EXIT_CAN_INCREASE_EXPOSURE")
        .when(F.arrays_overlap(words, F.array(*map(F.lit, FORBIDDEN))), "DSL_FORBIDDEN_FIELD")
    )
    return nodes.select(key, F.explode(F.array_compact(F.array(code))).alias("code"), "path")


def rule_issues(nodes: DataFrame, key: str, symbols: tuple[str, ...]) -> DataFrame:
    """(key, code, path): what a document of the rule language has wrong. Fields that are missing or not known; versions, bar sizes, order types and
    sizings that are not on the lists; symbols that are not allowed, or none; risk values that are no integers, not positive or above their
    maximum; conditions that are too deep, unknown indicators and comparisons, values that are no numbers; too many comparisons in entry
    and exit together. nodes: what walked gives."""
    top = F.col("depth") == 1
    path, kind, value = F.col("path"), F.col("kind"), F.col("value")
    in_tree = path.rlike(r"^(entry|exit)($|[.\[])")
    leaf_field = F.col("name").isin("indicator", "op", "value") & in_tree
    level = F.size(F.split(path, r"\[")) - 1  # conditions are in lists: one more for each
    number = F.when(kind == "integer", value.cast("long"))
    name = F.col("name")
    risk_max = F.element_at(F.create_map(*[x for k, v in RISK_MAXIMA.items() for x in (F.lit(k), F.lit(v))]), name)
    within = path.startswith("risk.") & (F.col("depth") == 2)
    in_risk = within & name.isin(*RISK_MAXIMA)
    enum = F.lit(None).cast("string")
    for field, allowed in ENUMS.items():
        enum = F.when((path == field) & ~((kind == "string") & value.isin(*allowed)), ENUM_CODES[field]).otherwise(enum)
    entries = name == "max_entries_per_session"
    symbol = path.startswith("symbols[") & path.rlike(r"^symbols\[\d+\]$")
    found = F.array_compact(
        F.array(
            enum,
            F.when(top & ~name.isin(*FIELDS), "DSL_UNEXPECTED_FIELD").when(within & ~name.isin(*RISK_FIELDS), "DSL_UNEXPECTED_FIELD"),
            F.when((path == "strategy_id") & ~((kind == "string") & (value != "")), "DSL_INVALID_STRATEGY_ID"),
            F.when((path == "symbols") & (kind != "array"), "DSL_INVALID_SYMBOLS_CONTAINER").when((path == "symbols") & (F.col("size") == 0), "DSL_EMPTY_SYMBOLS"),
            F.when(symbol & (kind != "string"), "DSL_INVALID_SYMBOL_TYPE").when(symbol & ~value.isin(*symbols), "DSL_UNSUPPORTED_SYMBOL"),
            F.when((path == "risk") & (kind != "object"), "DSL_INVALID_RISK"),
            F.when(in_risk & number.isNull(), "DSL_INVALID_RISK_FIELD")
            .when(in_risk & entries & (number <= 0), "DSL_NON_POSITIVE_MAX_ENTRIES").when(in_risk & entries & (number > risk_max), "DSL_MAX_ENTRIES_EXCEEDED")
            .when(in_risk & (number <= 0), "DSL_NON_POSITIVE_RISK_CONTROL").when(in_risk & (number > risk_max), "DSL_RISK_CONTROL_EXCEEDED"),
            F.when(leaf_field & (name == "indicator") & ~((kind == "string") & value.isin(*INDICATORS)), "DSL_UNKNOWN_INDICATOR")
            .when(leaf_field & (name == "op") & ~((kind == "string") & value.isin(*COMPARISONS)), "DSL_UNKNOWN_COMPARISON").when(leaf_field & (name == "value") & ~kind.isin("integer", "number"), "DSL_INVALID_VALUE"),
            F.when((kind == "object") & in_tree & (level + 1 > MAX_DEPTH), "DSL_CONDITION_DEPTH_EXCEEDED"),
        )
    )
    some = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    has = [*(some(top & (name == f)).alias(f"_{f}") for f in FIELDS), *(some(within & (name == f)).alias(f"_risk_{f}") for f in RISK_FIELDS)]
    by = nodes.groupBy(key).agg(*has, F.count_if((F.col("depth") == 0) & (kind == "object")).alias("_objects"), F.count_if(leaf_field & (name == "indicator")).alias("_leaves"))
    absent = F.array(*(F.when(~F.col(f"_{f}"), f) for f in FIELDS), *(F.when(F.col("_risk") & ~F.col(f"_risk_{f}"), f"risk.{f}") for f in RISK_FIELDS))
    lost = F.transform(F.flatten(F.array_repeat(F.array_compact(absent), F.col("_objects").cast("int"))), lambda f: F.struct(F.lit("DSL_MISSING_FIELD").alias("code"), f.alias("path")))
    leaves = F.when(F.col("_leaves") > MAX_LEAVES, F.array(F.struct(F.lit("DSL_CONDITION_LEAF_LIMIT_EXCEEDED").alias("code"), F.lit("entry").alias("path"))))
    whole = by.select(key, F.explode(F.concat(lost, F.coalesce(leaves, F.array().cast("array<struct<code:string,path:string>>")))).alias("f")).select(key, "f.*")
    own = nodes.select(key, "path", F.explode(found).alias("code")).select(key, "code", "path")
    return whole.unionByName(own)
