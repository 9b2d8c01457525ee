"""Dataset differences, reconciliation, replay, life cycles, hashes and reports (SURVEY J, R, V)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other has fewer times, with the side they are on."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def row_hash(*columns: str) -> Column:
    """SHA-256 of a row's columns as text, each with its length, nulls marked."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in sorted(columns)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def dataset_hash(df: DataFrame, *columns: str, buckets: int = 256) -> DataFrame:
    """One hash of a table, whatever its order: rows are hashed, dealt into buckets by their hash, each bucket's sorted counts of
    row hashes are hashed by pairs of a sum, and the buckets' digests are hashed in order.

    A bucket's digest is the sum of its row hashes' four 60-bit words, so no bucket is gathered in one place."""
    h = df.select(row_hash(*columns).alias("h"))
    word = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"w{i}")
    digests = h.groupBy(F.conv(F.substring("h", 1, 2), 16, 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"), *[word(i) for i in range(4)])
    text = F.concat_ws(":", "bucket", "n", *[F.col(f"w{i}").cast("string") for i in range(4)])
    return digests.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "|"), 256).alias("content_sha256"), F.sum("n").alias("row_count"))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in an order that ends in a tie-break."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def append_plan(stored: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """new with what an idempotent append does with each row: append, skip (same content) or conflict."""
    old = stored.select(F.col(key).alias("_k"), F.col(content).alias("_old"))
    state = F.when(F.col("_k").isNull(), "append").when(F.col("_old").eqNullSafe(F.col(content)), "skip").otherwise("conflict")
    return new.join(old, F.col(key) == F.col("_k"), "left").withColumn("action", state).drop("_k", "_old")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with new's rows in place of those of the same key."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def reconcile(local: DataFrame, broker: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each key that differs: UNKNOWN_AT_LOCAL, MISSING_AT_BROKER or <FIELD>_MISMATCH codes, sorted."""
    a, b = local.select(key, F.struct(*fields).alias("a")), broker.select(key, F.struct(*fields).alias("b"))
    both = a.join(b, key, "full")
    codes = [F.when(F.col("a").isNull(), "UNKNOWN_AT_LOCAL"), F.when(F.col("b").isNull(), "MISSING_AT_BROKER")]
    codes += [F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f"{f.upper()}_MISMATCH") for f in fields]
    found = F.array_sort(F.array_compact(F.array(*codes)))
    return both.select(key, F.array_join(found, ",").alias("codes")).where("codes <> ''")


def replay(logs: dict[str, DataFrame], entity: str, time: str, identity: str, payload: str) -> DataFrame:
    """Latest payload of each entity over several logs, in the order (time, kind, id); events counts distinct ids."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(entity).alias("entity"), F.col(time).alias("t"), F.col(identity).alias("id"), F.col(payload).alias("payload")) for kind, df in sorted(logs.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("entity").agg(F.max_by("payload", F.struct("t", "kind", "id")).alias("payload"), F.max("t").alias("last_time"), F.countDistinct("kind", "id").alias("events"))


def transitions(log: DataFrame, key: str, order: str, state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Each event with the state before it and whether the step is allowed; a key's first event is."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(order))
    pairs = F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in allowed])
    rows = log.withColumn("from_state", before)
    return rows.withColumn("legal", F.col("from_state").isNull() | F.array_contains(F.transform(pairs, lambda p: F.concat_ws(">", p["col1"], p["col2"])), F.concat_ws(">", "from_state", state)))


def chain_breaks(stages: DataFrame, key: str, ordinal: str, own: str, previous: str) -> DataFrame:
    """Stages whose recorded predecessor hash is not the one before them, or whose ordinal leaves a gap."""
    w = Window.partitionBy(key).orderBy(ordinal)
    rows = stages.select("*", F.lag(own).over(w).alias("_own"), F.lag(ordinal).over(w).alias("_at"))
    return rows.where(~F.col("_own").eqNullSafe(F.col(previous)) | (F.col("_at") + 1 != F.col(ordinal))).drop("_own", "_at")


def order_key(*columns: str) -> Column:
    """po_ and the URL-safe base64 of the columns' SHA-256."""
    digest = F.unhex(F.sha2(F.concat_ws("|", *columns), 256))
    return F.concat(F.lit("po_"), F.rtrim(F.translate(F.base64(digest), "+/", "-_"), F.lit("=")))


def tampered(df: DataFrame, payload: str, digest: str) -> DataFrame:
    """Rows whose stored hash is not that of their payload."""
    return df.where(~F.sha2(payload, 256).eqNullSafe(F.col(digest)))


def offending(df: DataFrame, checks: dict[str, str], key: str) -> DataFrame:
    """(key, check) for each row and named condition that doesn't hold; a null condition doesn't hold."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), n) for n, c in sorted(checks.items())]))
    return df.select(key, F.explode(failed).alias("check"))


def field_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for each column of two one-row tables whose values differ, both as text."""
    text = lambda df, name: df.select([F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "field", name)
    both = text(a, "left_value").join(text(b, "right_value"), "field", "full")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


# States of orders that are still open, and the codes that a reconciliation gives.
OPEN_STATUSES = ("accepted", "partially_filled", "pending", "submitted")
RECOVERABLE = ("LOCAL_ORDER_STATUS_STALE", "PENDING_ENTRY_FILLED_AT_BROKER")


def order_discrepancies(local: DataFrame, broker: DataFrame, local_positions: DataFrame, broker_positions: DataFrame) -> DataFrame:
    """(account, code) of the orders of either side that disagree. Orders: account, order_id, symbol, side, quantity, filled, status, one row
    each; positions: account, symbol, held. An open local order that the broker lacks is a filled entry if the broker's position is what the
    local one would be with it."""
    cols = ("symbol", "side", "quantity", "filled", "status")
    here = local.select("account", "order_id", *[F.col(c).alias(f"l_{c}") for c in cols], F.lit(True).alias("l"))
    there = broker.select("account", "order_id", *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("b"))
    both = here.join(there, ["account", "order_id"], "full").withColumn("symbol", F.coalesce("l_symbol", "b_symbol"))
    held = local_positions.select("account", "symbol", F.col("held").alias("l_held"), F.lit(0).alias("_")).drop("_")
    both = both.join(held, ["account", "symbol"], "left").join(broker_positions.select("account", "symbol", F.col("held").alias("b_held")), ["account", "symbol"], "left")
    open_ = F.col("l_status").isin(*OPEN_STATUSES)
    same = (F.col("l_symbol") == F.col("b_symbol")) & (F.col("l_side") == F.col("b_side")) & (F.col("l_quantity") == F.col("b_quantity"))
    expected = F.coalesce("l_held", F.lit(0)) + F.col("l_quantity") - F.col("l_filled")
    code = (
        F.when(F.col("l").isNull(), "UNKNOWN_BROKER_ORDER")
        .when(F.col("b").isNotNull() & ~same, "ORDER_IDENTITY_MISMATCH")
        .when(F.col("b").isNotNull() & (F.col("l_status") != F.col("b_status")), F.when(open_ & (F.col("b_status") == "filled"), "LOCAL_ORDER_STATUS_STALE").otherwise("ORDER_STATUS_MISMATCH"))
        .when(F.col("b").isNull() & open_, F.when((F.col("l_side") == "buy") & (F.col("b_held") == expected), "PENDING_ENTRY_FILLED_AT_BROKER").otherwise("LOCAL_OPEN_ORDER_MISSING_AT_BROKER"))
    )
    return both.select("account", "symbol", code.alias("code")).where("code IS NOT NULL")


def position_discrepancies(local: DataFrame, broker: DataFrame, explained: DataFrame) -> DataFrame:
    """(account, code) of positions (account, symbol, held) that disagree; explained: those that a filled entry explains."""
    both = local.select("account", "symbol", F.col("held").alias("l")).join(broker.select("account", "symbol", F.col("held").alias("b")), ["account", "symbol"], "full")
    both = both.join(explained.select("account", "symbol", F.lit(True).alias("known")).distinct(), ["account", "symbol"], "left")
    code = (
        F.when(F.col("l").isNull(), F.when(F.col("known").isNull(), "BROKER_POSITION_MISSING_LOCALLY"))
        .when(F.col("b").isNull(), "LOCAL_POSITION_MISSING_AT_BROKER")
        .when(F.col("l") != F.col("b"), "POSITION_QUANTITY_MISMATCH")
    )
    return both.select("account", "symbol", code.alias("code")).where("code IS NOT NULL")


def reconciliation_status(accounts: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """Each account's status (clean, recoverable, blocked) and its codes: the blocking ones if there are any."""
    soft = F.col("code").isin(*RECOVERABLE)
    by = discrepancies.groupBy("account").agg(F.array_sort(F.collect_set(F.when(~soft, F.col("code")))).alias("hard"), F.array_sort(F.collect_set(F.when(soft, F.col("code")))).alias("soft"))
    rows = accounts.select("account").distinct().join(by, "account", "left")
    codes = F.when(F.size("hard") > 0, F.col("hard")).otherwise(F.col("soft"))
    status = F.when(F.size("hard") > 0, "blocked").when(F.size("soft") > 0, "recoverable").otherwise("clean")
    return rows.select("account", status.alias("status"), F.coalesce(F.array_join(codes, ","), F.lit("")).alias("codes"))


def id_faults(declared: DataFrame, used: DataFrame, key: str = "id") -> DataFrame:
    """(key, issue, declared, used) of ids that are not declared once and used once: UNKNOWN (used only), UNUSED (declared only), NOT_UNIQUE
    (declared twice), COUNT_DIFFERS (used another number of times)."""
    many = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = many(declared, "declared").join(many(used, "used"), key, "full").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("declared", "used")])
    issue = F.when(F.col("declared") == 0, "UNKNOWN").when(F.col("used") == 0, "UNUSED").when(F.col("declared") > 1, "NOT_UNIQUE").when(F.col("used") != 1, "COUNT_DIFFERS")
    return both.withColumn("issue", issue).where("issue IS NOT NULL").select(key, "issue", "declared", "used")
