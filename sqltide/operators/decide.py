"""Keep or drop: transaction state, rule matrix and the ordered decision."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltide.functions.sqltext import classify_sql, invokes_any, matches_any
from sqltide.operators import scan
from sqltide.schemas import STMT_CLASSES

MODES = ("custom", "write_only", "all", "ddl_only", "dml_only")

# Spellings of rule keys.
RULE_KEYS = {
    "select": "plain_select", "plain_select": "plain_select", "proc_select": "proc_select",
    "call": "call", "dml": "dml", "ddl": "ddl", "begin": "begin",
    "commit_rollback": "commit_rollback", "set": "utility", "utility": "utility",
    "copy_from": "copy_from", "copy": "copy_from",
}


@dataclass(frozen=True)
class FilterOptions:
    mode: str = "custom"
    rules: dict = field(default_factory=dict)       # key -> (in_transaction, out_transaction)
    exclude_patterns: tuple[str, ...] = ()
    include_patterns: tuple[str, ...] = ()
    replayable_procedures: tuple[str, ...] = ()
    builtin_functions: tuple[str, ...] = ()


def resolve_rules(mode: str = "custom", rules: dict | None = None) -> dict:
    """Rule of each class as ``{class: (in_transaction, out_transaction)}``."""
    name = (mode or "").strip().lower() or "custom"
    if name not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    classes = [c for c in STMT_CLASSES if c != "unknown"]
    if name in ("ddl_only", "dml_only"):
        only = name.removesuffix("_only")
        return {c: ("keep", "keep") if c == only else ("drop", "drop") for c in classes}
    plain = {"custom": ("keep", "drop"), "write_only": ("drop", "drop"), "all": ("keep", "keep")}
    table = {c: ("keep", "keep") for c in classes} | {"plain_select": plain[name]}
    if name == "custom":
        for key, actions in (rules or {}).items():
            cls = RULE_KEYS.get(key.strip().lower())
            pair = tuple(a.strip().lower() for a in actions)
            if cls is None or len(pair) != 2 or not set(pair) <= {"keep", "drop"}:
                raise ValueError(f"rule {key!r}: {actions!r} is not valid")
            table[cls] = pair
    return table


def rule_matrix(spark: SparkSession, mode: str = "custom",
                rules: dict | None = None) -> DataFrame:
    """The rules as a table of at most nine rows."""
    table = resolve_rules(mode, rules)
    return spark.createDataFrame(
        [(c, *pair) for c, pair in table.items()],
        "stmt_class string, in_tx string, out_tx string")


def with_class(events: DataFrame, builtins=()) -> DataFrame:
    return events.withColumn("stmt_class", classify_sql(F.col("sql"), builtins))


def tx_state(events: DataFrame, keys=("conn_key",), hot_rows: int = scan.HOT_ROWS,
             width: int = scan.RANGE_WIDTHS[0]) -> DataFrame:
    """State before each event: the latest signal so far on its connection, else idle.

    Signals are BEGIN, COMMIT and ROLLBACK, and the status byte of rows that have one in
    ``tx_status`` (I, T, E; others are ignored).
    """
    signal = F.when(F.col("stmt_class") == "begin", "in_tx") \
        .when(F.col("stmt_class") == "commit_rollback", "idle")
    if "tx_status" in events.columns:
        status = F.col("tx_status")
        signal = F.coalesce(
            F.when(status == "I", "idle").when(status == "T", "in_tx")
             .when(status == "E", "failed"), signal)
    rows = scan.running_by(events, list(keys), "pos", {"tx_state": scan.latest(signal)},
                           hot_rows, width)
    return rows.withColumn("tx_state", F.coalesce("tx_state", F.lit("idle")))


def decide(events: DataFrame, opts: FilterOptions = FilterOptions()) -> DataFrame:
    """Add ``action`` (keep or drop) and ``reason``; needs ``stmt_class`` and ``tx_state``."""
    matrix = F.broadcast(rule_matrix(events.sparkSession, opts.mode, opts.rules))
    sql, cls = F.col("sql"), F.col("stmt_class")
    is_select = cls.isin("plain_select", "proc_select")
    by_rule = F.coalesce(
        F.when(F.col("tx_state") == "in_tx", F.col("in_tx")).otherwise(F.col("out_tx")),
        F.lit("drop"))
    reason = (
        F.when(matches_any(sql, opts.exclude_patterns), "exclude")
         .when(cls == "unknown", "indeterminate")
         .when(is_select & matches_any(sql, opts.include_patterns), "include")
         .when(is_select & invokes_any(sql, opts.replayable_procedures), "replayable")
         .otherwise("rule"))
    action = (
        F.when(F.col("reason").isin("exclude", "indeterminate"), "drop")
         .when(F.col("reason").isin("include", "replayable"), "keep")
         .otherwise(by_rule))
    return (events.join(matrix, "stmt_class", "left")
            .withColumn("reason", reason).withColumn("action", action)
            .select(*events.columns, "action", "reason"))


def decisions(events: DataFrame, opts: FilterOptions = FilterOptions(),
              hot_rows: int = scan.HOT_ROWS) -> DataFrame:
    """Classify, find the transaction state and decide, for events of client traffic."""
    classed = with_class(events, opts.builtin_functions)
    return decide(tx_state(classed, hot_rows=hot_rows), opts)


def classified_counts(decided: DataFrame) -> DataFrame:
    """Counter by class and outcome."""
    return decided.groupBy(
        "stmt_class", F.when(F.col("action") == "keep", "true").otherwise("false").alias("kept"),
    ).agg(F.count(F.lit(1)).alias("n"))
