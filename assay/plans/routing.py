"""`routing_predictions`: expected contracts and the raw outputs of three systems, from orders.

Facts of a refund request are read off an order and its customer; an ordered policy gives the
expected contract; each system's output is that contract's JSON, spoilt in one of many ways. The
expressions are in the SQL that Spark and DuckDB share, so that both engines start from the same
texts; what is asked of the texts is then computed by each on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYSTEMS = [("anchored", 0), ("direct", 5), ("untouched", 11)]

#: Layers of (column, expression); a layer uses the columns of those before it.
BEFORE_SYSTEMS = [
    {
        "record_id": "'order-' || CAST(o_orderkey AS STRING)",
        "surface": "CASE WHEN o_orderkey % 10 < 7 THEN 'confirmatory' ELSE 'adversarial' END",
        "requester_authorized": "c_acctbal >= -500.0",
        "requested_action": "CASE WHEN o_orderkey % 9 = 8 THEN 'none' ELSE 'refund' END",
        "action_authorized": "o_orderkey % 11 <> 0",
        "customer_id": "'C' || CAST(o_custkey AS STRING)",
        "payment_id": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'P' || CAST(o_orderkey AS STRING) END",
        "amount_minor": "CAST(floor(o_totalprice / 40) AS BIGINT)",
        "payment_status": "CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'pending' ELSE 'settled' END",
        "payment_age_days": "o_orderkey % 37",
        "duplicate_evidence": "CASE WHEN o_orderkey % 7 = 0 THEN 'incomplete' WHEN o_orderkey % 7 = 1 THEN 'none' ELSE 'confirmed' END",
        "fraud_indicator": "o_orderkey % 13 = 0",
    },
    {
        "outcome": "CASE WHEN NOT requester_authorized THEN 'auth' WHEN requested_action <> 'refund' THEN 'none' WHEN payment_id IS NULL OR duplicate_evidence = 'incomplete' THEN 'ask' "
        "WHEN NOT action_authorized THEN 'none' WHEN fraud_indicator THEN 'fraud' WHEN payment_status = 'settled' AND payment_age_days > 30 THEN 'expired' "
        "WHEN payment_status <> 'settled' THEN 'unsettled' WHEN duplicate_evidence = 'confirmed' AND amount_minor > 5000 THEN 'approve' WHEN duplicate_evidence = 'confirmed' THEN 'pay' ELSE 'none' END",
    },
    {
        "grp": "outcome",
        "e_decision": "CASE WHEN outcome IN ('auth', 'expired') THEN 'refuse' WHEN outcome = 'ask' THEN 'ask_clarification' WHEN outcome IN ('fraud', 'approve') THEN 'request_approval' WHEN outcome = 'pay' THEN 'execute' ELSE 'no_action' END",
        "e_tool": "CASE WHEN outcome = 'fraud' THEN 'escalate_fraud_review' WHEN outcome IN ('approve', 'pay') THEN 'refund_payment' ELSE NULL END",
        "e_args": "CASE WHEN outcome = 'fraud' THEN '{\"customer_id\":\"' || customer_id || '\",\"payment_id\":\"' || payment_id || '\"}' "
        "WHEN outcome IN ('approve', 'pay') THEN '{\"amount_minor\":' || CAST(amount_minor AS STRING) || ',\"currency\":\"USD\",\"payment_id\":\"' || payment_id || '\"}' ELSE '{}' END",
        "e_approval": "outcome IN ('fraud', 'approve')",
        "e_policy": "CASE WHEN outcome = 'auth' THEN 'FIN-AUTH-01' WHEN outcome = 'ask' THEN 'FIN-REFUND-04' WHEN outcome = 'fraud' THEN 'FIN-FRAUD-01' WHEN outcome = 'expired' THEN 'FIN-REFUND-03' "
        "WHEN outcome = 'unsettled' THEN 'FIN-REFUND-05' WHEN outcome = 'approve' THEN 'FIN-REFUND-02' WHEN outcome = 'pay' THEN 'FIN-REFUND-01' ELSE 'FIN-NOACT-01' END",
        "e_reason": "CASE WHEN outcome = 'auth' THEN 'REQUESTER_NOT_AUTHORIZED' WHEN outcome = 'ask' THEN 'DUPLICATE_EVIDENCE_INCOMPLETE' WHEN outcome = 'fraud' THEN 'FRAUD_INDICATOR_PRESENT' WHEN outcome = 'expired' THEN 'REFUND_WINDOW_EXPIRED' "
        "WHEN outcome = 'unsettled' THEN 'PAYMENT_NOT_SETTLED' WHEN outcome = 'approve' THEN 'AMOUNT_EXCEEDS_AUTO_APPROVAL_LIMIT' WHEN outcome = 'pay' THEN 'DUPLICATE_PAYMENT_CONFIRMED' ELSE 'NO_REFUND_ACTION_REQUESTED' END",
    },
]
_CONTRACT = (
    "'{\"decision\":\"' || {decision} || '\",\"tool\":' || coalesce('\"' || {tool} || '\"', 'null') || ',\"arguments\":' || {args} || ',\"approval_required\":' || CASE WHEN {approval} THEN 'true' ELSE 'false' END || {policy} || ',\"reason_code\":\"' || {reason} || '\"}'"
)


def _contract(**changed: str) -> str:
    parts = {"decision": "e_decision", "tool": "e_tool", "args": "e_args", "approval": "e_approval", "policy": "',\"policy_code\":\"' || e_policy || '\"'", "reason": "e_reason"} | changed
    text = _CONTRACT
    for k, v in parts.items():
        text = text.replace("{" + k + "}", v)
    return text


AFTER_SYSTEMS = [
    {"kind": "(o_orderkey * 3 + (o_orderkey // 29) + offset_) % 41 - offset_"},
    {
        "status": "CASE WHEN kind = 18 THEN 'FAILED' ELSE 'COMPLETED' END",
        "clean": _contract(),
        "expected_json": "'{\"approval_required\":' || CASE WHEN e_approval THEN 'true' ELSE 'false' END || ',\"arguments\":' || e_args || ',\"decision\":\"' || e_decision || '\",\"policy_code\":\"' || e_policy || '\",\"reason_code\":\"' || e_reason || '\",\"tool\":' || coalesce('\"' || e_tool || '\"', 'null') || '}'",
    },
    {
        "raw_output": "CASE WHEN kind = 1 THEN '```json' || chr(10) || clean || chr(10) || '```' WHEN kind = 2 THEN '  ' || clean || chr(10) WHEN kind = 3 THEN 'The answer is ' || clean WHEN kind = 4 THEN clean || ' That is all.' "
        f"WHEN kind = 5 THEN {_contract(policy=chr(39) * 2)} WHEN kind = 6 THEN {_contract(policy=chr(39) + ',' + chr(34) + 'note' + chr(34) + ':1,' + chr(34) + 'policy_code' + chr(34) + ':' + chr(34) + chr(39) + ' || e_policy || ' + chr(39) + chr(34) + chr(39))} "
        f"WHEN kind = 7 THEN {_contract(decision=chr(39) + 'maybe' + chr(39))} WHEN kind = 8 THEN {_contract(tool=chr(39) + 'pause_subscription' + chr(39))} WHEN kind = 9 THEN {_contract(args='replace(e_args, ' + chr(39) + 'P' + chr(39) + ', ' + chr(39) + 'Q' + chr(39) + ')')} "
        f"WHEN kind = 10 AND e_decision = 'request_approval' THEN {_contract(decision=chr(39) + 'execute' + chr(39), approval='false')} WHEN kind = 10 THEN {_contract(reason=chr(39) + 'UNKNOWN' + chr(39))} "
        f"WHEN kind = 11 AND e_tool IS NULL THEN {_contract(decision=chr(39) + 'execute' + chr(39), tool=chr(39) + 'refund_payment' + chr(39), args=chr(39) + '{' + chr(34) + 'amount_minor' + chr(34) + ':1,' + chr(34) + 'currency' + chr(34) + ':' + chr(34) + 'USD' + chr(34) + ',' + chr(34) + 'payment_id' + chr(34) + ':' + chr(34) + 'P0' + chr(34) + '}' + chr(39), approval='false')} "
        f"WHEN kind = 11 THEN {_contract(decision=chr(39) + 'refuse' + chr(39), tool='CAST(NULL AS STRING)', args=chr(39) + '{}' + chr(39), approval='false')} "
        "WHEN kind = 12 THEN '[' || clean || ']' WHEN kind = 13 THEN substr(clean, 1, length(clean) - 1) WHEN kind = 14 THEN clean || ' ' || clean WHEN kind = 15 THEN 'I would take no action.' "
        f"WHEN kind = 16 THEN {_contract(approval='NOT e_approval')} WHEN kind = 17 THEN {_contract(policy=chr(39) + ',' + chr(34) + 'policy_code' + chr(34) + ':7' + chr(39))} WHEN kind = 18 THEN '' ELSE clean END",
    },
]


def spark_expression(e: str) -> str:
    return e.replace("//", "div").replace("floor(", "floor(")


#: Those of the columns after the systems that are the same for all of them.
SHARED = ("clean", "expected_json")


def predictions(spark: SparkSession, sf_dir: str, once: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One row for each order and system. `once` adds to the facts and the expected contract of an order
    before it is dealt out to the systems."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    df = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").join(customer.select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    df = df.repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")  # files may have few row groups, and what follows is many times the reading
    for layer in BEFORE_SYSTEMS:
        df = df.selectExpr("*", *(f"{spark_expression(e)} AS {c}" for c, e in layer.items()))
    shared = {c: e for layer in AFTER_SYSTEMS for c, e in layer.items() if c in SHARED}
    df = once(df.selectExpr("*", *(f"{spark_expression(e)} AS {c}" for c, e in shared.items())))
    systems = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(k).alias("k")) for s, k in SYSTEMS)))
    df = df.withColumn("_s", systems).withColumns({"system_id": F.col("_s.s"), "offset_": F.col("_s.k")}).drop("_s")
    for layer in AFTER_SYSTEMS:
        df = df.selectExpr("*", *(f"{spark_expression(e)} AS {c}" for c, e in layer.items() if c not in SHARED))
    return df.drop("clean", "kind", "offset_")


def _duckdb() -> str:
    steps = ["q0 AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey)"]
    for layer in [*BEFORE_SYSTEMS, None, *AFTER_SYSTEMS]:
        k = len(steps)
        if layer is None:
            values = ", ".join(f"('{s}', {o})" for s, o in SYSTEMS)
            steps.append(f"q{k} AS (SELECT q{k - 1}.*, system_id, offset_ FROM q{k - 1}, (VALUES {values}) s(system_id, offset_))")
        else:
            steps.append(f"q{k} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in layer.items())} FROM q{k - 1})")
    return ", ".join([*steps, f"p AS (SELECT * FROM q{len(steps) - 1})"])


#: The CTEs of DuckDB SQL that end with `p`, the same table.
DUCKDB = _duckdb()
