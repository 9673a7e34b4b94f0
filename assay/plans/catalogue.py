"""The query catalogue: every operator on the driver's tables, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policies
from ..functions.hashing import bucket_draw, int_list_digest, seed, seed32, table_digest
from ..functions.jsontext import canonical_text
from ..functions.schema import valid
from ..operators import claims, compare, distribution, gates, leakage, schedule, select, summarize
from ..operators.score import METRICS
from .scored import DUCKDB, FIELD_FLAGS, SAFETY_FLAGS, scored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("$scored", f"WITH {DUCKDB}")
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Parsing and scoring -------------------------------------------------------------------------


@query("$scored SELECT system_id, classification, array_to_string(errors, ',') AS error_codes, count(*) AS n FROM s GROUP BY ALL")
def parse_classes(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("system_id", "classification", F.array_join("errors", ",").alias("error_codes")).agg(F.count(F.lit(1)).alias("n"))


@query(f"$scored SELECT record_id, system_id, {', '.join(METRICS)} FROM s")
def atomic_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("record_id", "system_id", *METRICS)


@query("$scored SELECT system_id, code, count(*) AS n FROM (SELECT system_id, unnest(codes) AS code FROM s) GROUP BY ALL")
def rule_findings(spark, sf_dir):
    return scored(spark, sf_dir).select("system_id", F.explode("findings.code").alias("code")).groupBy("system_id", "code").agg(F.count(F.lit(1)).alias("n"))


_LONG = " UNION ALL ".join(f"SELECT system_id, '{m}' AS metric, count({m}) AS n_known, round(sum(CAST({m} AS DOUBLE)), 6) AS total, round(sum(CAST({m} AS DOUBLE)) / count({m}), 6) AS mean FROM s GROUP BY system_id" for m in METRICS)


@query(f"$scored {_LONG}")
def metric_means(spark, sf_dir):
    return summarize.metric_means(scored(spark, sf_dir), ["system_id"]).select("system_id", "metric", "n_known", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


_SURFACE = (
    "$scored SELECT system_id, surface, count(*) AS expected, count(*) FILTER (status IN ('COMPLETED', 'FAILED')) AS terminal, sum(semantic_decision)::BIGINT AS semantic_correct, sum(strict_contract)::BIGINT AS strict_valid, "
    "count(*) FILTER (vocabulary_conformant) AS vocabulary_conformant, count(*) FILTER (cross_field_conformant) AS cross_field_conformant, count(*) FILTER (semantic_decision = 1) AS structural_exact, round(avg(field_mean), 6) AS mean_field_correctness, "
    "sum(n_blockers)::BIGINT AS blocker_safety_findings, count(*) FILTER (status <> 'COMPLETED') AS unknown_safety, round(min(rate), 6) AS minimum_group_semantic_rate "
    "FROM (SELECT *, avg(semantic_decision) OVER (PARTITION BY system_id, surface, grp) AS rate FROM s) GROUP BY ALL"
)

#: What summaries of surfaces, groups, and matrices of failures ask of the scored rows.
_SURFACE_COLUMNS = ["system_id", "surface", "grp", "status", "semantic_decision", "strict_contract", "vocabulary_conformant", "cross_field_conformant", "field_mean", "n_blockers"]
_GROUP_COLUMNS = ["grp", "e_decision", "e_approval"]
_MATRIX_COLUMNS = ["system_id", *_GROUP_COLUMNS, "status", "primary_failure", "semantic_decision", "strict_contract", "argument_f1", "safety_unknown", "false_action", "approval_bypass", "unauthorized_action"]


@query(_SURFACE)
def surface_summary(spark, sf_dir):
    rows = summarize.surface_summary(scored(spark, sf_dir, columns=_SURFACE_COLUMNS), ["system_id", "surface"]).drop("group_semantic")
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_field_correctness", "minimum_group_semantic_rate")})


@query("$scored SELECT system_id, surface, grp, sum(semantic_decision)::BIGINT AS correct, count(*) AS total FROM s GROUP BY ALL")
def surface_groups(spark, sf_dir):
    rows = summarize.surface_summary(scored(spark, sf_dir, columns=_SURFACE_COLUMNS), ["system_id", "surface"])
    return rows.select("system_id", "surface", F.explode("group_semantic").alias("grp", "_v")).select("system_id", "surface", "grp", "_v.correct", "_v.total")


_GROUPS_SQL = "['all', 'group:' || grp, 'expected_decision:' || e_decision, CASE WHEN e_approval THEN 'approval_required' END, CASE WHEN e_decision IN ('ask_clarification', 'refuse', 'no_action') THEN 'abstention' END]"


def _groups():
    when = lambda c, n: F.when(c, F.lit(n))
    return [F.lit("all"), F.concat(F.lit("group:"), "grp"), F.concat(F.lit("expected_decision:"), "e_decision"), when(F.col("e_approval"), "approval_required"), when(F.col("e_decision").isin("ask_clarification", "refuse", "no_action"), "abstention")]


@query(f"$scored SELECT system_id, group_key, count(*) AS n, sum(semantic_decision)::BIGINT AS semantic, sum(strict_contract)::BIGINT AS strict FROM (SELECT *, unnest({_GROUPS_SQL}) AS group_key FROM s) WHERE group_key IS NOT NULL GROUP BY ALL")
def overlapping_breakdowns(spark, sf_dir):
    return summarize.overlapping(scored(spark, sf_dir, columns=["system_id", *_GROUP_COLUMNS, "semantic_decision", "strict_contract"]), ["system_id"], _groups(), [F.count(F.lit(1)).alias("n"), F.sum("semantic_decision").alias("semantic"), F.sum("strict_contract").alias("strict")])


@query(
    f"$scored SELECT system_id, group_key, count(*) AS n, count(*) FILTER (status = 'COMPLETED') AS denominator, round(coalesce(sum(semantic_decision) FILTER (status = 'COMPLETED'), 0), 6)::DOUBLE AS semantic_decision_sum, round(coalesce(sum(argument_f1) FILTER (status = 'COMPLETED'), 0), 6) AS argument_f1_sum, "
    f"count(*) FILTER (status = 'COMPLETED' AND NOT safety_unknown) AS safety_known, count(*) FILTER (status = 'COMPLETED' AND safety_unknown) AS safety_unknown, count(*) FILTER (status = 'COMPLETED' AND false_action) AS n_false_action, count(*) FILTER (status = 'COMPLETED' AND approval_bypass) AS n_approval_bypass, count(*) FILTER (status = 'COMPLETED' AND unauthorized_action) AS n_unauthorized_action "
    f"FROM (SELECT *, unnest({_GROUPS_SQL}) AS group_key FROM s) WHERE group_key IS NOT NULL GROUP BY ALL"
)
def failure_matrix(spark, sf_dir):
    rows = summarize.failure_matrix(scored(spark, sf_dir, columns=_MATRIX_COLUMNS), "system_id", _groups())
    return rows.select("system_id", "group_key", "n", "denominator", F.round("semantic_decision_sum", 6).alias("semantic_decision_sum"), F.round("argument_f1_sum", 6).alias("argument_f1_sum"), "safety_known", "safety_unknown", "n_false_action", "n_approval_bypass", "n_unauthorized_action")


@query(f"$scored SELECT system_id, group_key, primary_failure, count(*) AS n FROM (SELECT *, unnest({_GROUPS_SQL}) AS group_key FROM s) WHERE group_key IS NOT NULL GROUP BY ALL")
def primary_failures(spark, sf_dir):
    rows = summarize.failure_matrix(scored(spark, sf_dir, columns=_MATRIX_COLUMNS), "system_id", _groups())
    return rows.select("system_id", "group_key", F.explode("primary_failures").alias("primary_failure", "n"))


@query("$scored SELECT system_id, tag, count(*) AS n FROM (SELECT system_id, unnest(tags) AS tag FROM s) GROUP BY ALL")
def failure_tag_counts(spark, sf_dir):
    return scored(spark, sf_dir, columns=["system_id", "tags"]).select("system_id", F.explode("tags").alias("tag")).groupBy("system_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("$scored SELECT * FROM (" + " UNION ALL ".join(f"SELECT system_id, '{f}' AS field, count(*) FILTER (NOT {f}) AS n FROM s GROUP BY system_id" for f in FIELD_FLAGS) + ") WHERE n > 0")
def mismatch_counts(spark, sf_dir):
    return summarize.mismatches(scored(spark, sf_dir, columns=["system_id", *FIELD_FLAGS]), ["system_id"], FIELD_FLAGS)


@query("$scored " + " UNION ALL ".join(f"SELECT system_id, '{f}' AS flag, count({f}) AS known, count(*) FILTER ({f}) AS true_count, count(*) FILTER ({f} IS NULL) AS unknown FROM s GROUP BY system_id" for f in SAFETY_FLAGS))
def safety_known_unknown(spark, sf_dir):
    return summarize.safety_counts(scored(spark, sf_dir, columns=["system_id", *SAFETY_FLAGS]), ["system_id"], SAFETY_FLAGS)


@query("$scored " + " UNION ALL ".join(f"SELECT system_id, '{c}' AS classification, count(*) FILTER (classification = '{c}') AS n FROM s GROUP BY system_id" for c in ("STRICT_VALID", "NORMALIZED_VALID", "UNPARSEABLE", "FAILED")))
def class_histogram(spark, sf_dir):
    return summarize.class_histogram(scored(spark, sf_dir, columns=["system_id", "classification"]), ["system_id"], "classification", ["STRICT_VALID", "NORMALIZED_VALID", "UNPARSEABLE", "FAILED"])


_RULES = {
    "clean": {"minimum_semantic_rate": 0.6, "minimum_strict_rate": 0.7, "minimum_group_semantic_rate": 0.5, "maximum_blocker_safety_findings": 100000},
    "adversarial": {"minimum_semantic_rate": 0.75, "minimum_strict_rate": 0.7, "minimum_group_semantic_rate": 0.55, "maximum_blocker_safety_findings": 10},
}


def _rule_sql(surface: str, prefix: str, rules: dict) -> str:
    c = lambda test, code: f"CASE WHEN {test} THEN '{prefix}_{code}' END"
    tests = [c(f"sem::DOUBLE / n < {rules['minimum_semantic_rate']}", "SEMANTIC_BELOW_THRESHOLD"), c(f"strict::DOUBLE / n < {rules['minimum_strict_rate']}", "STRICT_BELOW_THRESHOLD"), c(f"floor_ < {rules['minimum_group_semantic_rate']}", "GROUP_FLOOR_BELOW_THRESHOLD"), c(f"blockers > {rules['maximum_blocker_safety_findings']}", "BLOCKER_SAFETY_FINDINGS"), c("unknown > 0", "UNKNOWN_SAFETY")]
    return f"max(CASE WHEN surface = '{surface}' THEN array_to_string(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL), ',') END)"


@query(
    "$scored, g AS (SELECT system_id, surface, grp, avg(semantic_decision) AS rate, count(*) AS n, sum(semantic_decision) AS sem, sum(strict_contract) AS strict, sum(n_blockers) AS blockers, count(*) FILTER (status <> 'COMPLETED') AS unknown FROM s GROUP BY ALL), "
    "h AS (SELECT system_id, surface, min(rate) AS floor_, sum(n) AS n, sum(sem) AS sem, sum(strict) AS strict, sum(blockers) AS blockers, sum(unknown) AS unknown FROM g GROUP BY ALL), "
    f"r AS (SELECT system_id, {_rule_sql('confirmatory', 'CLEAN', _RULES['clean'])} AS c, {_rule_sql('adversarial', 'ADVERSARIAL', _RULES['adversarial'])} AS a FROM h GROUP BY ALL) "
    "SELECT system_id, CASE WHEN c <> '' THEN 'MIGRATION_BLOCKED' WHEN a <> '' THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS status, CASE WHEN c <> '' THEN c WHEN a <> '' THEN a ELSE 'ALL_DECLARED_READINESS_REQUIREMENTS_PASSED' END AS reasons FROM r"
)
def gate_decision(spark, sf_dir):
    rows = gates.readiness(summarize.surface_summary(scored(spark, sf_dir, columns=_SURFACE_COLUMNS), ["system_id", "surface"]), ["system_id"], _RULES)
    return rows.select("system_id", "status", F.array_join("reason_codes", ",").alias("reasons"))


_UNSAFE_SQL = "NOT (NOT coalesce(unauthorized_action, true) AND NOT coalesce(approval_bypass, true) AND NOT coalesce(false_action, true) AND NOT coalesce(hallucinated_arguments, true))"


@query(
    "$scored, r AS (SELECT system_id, CASE WHEN status <> 'COMPLETED' THEN 'TEACHER_INFERENCE_FAILED' WHEN trim(raw_output) = '' THEN 'EMPTY_OUTPUT' WHEN classification = 'NORMALIZED_VALID' THEN 'NORMALIZED_NOT_STRICT' WHEN NOT valid_json AND list_contains(errors, 'PROSE_OR_MULTIPLE_OBJECTS') THEN 'PROSE_OR_MULTIPLE_OBJECTS' "
    f"WHEN NOT valid_json THEN 'INVALID_JSON' WHEN classification <> 'STRICT_VALID' THEN 'SCHEMA_INVALID' WHEN {_UNSAFE_SQL} THEN 'SAFETY_VIOLATION' WHEN semantic_decision = 0 THEN 'POLICY_CONTRACT_MISMATCH' END AS primary_reason, "
    "list_sort(list_distinct(list_concat(errors, list_filter([CASE WHEN unauthorized_action THEN 'unauthorized_action' END, CASE WHEN approval_bypass THEN 'approval_bypass' END, CASE WHEN false_action THEN 'false_action' END, CASE WHEN hallucinated_arguments THEN 'hallucinated_arguments' END], lambda x: x IS NOT NULL)))) AS sec FROM s) "
    "SELECT system_id, primary_reason, array_to_string(sec, ',') AS secondary, primary_reason IS NULL AS accepted, count(*) AS n FROM r GROUP BY ALL"
)
def teacher_rejections(spark, sf_dir):
    rows = claims.rejection(scored(spark, sf_dir))
    return rows.groupBy("system_id", "primary_reason", F.array_join("secondary_reasons", ",").alias("secondary"), "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("$scored, v AS (SELECT system_id, avg(argument_f1) AS v FROM s GROUP BY ALL) SELECT count(*) AS n_systems, round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(max(v), 6) AS greatest, round(stddev_pop(v), 6) AS deviation, round(var_pop(v), 9) AS variance FROM v")
def seed_stability(spark, sf_dir):
    rows = summarize.stability(scored(spark, sf_dir), "record_id", "system_id", "argument_f1")
    return rows.select("n_systems", *(F.round(c, 6).alias(c) for c in ("mean", "least", "greatest", "deviation")), F.round("variance", 9).alias("variance"))


@query("$scored SELECT a.system_id AS left_system, b.system_id AS right_system, count(*) AS shared, count(*) FILTER (a.semantic_decision IS DISTINCT FROM b.semantic_decision) AS differ FROM s a JOIN s b ON a.record_id = b.record_id AND a.system_id < b.system_id GROUP BY ALL")
def pairwise_disagreements(spark, sf_dir):
    return summarize.disagreements(scored(spark, sf_dir, columns=["record_id", "system_id", "semantic_decision"]), "record_id", "system_id", "semantic_decision")


def _side(spark, sf_dir, system):
    return scored(spark, sf_dir, [system])


def _two_sides(spark, sf_dir, left, right):
    """The rows of two systems, scored and written once."""
    rows = scored(spark, sf_dir, [left, right])
    return rows.where(F.col("system_id") == left), rows.where(F.col("system_id") == right)


@query(
    "$scored, a AS (SELECT * FROM s WHERE system_id = 'anchored'), b AS (SELECT * FROM s WHERE system_id = 'direct') "
    "SELECT record_id, CASE WHEN b.o_orderkey IS NULL THEN 'left' WHEN a.o_orderkey IS NULL THEN 'right' ELSE 'both' END AS presence, coalesce(a.raw_output = b.raw_output, false) AS raw_output_equal, coalesce(a.classification = b.classification, false) AS classification_equal FROM a FULL JOIN b USING (record_id)"
)
def keyed_diff(spark, sf_dir):
    """All outputs of two systems, held together by record."""
    return compare.keyed_diff(*_two_sides(spark, sf_dir, "anchored", "direct"), ["record_id"], ["raw_output", "classification"])


@query(
    "$scored, a AS (SELECT record_id, argument_f1 AS x FROM s WHERE system_id = 'anchored'), b AS (SELECT record_id, argument_f1 AS x FROM s WHERE system_id = 'direct') "
    "SELECT bool_and(a.x IS NOT NULL AND b.x IS NOT NULL) AS same_keys, count(*) AS n, max(abs(a.x - b.x)) AS argument_f1_max_delta, count(*) FILTER (abs(a.x - b.x) > greatest(0.1, 0.05 * greatest(abs(a.x), abs(b.x)))) AS argument_f1_outside FROM a FULL JOIN b USING (record_id)"
)
def tolerance_diff(spark, sf_dir):
    return compare.tolerance_diff(*_two_sides(spark, sf_dir, "anchored", "direct"), ["record_id"], {"argument_f1": (0.1, 0.05)})


@query(
    "$scored, r AS (SELECT grp, avg(semantic_decision) FILTER (system_id = 'anchored') AS left_rate, avg(semantic_decision) FILTER (system_id = 'direct') AS right_rate FROM s GROUP BY ALL) "
    "SELECT grp, round(left_rate, 6) AS left_rate, round(right_rate, 6) AS right_rate, round(abs(left_rate - right_rate), 6) AS delta, CASE WHEN left_rate > right_rate THEN 'left' WHEN left_rate < right_rate THEN 'right' ELSE 'shared' END AS better FROM r ORDER BY round(abs(left_rate - right_rate), 9) DESC, grp LIMIT 4"
)
def top_disagreements(spark, sf_dir):
    rows = gates.top_disagreements(scored(spark, sf_dir), "grp", "system_id", "semantic_decision", "anchored", "direct")
    return rows.select("grp", *(F.round(c, 6).alias(c) for c in ("left_rate", "right_rate", "delta")), "better")


@query(
    "$scored SELECT 'order:' || system_id || ':' || grp || ':semantic' AS evidence_id, grp AS surface, system_id AS system, '/' || grp || '/semantic' AS json_path, round(avg(semantic_decision), 6) AS value, sum(semantic_decision)::DOUBLE AS numerator, count(*)::DOUBLE AS denominator FROM s GROUP BY grp, system_id"
)
def evidence(spark, sf_dir):
    each = scored(spark, sf_dir, columns=["grp", "system_id", "semantic_decision"]).groupBy("grp", "system_id").agg(F.sum("semantic_decision").alias("a"), F.count(F.lit(1)).alias("b"))
    rows = claims.evidence_rows(each, F.col("grp"), F.col("system_id"), F.col("grp"), {"semantic": (F.try_divide("a", "b"), F.col("a"), F.col("b"))})
    return rows.select(F.concat(F.lit("order:"), "system", F.lit(":"), "surface", F.lit(":semantic")).alias("evidence_id"), "surface", "system", "json_path", F.round("value", 6).alias("value"), "numerator", "denominator")


@query("$scored SELECT record_id, e_decision AS decision, e_tool AS tool, e_args AS arguments, e_approval AS approval_required, e_policy AS policy_code, e_reason AS reason_code FROM s WHERE system_id = 'anchored'")
def refund_policy(spark, sf_dir):
    df = _side(spark, sf_dir, "anchored").withColumn("currency", F.lit("USD"))
    facts = {c: F.col(c) for c in ("requested_action", "requester_authorized", "action_authorized", "customer_id", "payment_id", "amount_minor", "currency", "payment_status", "payment_age_days", "duplicate_evidence", "fraud_indicator")}
    return df.select("record_id", policies.refund(facts).alias("_o")).select("record_id", "_o.*")


@query(
    "WITH f AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'cancel' WHEN 2 THEN 'pause' WHEN 3 THEN 'retention' ELSE 'cancel' END AS act, c_acctbal >= 0.0 AS auth, c_custkey % 7 <> 0 AS allowed, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'S' || c_custkey END AS sub, c_custkey % 3 <> 0 AS conf, c_custkey % 13 = 0 AS locked, CAST(floor(c_acctbal * 2) AS BIGINT) AS bal, CASE WHEN c_custkey % 2 = 0 THEN 'immediate' ELSE 'period_end' END AS mode, 30 * (1 + c_custkey % 3) AS days, c_custkey % 4 <> 0 AS pausable, c_custkey % 6 <> 0 AS keepable FROM customer), "
    "o AS (SELECT *, CASE WHEN NOT auth THEN 'refuse|SUB-AUTH-01|REQUESTER_NOT_AUTHORIZED|' WHEN act <> 'none' AND sub IS NULL THEN 'ask_clarification|SUB-CONFIRM-01|CANCELLATION_CONFIRMATION_REQUIRED|' WHEN act = 'cancel' AND NOT (conf AND allowed) THEN 'ask_clarification|SUB-CONFIRM-01|CANCELLATION_CONFIRMATION_REQUIRED|' "
    "WHEN act = 'cancel' AND (locked OR bal > 10000) THEN 'request_approval|SUB-CANCEL-02|CONTRACT_REVIEW_REQUIRED|cancel_subscription' WHEN act = 'cancel' THEN 'execute|SUB-CANCEL-01|CANCELLATION_CONFIRMED|cancel_subscription' WHEN act = 'pause' AND pausable AND allowed THEN 'execute|SUB-PAUSE-01|PAUSE_ELIGIBLE|pause_subscription' WHEN act = 'pause' THEN 'refuse|SUB-PAUSE-02|PAUSE_INELIGIBLE|' "
    "WHEN act = 'retention' AND keepable AND allowed THEN 'execute|SUB-RETENTION-01|RETENTION_OFFER_ELIGIBLE|offer_retention' WHEN act = 'retention' THEN 'refuse|SUB-RETENTION-02|RETENTION_OFFER_INELIGIBLE|' ELSE 'no_action|SUB-NOACT-01|NO_SUBSCRIPTION_ACTION_REQUESTED|' END AS o FROM f) "
    "SELECT c_custkey, split_part(o, '|', 1) AS decision, nullif(split_part(o, '|', 4), '') AS tool, CASE split_part(o, '|', 4) WHEN '' THEN '{}' WHEN 'cancel_subscription' THEN '{\"effective_mode\":\"' || mode || '\",\"subscription_id\":\"' || sub || '\"}' WHEN 'pause_subscription' THEN '{\"pause_days\":' || days || ',\"subscription_id\":\"' || sub || '\"}' ELSE '{\"offer_code\":\"SAVE10_3MO\",\"subscription_id\":\"' || sub || '\"}' END AS arguments, "
    "split_part(o, '|', 1) = 'request_approval' AS approval_required, split_part(o, '|', 2) AS policy_code, split_part(o, '|', 3) AS reason_code FROM o"
)
def subscription_policy(spark, sf_dir):
    k = F.col("c_custkey")
    action = F.when(k % 5 == 0, "none").when(k % 5 == 2, "pause").when(k % 5 == 3, "retention").otherwise("cancel")
    facts = {
        "requested_action": action, "requester_authorized": F.col("c_acctbal") >= 0.0, "action_authorized": k % 7 != 0, "subscription_id": F.when(k % 11 != 0, F.concat(F.lit("S"), k.cast("string"))), "cancellation_confirmed": k % 3 != 0, "contract_locked": k % 13 == 0,
        "balance_minor": F.floor(F.col("c_acctbal") * 2), "effective_mode": F.when(k % 2 == 0, "immediate").otherwise("period_end"), "pause_days": 30 * (1 + k % 3), "pause_eligible": k % 4 != 0, "retention_eligible": k % 6 != 0,
    }
    return _t(spark, sf_dir, "customer").select("c_custkey", policies.subscription(facts).alias("_o")).select("c_custkey", "_o.*")


# --- Rankings ------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_size >= p.p_size AND q.p_retailprice <= p.p_retailprice AND (q.p_size > p.p_size OR q.p_retailprice < p.p_retailprice))")
def pareto_front(spark, sf_dir):
    return gates.pareto_front(_t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_partkey", ["p_size"], ["p_retailprice"])


_SYSTEMS_SQL = (
    "e AS (SELECT 'nation' || s_nationkey AS system_id, count(*) FILTER (l_quantity < 40)::DOUBLE / count(*) AS confirmatory_semantic, count(*) FILTER (l_quantity < 49)::DOUBLE / count(*) AS confirmatory_strict, count(*) FILTER (l_discount < 0.05)::DOUBLE / count(*) AS adversarial_semantic, count(*) FILTER (l_discount < 0.08)::DOUBLE / count(*) AS adversarial_strict, count(*) FILTER (l_tax < 0.05)::DOUBLE / count(*) AS adversarial_argument_f1, "
    "count(*) FILTER (l_returnflag = 'R') AS adversarial_safety_failures, s_nationkey % 4 * 100 AS direct_original_labels, s_nationkey % 3 AS complexity_rank, s_nationkey % 2 = 0 AS source_teacher_required, CAST(s_nationkey % 7 = 0 AS INT) AS confirmatory_unauthorized_actions, 0 AS confirmatory_approval_bypasses FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey)"
)


def _systems(spark, sf_dir):
    share = lambda c: (F.count_if(c) / F.count(F.lit(1)))
    li = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag").join(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    k = F.col("s_nationkey")
    return li.groupBy("s_nationkey").agg(
        share(F.col("l_quantity") < 40).alias("confirmatory_semantic"), share(F.col("l_quantity") < 49).alias("confirmatory_strict"), share(F.col("l_discount") < 0.05).alias("adversarial_semantic"), share(F.col("l_discount") < 0.08).alias("adversarial_strict"), share(F.col("l_tax") < 0.05).alias("adversarial_argument_f1"), F.count_if(F.col("l_returnflag") == "R").alias("adversarial_safety_failures")
    ).withColumns({"system_id": F.concat(F.lit("nation"), k.cast("string")), "direct_original_labels": k % 4 * 100, "complexity_rank": k % 3, "source_teacher_required": k % 2 == 0, "confirmatory_unauthorized_actions": (k % 7 == 0).cast("int"), "confirmatory_approval_bypasses": F.lit(0)}).drop("s_nationkey")


_BETTER = " OR ".join([f"b.{c} > a.{c}" for c in gates.LARGER] + [f"b.{c} < a.{c}" for c in gates.SMALLER])
_NO_WORSE = " AND ".join([f"b.{c} >= a.{c}" for c in gates.LARGER] + [f"b.{c} <= a.{c}" for c in gates.SMALLER])


@query(f"WITH {_SYSTEMS_SQL} SELECT system_id, coalesce((SELECT string_agg(b.system_id, ',' ORDER BY b.system_id) FROM e b WHERE {_NO_WORSE} AND ({_BETTER})), '') AS dominated_by FROM e a")
def dominated_systems(spark, sf_dir):
    return gates.dominated_by(_systems(spark, sf_dir)).select("system_id", F.array_join("dominated_by", ",").alias("dominated_by"))


def _ranking_sql(profile: str) -> str:
    demand, order = gates.PROFILES[profile]
    keys = ", ".join(f"{c[1:]} DESC" if c[0] == "-" else c for c in order)
    return f"SELECT '{profile}' AS profile, string_agg(system_id, ',' ORDER BY {keys}, system_id) AS ranking FROM v WHERE {demand or 'true'}"


@query(f"WITH {_SYSTEMS_SQL}, v AS (SELECT * FROM e WHERE confirmatory_strict >= 0.9 AND confirmatory_unauthorized_actions = 0 AND confirmatory_approval_bypasses = 0), r AS ({' UNION ALL '.join(map(_ranking_sql, gates.PROFILES))}) SELECT profile, coalesce(ranking, '') AS ranking, coalesce(split_part(ranking, ',', 1), 'NO_VIABLE_TRAINED_MIGRATION') AS recommendation FROM r")
def profile_ranking(spark, sf_dir):
    systems = _systems(spark, sf_dir)
    rows = gates.recommendations(systems.select("*", *gates.viability(0.9)))
    return rows.select("profile", F.array_join("ranking", ",").alias("ranking"), "recommendation")


@query(
    "WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, count(*) FILTER (l_returnflag = 'A') AS returned FROM lineitem GROUP BY ALL) "
    "SELECT l_suppkey, l_linenumber, n, quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY returned DESC, quantity DESC, l_linenumber) AS r FROM c WHERE n >= 5) WHERE r = 1"
)
def checkpoint_argmax(spark, sf_dir):
    c = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.count_if(F.col("l_returnflag") == "A").alias("returned"))
    return select.arg_max(c, ["l_suppkey"], [F.col("returned"), F.col("quantity")], F.col("n") >= 5, "l_linenumber").select("l_suppkey", "l_linenumber", "n", "quantity")


# --- Selections ----------------------------------------------------------------------------------

_HASH = "sha256('pick:' || doc_id)"


@query(f"SELECT doc_id, lang, source, rank FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {_HASH}, doc_id)::INT AS rank FROM documents) WHERE rank <= 3")
def hash_quota_sample(spark, sf_dir):
    return select.quota(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", "pick", 3)


_HAVE = "h AS (SELECT lang, source, count(*) AS available FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY ALL), d AS (SELECT g.lang, g.source, coalesce(available, 0) AS available, greatest(8 - coalesce(available, 0), 0) AS deficit FROM (SELECT DISTINCT lang, source FROM documents) g LEFT JOIN h ON g.lang = h.lang AND g.source = h.source)"


def _lacking(spark, sf_dir):
    docs, good = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), _t(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return docs, select.deficits(docs.join(good, "doc_id"), docs, ["lang", "source"], 8)


@query(f"WITH {_HAVE} SELECT * FROM d")
def quota_deficits(spark, sf_dir):
    return _lacking(spark, sf_dir)[1]


@query(f"WITH {_HAVE}, p AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('anchor:' || doc_id), doc_id)::INT AS rank FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT doc_id, lang, source, rank FROM p JOIN d USING (lang, source) WHERE rank <= deficit")
def anchor_fill(spark, sf_dir):
    docs, lacking = _lacking(spark, sf_dir)
    pool = docs.join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return select.fill(pool, lacking, ["lang", "source"], "doc_id", "anchor").select("doc_id", "lang", "source", "rank")


@query(f"SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_HASH}, doc_id)::INT AS rank FROM documents) WHERE rank <= 14 AND (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) >= 14")
def all_or_nothing_quota(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    return select.all_or_nothing(docs, ["lang"], "doc_id", "pick", 14, docs)


@query(f"SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {_HASH}, doc_id) AS r FROM documents) WHERE r = 1")
def min_hash_representative(spark, sf_dir):
    return select.representative(_t(spark, sf_dir, "documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id", "pick")


_QUOTA = (
    "w AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), f AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM w), g AS (SELECT *, (32 * n) // total AS fl, (32 * n) % total AS rest FROM f), "
    "h AS (SELECT *, 32 - sum(fl) OVER (PARTITION BY lang) AS remaining, row_number() OVER (PARTITION BY lang ORDER BY rest DESC, sha256('share:' || lang || ':' || source), source) AS k FROM g), q AS (SELECT lang, source, n, CAST(fl + CASE WHEN k <= remaining THEN 1 ELSE 0 END AS BIGINT) AS quota FROM h)"
)


def _apportioned(spark, sf_dir):
    return select.apportion(_t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), ["lang"], "n", 32, "share", "source")


@query(f"WITH {_QUOTA} SELECT * FROM q")
def hamilton_quota(spark, sf_dir):
    return _apportioned(spark, sf_dir)


@query(f"WITH {_QUOTA}, e AS (SELECT lang, source, unnest(range(quota))::INT AS slot FROM q WHERE quota > 0), d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang, source) AS c FROM documents) SELECT e.lang, e.source, slot, doc_id FROM e JOIN d ON e.lang = d.lang AND e.source = d.source AND d.i = e.slot % d.c")
def cycled_slots(spark, sf_dir):
    key = F.concat_ws("|", "lang", "source").alias("stratum")
    slots = select.expanded(_apportioned(spark, sf_dir)).select("lang", "source", key, "slot")
    docs = _t(spark, sf_dir, "documents").select(key, "doc_id")
    return select.cycled(slots, docs, "stratum", "doc_id").select("lang", "source", "slot", "doc_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value > 50 DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def terminal_attempt(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return select.terminal_attempt(ev, ["user_id", "event_type"], F.col("value") > 50, ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id, CAST(('0x' || substr(sha256('20260714:' || lang || ':' || source || ':' || doc_id), 1, 15)) AS BIGINT) % 61 + 30 AS drawn FROM documents")
def bucket_draws(spark, sf_dir):
    key = F.concat_ws(":", F.lit("20260714"), "lang", "source", F.col("doc_id").cast("string"))
    return _t(spark, sf_dir, "documents").select("doc_id", bucket_draw(key, F.lit(30), F.lit(90)).alias("drawn"))


# --- Leakage, duplicates, integrity --------------------------------------------------------------

#: Words of a passage that is a key of its own.
_PASSAGE = 10


def _keys_sql() -> str:
    """Three classes of keys of four corpora: the text's digest, that of its words alone (lower case,
    without marks and white space), and those of all passages of words."""
    corpora = {"benchmark": ("CAST(item_id AS VARCHAR)", "text", "benchmark"), "conversations": ("CAST(conv_id * 1000 + turn AS VARCHAR)", "text", "conversations"), "documents": ("CAST(doc_id AS VARCHAR)", "text", "documents"), "pages": ("CAST(page_id AS VARCHAR)", "html", "pages")}
    texts = " UNION ALL ".join(f"SELECT '{c}' AS corpus, {i} AS record_id, {t} AS text FROM {f}" for c, (i, t, f) in corpora.items())
    return (
        f"t AS ({texts}), u AS (SELECT corpus, record_id, text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM t WHERE text IS NOT NULL), "
        "k AS (SELECT corpus, record_id, 'content' AS key_class, sha256(text) AS key FROM u UNION ALL SELECT corpus, record_id, 'signature', sha256(array_to_string(ws, ' ')) FROM u "
        f"UNION ALL SELECT DISTINCT corpus, record_id, 'passage', sha256(array_to_string(ws[i:i + {_PASSAGE - 1}], ' ')) FROM (SELECT corpus, record_id, ws, unnest(range(1, len(ws) - {_PASSAGE - 2})) AS i FROM u WHERE len(ws) >= {_PASSAGE}))"
    )


_KEYS = _keys_sql()


def _words():
    return F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")


def _corpora(spark, sf_dir):
    corpora = {"benchmark": ("benchmark", F.col("item_id"), "text"), "conversations": ("conversations", F.col("conv_id") * 1000 + F.col("turn"), "text"), "documents": ("documents", F.col("doc_id"), "text"), "pages": ("pages", F.col("page_id"), "html")}
    return leakage.union([_t(spark, sf_dir, t).select(F.lit(c).alias("corpus"), i.cast("string").alias("record_id"), F.col(x).cast("string").alias("text")) for c, (t, i, x) in corpora.items()])


@query(f"WITH {_KEYS}, o AS (SELECT key_class, key, min(corpus) AS owner_corpus FROM k GROUP BY ALL HAVING min(corpus) <> max(corpus)), w AS (SELECT key_class, key, owner_corpus, max(record_id) AS owner_id FROM o JOIN k USING (key_class, key) WHERE corpus = owner_corpus GROUP BY ALL) SELECT key_class, key, owner_corpus, owner_id, corpus, record_id FROM w JOIN k USING (key_class, key) WHERE corpus <> owner_corpus")
def corpus_collisions(spark, sf_dir):
    return leakage.text_collisions(_corpora(spark, sf_dir), _PASSAGE)


@query(f"WITH {_KEYS}, d AS (SELECT DISTINCT key_class, key, corpus FROM k) SELECT a.key_class, a.corpus AS left_corpus, b.corpus AS right_corpus, count(*) AS n_keys FROM d a JOIN d b ON a.key_class = b.key_class AND a.key = b.key AND a.corpus < b.corpus GROUP BY ALL")
def collision_counts(spark, sf_dir):
    return leakage.text_collision_counts(_corpora(spark, sf_dir), _PASSAGE)


@query(f"WITH {_KEYS}, c AS (SELECT key_class, key, count(*) AS n FROM k WHERE corpus = 'documents' GROUP BY ALL), x AS (SELECT DISTINCT key_class, key FROM k WHERE corpus <> 'documents') SELECT key_class, count(*) FILTER (x.key IS NOT NULL) AS n_excluded, count(*) FILTER (n > 1) AS n_repeated, count(*) AS n_keys FROM c LEFT JOIN x USING (key_class, key) GROUP BY ALL")
def leakage_audit(spark, sf_dir):
    return leakage.text_leakage_audit(_corpora(spark, sf_dir), "documents", _PASSAGE)


@query(f"WITH {_KEYS} SELECT doc_id FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT a.record_id FROM k a WHERE corpus = 'documents' AND EXISTS (SELECT 1 FROM k b WHERE b.corpus <> 'documents' AND a.key_class = b.key_class AND a.key = b.key))")
def without_collisions(spark, sf_dir):
    return leakage.without_text_collisions(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", _corpora(spark, sf_dir), "documents", _PASSAGE)


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS least_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return leakage.duplicates(_t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), ["digest"], "doc_id")


@query(
    "WITH a AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT doc_id, count(*) AS m FROM labels GROUP BY ALL), j AS (SELECT n, m FROM a FULL JOIN b USING (doc_id)) "
    "SELECT 'LEFT_DUPLICATE' AS finding, count(*) FILTER (n > 1) AS n FROM j UNION ALL SELECT 'RIGHT_DUPLICATE', count(*) FILTER (m > 1) FROM j UNION ALL SELECT 'MISSING_RIGHT', count(*) FILTER (m IS NULL) FROM j UNION ALL SELECT 'MISSING_LEFT', count(*) FILTER (n IS NULL) FROM j UNION ALL SELECT 'MATCHED', count(*) FILTER (n = 1 AND m = 1) FROM j"
)
def label_integrity(spark, sf_dir):
    return leakage.integrity(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query(
    "WITH r AS (SELECT sha256(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus) AS h FROM orders), p AS (SELECT count(*) AS n_rows, " + ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {15 * i + 1}, 15)) AS BIGINT)) AS VARCHAR) AS p{i}" for i in range(4)) + " FROM r) SELECT n_rows, sha256(p0 || ':' || p1 || ':' || p2 || ':' || p3) AS digest FROM p"
)
def orders_digest(spark, sf_dir):
    return table_digest(_t(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus"])


@query("SELECT o_orderkey, CAST(('0x' || substr(sha256('7:' || o_custkey || ':' || o_orderkey), 1, 16)) AS UBIGINT)::DECIMAL(20,0) AS seed FROM orders")
def order_seeds(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", seed("7", F.col("o_custkey"), F.col("o_orderkey")).alias("seed"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256(unhex(sha256(lang)) || unhex(sha256(source)) || CAST('candidate' || doc_id AS BLOB)), 1, 8)) AS BIGINT) AS seed FROM documents")
def candidate_seeds(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", seed32([F.sha2("lang", 256), F.sha2("source", 256)], "candidate", F.col("doc_id")).alias("seed"))


@query("SELECT o_orderkey, sha256(unhex(printf('%016X', o_orderkey) || printf('%016X', o_custkey))) AS digest FROM orders")
def int_list_digests(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", int_list_digest(F.array("o_orderkey", "o_custkey")).alias("digest"))


# --- Distributions -------------------------------------------------------------------------------

_BUCKETS = [("low", 0, 99_999), ("middle", 100_000, 299_999), ("high", 300_000, 10_000_000)]
_BUCKET_SQL = "CASE WHEN v BETWEEN 0 AND 99999 THEN 'low' WHEN v BETWEEN 100000 AND 299999 THEN 'middle' WHEN v BETWEEN 300000 AND 10000000 THEN 'high' END"
_STRATA = f"t AS (SELECT o_orderstatus, {_BUCKET_SQL} AS bucket, o_orderpriority FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)), st AS (SELECT o_orderstatus, bucket, o_orderpriority, count(*) AS n FROM t GROUP BY ALL)"


def _order_strata(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderstatus", distribution.bucket(F.floor("o_totalprice"), _BUCKETS).alias("bucket"), "o_orderpriority")
    return distribution.strata(rows, ["o_orderstatus", "bucket", "o_orderpriority"])


@query(f"WITH {_STRATA} SELECT *, sha256(o_orderstatus || '|' || coalesce(bucket, 'null') || '|' || o_orderpriority) AS stratum FROM st")
def bucket_strata(spark, sf_dir):
    return _order_strata(spark, sf_dir)


@query(f"WITH {_STRATA} SELECT dimension, value, sum(n)::BIGINT AS n FROM (SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, n FROM st UNION ALL SELECT 'bucket', bucket, n FROM st UNION ALL SELECT 'o_orderpriority', o_orderpriority, n FROM st) GROUP BY ALL")
def marginals(spark, sf_dir):
    return distribution.marginals(_order_strata(spark, sf_dir), ["o_orderstatus", "bucket", "o_orderpriority"])


@query("SELECT o_orderstatus, count(*) FILTER (o_totalprice < 5000) AS below, count(*) FILTER (o_totalprice BETWEEN 5000 AND 6000) AS near_limit, count(*) FILTER (o_totalprice > 400000) AS above FROM orders GROUP BY ALL")
def boundary_coverage(spark, sf_dir):
    p = F.col("o_totalprice")
    return distribution.range_counts(_t(spark, sf_dir, "orders"), ["o_orderstatus"], {"below": p < 5000, "near_limit": p.between(5000, 6000), "above": p > 400000})


@query("SELECT * FROM (SELECT l_orderkey, 'l_linenumber' AS field, CAST(l_linenumber AS BIGINT) AS value FROM lineitem UNION ALL SELECT l_orderkey, 'l_suppkey', l_suppkey FROM lineitem) WHERE value IN (7, 50)")
def support_violations(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey")
    return distribution.support_violations(li, "l_orderkey", ["l_linenumber", "l_suppkey"], [7, 50])


@query("WITH a AS (SELECT lang, source, count(*) AS left_n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL), b AS (SELECT lang, source, count(*) AS right_n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL) SELECT lang, source, coalesce(left_n, 0) AS left_n, coalesce(right_n, 0) AS right_n FROM a FULL JOIN b USING (lang, source) WHERE coalesce(left_n, 0) <> coalesce(right_n, 0)")
def distribution_audit(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), _t(spark, sf_dir, "labels").select("doc_id")
    return distribution.audit(docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti"), ["lang", "source"])


@query("WITH f AS (SELECT lang, source, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS t FROM documents) SELECT lang, source, count(*) FILTER (t) AS n_with, count(*) FILTER (NOT t) AS n_without, round(count(*) FILTER (t)::DOUBLE / (SELECT count(*) FROM f WHERE t), 9) AS share_with, round(count(*) FILTER (NOT t)::DOUBLE / (SELECT count(*) FROM f WHERE NOT t), 9) AS share_without FROM f GROUP BY ALL")
def share_audit(spark, sf_dir):
    toxic = _t(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("_t"))
    rows = distribution.share_audit(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(toxic, "doc_id", "left"), F.col("_t"), ["lang", "source"])
    return rows.withColumns({c: F.round(c, 9) for c in ("share_with", "share_without")})


# --- Schedules -----------------------------------------------------------------------------------

_BUDGET, _PER_STEP = 400_000, 8


def _scheduled(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return schedule.greedy(docs, "doc_id", "n_chars", _BUDGET, 7, "schedule", _PER_STEP)


_SCHEDULE_SQL = """
WITH RECURSIVE d AS (SELECT CAST(doc_id AS VARCHAR) AS id, n_chars AS n FROM documents),
st(c, pick, room) AS (
  SELECT 0::BIGINT, p, {budget} - p.n FROM (SELECT min({{'cycle': 0, 'k': sha256('7:schedule:0:' || id) || id, 'id': id, 'n': n}}) AS p FROM d WHERE n <= {budget}) WHERE p IS NOT NULL
  UNION ALL
  SELECT c + 1, p, room - p.n FROM (
    SELECT s.c, s.room, min({{'cycle': s.pick.cycle + g, 'k': sha256('7:schedule:' || (s.pick.cycle + g) || ':' || id) || id, 'id': id, 'n': n}}) AS p
    FROM st s, d, (VALUES (0), (1)) v(g)
    WHERE n <= s.room AND ((g = 1 AND s.room > 0) OR (g = 0 AND sha256('7:schedule:' || s.pick.cycle || ':' || id) || id > s.pick.k)) GROUP BY s.c, s.room
  ) WHERE p IS NOT NULL
), i AS (SELECT c AS cursor, pick.id AS record_id, pick.n AS sequence_tokens, pick.cycle AS cycle, c // {per} AS accumulation_group, c // {per} + 1 AS optimizer_step FROM st)
""".format(budget=_BUDGET, per=_PER_STEP)


@query(_SCHEDULE_SQL + "SELECT * FROM i")
def greedy_schedule(spark, sf_dir):
    return _scheduled(spark, sf_dir)


@query(
    _SCHEDULE_SQL + f", t AS (SELECT count(*) AS n_items, coalesce(sum(sequence_tokens), 0)::BIGINT AS processed_tokens, coalesce(max(optimizer_step), 0)::BIGINT AS optimizer_steps FROM i) "
    f"SELECT n_items, processed_tokens, {_BUDGET} - processed_tokens AS residual_tokens, optimizer_steps, ceil(optimizer_steps * 0.05)::BIGINT AS warmup_steps, list_sort(list_distinct([greatest(1, least(optimizer_steps, ceil(optimizer_steps * 0.5)::BIGINT)), greatest(1, optimizer_steps)])) AS checkpoint_steps FROM t"
)
def schedule_totals(spark, sf_dir):
    return schedule.totals(_scheduled(spark, sf_dir), _BUDGET)


# --- JSON and text -------------------------------------------------------------------------------


@query("SELECT event_id, '/k' AS path, CAST(value AS BIGINT)::VARCHAR AS value, json_extract(props, '$.k')::VARCHAR AS actual FROM events WHERE CAST(value AS BIGINT)::VARCHAR IS DISTINCT FROM json_extract(props, '$.k')::VARCHAR".replace("CAST(value AS BIGINT)", "CAST(floor(value) AS BIGINT)"))
def subset_diff(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    wanted = ev.select("event_id", F.concat(F.lit('{"k": '), F.floor("value").cast("string"), F.lit("}")).alias("j"))
    return compare.subset_diff(compare.leaves(wanted, "event_id", "j"), compare.leaves(ev.select("event_id", "props"), "event_id", "props"), "event_id")


@query("SELECT event_type, json_extract(props, '$.k')::BIGINT BETWEEN 10 AND 80 AS valid, count(*) AS n FROM events GROUP BY ALL")
def schema_validation(spark, sf_dir):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80}}, "additionalProperties": False}
    return _t(spark, sf_dir, "events").groupBy("event_type", valid(F.try_parse_json("props"), schema).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, '{\"k\":' || json_extract(props, '$.k')::VARCHAR || '}' AS canonical, sha256('{\"k\":' || json_extract(props, '$.k')::VARCHAR || '}') AS sha256 FROM events")
def canonical_digests(spark, sf_dir):
    c = canonical_text(F.col("props"))
    return _t(spark, sf_dir, "events").select("event_id", c.alias("canonical"), F.sha2(c, 256).alias("sha256"))


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text || ' ' || source), 'license') AND lang IN ('en', 'de')")
def facet_search(spark, sf_dir):
    return claims.search(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), ["text", "source"], "License", lang=["en", "de"]).select("doc_id", "lang", "source")


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn), '>') AS roles, count(*) AS turns FROM conversations GROUP BY ALL")
def message_lists(spark, sf_dir):
    m = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(m["role"], ">").alias("roles"), F.count(F.lit(1)).alias("turns"))


@query(
    "$scored, e AS (SELECT system_id AS evidence_id, count(*) AS d, sum(semantic_decision) AS a FROM s GROUP BY ALL) "
    "SELECT 'claim-' || evidence_id AS claim_id, '' AS unknown_evidence, '9.99' AS unsupported_numbers, evidence_id = 'direct' AS causal FROM e UNION ALL SELECT 'stray', 'nobody', '', false"
)
def claim_check(spark, sf_dir):
    e = scored(spark, sf_dir, columns=["system_id", "semantic_decision"]).groupBy(F.col("system_id").alias("evidence_id")).agg(F.sum("semantic_decision").cast("double").alias("numerator"), F.count(F.lit(1)).cast("double").alias("denominator")).withColumn("value", F.col("numerator") / F.col("denominator"))
    because = F.when(F.col("evidence_id") == "direct", " because it was cheap").otherwise("")
    text = F.concat(F.lit("It had "), F.col("numerator").cast("long").cast("string"), F.lit(" of "), F.col("denominator").cast("long").cast("string"), F.lit(" right, not 9.99"), because)
    said = e.select(F.concat(F.lit("claim-"), "evidence_id").alias("claim_id"), text.alias("text"), F.array("evidence_id").alias("evidence_ids"))
    stray = spark.createDataFrame([("stray", "No numbers.", ["nobody"])], said.schema)
    out = claims.check_claims(said.unionByName(stray), e)
    return out.select("claim_id", F.array_join("unknown_evidence", ",").alias("unknown_evidence"), F.array_join("unsupported_numbers", ",").alias("unsupported_numbers"), "causal")


@query(
    "$scored, m AS (SELECT system_id, avg(argument_f1) AS f1, avg(strict_contract) AS strict FROM s GROUP BY ALL) SELECT a.system_id, round(a.f1, 6) AS f1, round(a.strict, 6) AS strict, round(a.f1 / b.f1, 6) AS f1_retention, round(a.strict / b.strict, 6) AS strict_retention FROM m a, m b WHERE b.system_id = 'untouched'"
)
def retention(spark, sf_dir):
    m = scored(spark, sf_dir, columns=["system_id", "argument_f1", "strict_contract"]).groupBy("system_id").agg(F.avg("argument_f1").alias("f1"), F.avg("strict_contract").alias("strict"))
    rows = compare.retention(m, m.where("system_id = 'untouched'"), "system_id", ["f1", "strict"])
    return rows.select("system_id", *(F.round(c, 6).alias(c) for c in rows.columns[1:]))


@query("$scored, a AS (SELECT grp, sum(semantic_decision) AS v FROM s WHERE system_id = 'anchored' GROUP BY ALL), b AS (SELECT grp, sum(semantic_decision) AS v FROM s WHERE system_id = 'direct' GROUP BY ALL) SELECT grp, (coalesce(a.v, 0) - coalesce(b.v, 0))::BIGINT AS delta FROM a FULL JOIN b USING (grp)")
def metric_delta(spark, sf_dir):
    left, right = (df.groupBy("grp").agg(F.sum("semantic_decision").alias("v")) for df in _two_sides(spark, sf_dir, "anchored", "direct"))
    return compare.delta_table(left, right, "grp", "v")


@query("WITH c AS (SELECT user_id, CASE WHEN event_type = 'error' AND value > 90 THEN 'FAIL' WHEN event_type = 'error' THEN 'WARN' ELSE 'PASS' END AS status, value > 95 AS blocking FROM events) SELECT user_id, CASE WHEN bool_or(blocking AND status = 'FAIL') THEN 'FAIL' WHEN bool_or(status <> 'PASS') THEN 'WARN' ELSE 'PASS' END AS status, count(*) AS n_checks FROM c GROUP BY ALL")
def status_rollup(spark, sf_dir):
    bad = F.col("event_type") == "error"
    checks = _t(spark, sf_dir, "events").select("user_id", F.when(bad & (F.col("value") > 90), "FAIL").when(bad, "WARN").otherwise("PASS").alias("status"), (F.col("value") > 95).alias("blocking"))
    return gates.status_rollup(checks, ["user_id"])
