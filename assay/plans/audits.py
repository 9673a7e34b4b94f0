"""More of the catalogue: policies replayed on stored rows, and audits that bar a surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policies
from ..operators import distribution, leakage, residuals
from . import routing
from .catalogue import _t, query

_CONTRACT = ["decision", "tool", "arguments", "approval_required", "policy_code", "reason_code"]


def _stored_contracts(spark, sf_dir):
    """Requests with the contract stored for each, some tampered with, and the one that the policy gives."""
    df = routing.predictions(spark, sf_dir).where("system_id = 'anchored'").withColumn("currency", F.lit("USD"))
    k = F.col("o_orderkey")
    facts = {c: F.col(c) for c in ("requested_action", "requester_authorized", "action_authorized", "customer_id", "payment_id", "amount_minor", "currency", "payment_status", "payment_age_days", "duplicate_evidence", "fraud_indicator")}
    stored = F.struct(
        F.when(k % 131 == 3, "refuse").otherwise(F.col("e_decision")).alias("decision"), F.col("e_tool").alias("tool"), F.col("e_args").alias("arguments"), F.col("e_approval").alias("approval_required"), F.col("e_policy").alias("policy_code"),
        F.when(k % 173 == 5, "OTHER").otherwise(F.col("e_reason")).alias("reason_code"),
    )
    return df.select("record_id", "customer_id", "amount_minor", stored.alias("stored"), policies.refund(facts).alias("given"))


_DIFFERING = "list_filter([CASE WHEN o_orderkey % 131 = 3 AND e_decision <> 'refuse' THEN 'decision' END, CASE WHEN o_orderkey % 173 = 5 THEN 'reason_code' END], lambda x: x IS NOT NULL)"


@query(f"WITH {routing.DUCKDB}, d AS (SELECT record_id, {_DIFFERING} AS f FROM p WHERE system_id = 'anchored') SELECT record_id, array_to_string(f, ',') AS differing FROM d WHERE len(f) > 0")
def policy_replay(spark, sf_dir):
    """Every stored contract held against the one that the policy gives again from the facts."""
    rows = residuals.policy_replay(_stored_contracts(spark, sf_dir), ["record_id"], F.col("stored"), F.col("given"), _CONTRACT)
    return rows.withColumn("differing", F.array_join("differing", ","))


@query(
    f"WITH {routing.DUCKDB}, d AS (SELECT *, len({_DIFFERING}) AS f FROM p WHERE system_id = 'anchored') "
    "SELECT count(*) AS n_rows, count(*) - count(DISTINCT record_id) AS repeated_id, count(*) - count(DISTINCT customer_id || ':' || amount_minor) AS repeated_facts, count(*) FILTER (f > 0) AS n_not_replayed FROM d"
)
def example_audit(spark, sf_dir):
    """Rows, identities that repeat, and contracts that the policy does not give, in one aggregation."""
    rows = _stored_contracts(spark, sf_dir)
    facts = F.concat("customer_id", F.lit(":"), F.col("amount_minor").cast("string"))
    return residuals.dataset_audit(rows, {"id": F.col("record_id"), "facts": facts}, {"n_not_replayed": F.size(residuals.contract_differences(F.col("stored"), F.col("given"), _CONTRACT)) > 0})


_MINIMUMS = {"short": 20, "near_limit": 10, "long": 5}


@query(
    "WITH c AS (SELECT t.* FROM documents, LATERAL (VALUES ('content', sha256(text)), ('signature', sha256(lower(text)))) t(key_class, key) WHERE t.key IS NOT NULL), x AS (SELECT DISTINCT t.* FROM benchmark, LATERAL (VALUES ('content', sha256(text)), ('signature', sha256(lower(text)))) t(key_class, key)), "
    "g AS (SELECT key_class, key, count(*) AS n FROM c GROUP BY ALL), a AS (SELECT g.key_class, count(*) FILTER (x.key IS NOT NULL) AS e, count(*) FILTER (n > 1) AS r FROM g LEFT JOIN x ON g.key_class = x.key_class AND g.key = x.key GROUP BY ALL), "
    "b AS (SELECT lang, count(*) FILTER (n_chars < 300) AS short, count(*) FILTER (n_chars BETWEEN 1900 AND 2100) AS near_limit, count(*) FILTER (n_chars > 5000) AS long FROM documents GROUP BY ALL), "
    "l AS (SELECT lang, t.* FROM b, LATERAL (VALUES ('short', short, 20), ('near_limit', near_limit, 10), ('long', long, 5)) t(name, n, least)) "
    "SELECT 'COLLISION' AS finding, key_class AS detail, e AS n FROM a WHERE e > 0 UNION ALL SELECT 'REPETITION', key_class, r FROM a WHERE r > 0 UNION ALL SELECT 'BOUNDARY_BELOW_MINIMUM', lang || '|' || name, n FROM l WHERE n < least"
)
def surface_audit(spark, sf_dir):
    """What bars the documents as a surface: keys that the benchmark has, keys that repeat, lengths that few have."""
    docs, n = _t(spark, sf_dir, "documents"), F.col("n_chars")
    keys = lambda t, id_: leakage.long_keys(_t(spark, sf_dir, t), t, id_, {"content": F.sha2("text", 256), "signature": F.sha2(F.lower("text"), 256)})
    coverage = distribution.range_counts(docs, ["lang"], {"short": n < 300, "near_limit": n.between(1900, 2100), "long": n > 5000})
    return leakage.audit_findings(leakage.leakage_audit(keys("documents", "doc_id"), keys("benchmark", "item_id")), coverage, ["lang"], _MINIMUMS)
