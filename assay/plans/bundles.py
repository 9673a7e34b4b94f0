"""More of the catalogue: packs from folders, constructed records, gates over runs, mutations."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions.hashing import group_digests
from ..operators import claims, compare, gates, quotas, records, select, summarize, zipped
from ..sources import pack
from ..sources.shared import shared_dir
from .catalogue import _systems, _SYSTEMS_SQL, _t, query
from .scored import scored

# --- Records and packs ---------------------------------------------------------------------------

_PAYLOAD = "'{\"customer\":' || o_custkey || ',\"status\":\"' || o_orderstatus || '\"}'"
_ANSWER = "'{\"d\":\"' || CASE WHEN o_orderkey % 23 = 0 THEN 'maybe' WHEN o_totalprice > 150000 THEN 'yes' ELSE 'no' END || '\"}'"


def _inputs(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    payload = F.concat(F.lit('{"status": "'), "o_orderstatus", F.lit('", "customer": '), F.col("o_custkey").cast("string"), F.lit("}"))
    surface = F.element_at(F.array(*map(F.lit, pack.SURFACES)), (k % 5 + 1).cast("int"))
    signature = F.sha2(F.concat_ws("|", "o_orderstatus", F.col("o_custkey").cast("string")), 256)
    inputs = records.input_records(orders, F.concat(F.lit("order-"), k.cast("string")), surface, F.col("o_orderstatus"), payload, {"group": F.col("o_orderstatus")}, signature)
    answer = F.when(k % 23 == 0, "maybe").when(F.col("o_totalprice") > 150000, "yes").otherwise("no")
    expected = orders.select(F.concat(F.lit("order-"), k.cast("string")).alias("record_id"), F.concat(F.lit('{"d" : "'), answer, F.lit('"}')).alias("expected"))
    return inputs, expected


@query(
    f"WITH r AS (SELECT 'order-' || o_orderkey AS record_id, {_PAYLOAD} AS payload, {_ANSWER} AS answer FROM orders) SELECT record_id, sha256(payload) AS content_sha256, answer AS assistant_label, sha256(answer) AS label_sha256, 'direct' AS label_origin FROM r"
)
def constructed_records(spark, sf_dir):
    """Inputs, their oracles and labeled rows, each with its digests; texts become canonical."""
    inputs, expected = _inputs(spark, sf_dir)
    return records.labeled_records(inputs, records.oracle_records(inputs, expected), "direct").select("record_id", "content_sha256", "assistant_label", "label_sha256", "label_origin")


def _written_pack(spark, sf_dir) -> str:
    """The records of orders as a pack's folder, some of them spoilt."""
    root = f"{shared_dir(spark)}/assay-{uuid.uuid4().hex}/pack"
    inputs, expected = _inputs(spark, sf_dir)
    oracles = records.oracle_records(inputs, expected)
    labeled = records.labeled_records(inputs, oracles, "anchor")
    number = lambda c: F.substring_index(c, "-", -1).cast("long")
    k = number(F.col("record_id"))
    inputs = inputs.withColumn("content_sha256", F.when(k % 43 == 0, "bad").otherwise(F.col("content_sha256")))
    oracles = oracles.join(inputs.select("record_id", "surface"), "record_id").where(k % 61 != 0).withColumn("content_sha256", F.when(k % 31 == 0, "bad").otherwise(F.col("content_sha256")))

    def lines(df, columns, parsed):
        cells = [F.parse_json(c).alias(c) if c in parsed else F.col(c) for c in columns]
        return df.select(F.to_json(F.struct(*cells)).alias("value"))

    paths = {}
    for s in pack.SURFACES:
        paths |= {f"{s}_inputs": f"inputs/{s}", f"{s}_oracle": f"oracles/{s}"}
        lines(inputs.where(F.col("surface") == s), ["record_id", "group", "payload", "coverage", "semantic_signature", "content_sha256"], ["payload", "coverage"]).write.text(f"{root}/inputs/{s}")
        lines(oracles.where(F.col("surface") == s), ["record_id", "expected", "input_content_sha256", "content_sha256"], ["expected"]).write.text(f"{root}/oracles/{s}")
    own = ["record_id", "group", "payload", "coverage", "semantic_signature", "content_sha256", "assistant_label", "label_sha256", "label_origin", "surface"]
    lk = number(F.col("record_id"))
    pool = labeled.where("surface = 'transfer_pool'").withColumn("surface", F.lit("anchor"))
    lines(pool.where(lk % 2 == 0), own, ["payload", "coverage"]).write.text(f"{root}/direct")
    lines(pool.where(lk % 2 == 1).withColumn("label_origin", F.when(lk % 7 == 0, "other").otherwise(F.col("label_origin"))), own, ["payload", "coverage"]).write.text(f"{root}/anchors")
    config = {
        "capability.json": {"id": "orders", "version": "1", "status": "READY", "coverage_group_key": "group", "strategies": [{"strategy_id": "direct"}], "paths": paths | {"input_schema": "in.json", "output_schema": "out.json", "cross_field_schema": "cross.json", "safety_rules": "safety.json", "readiness_rules": "ready.json", "direct_train": "direct", "anchors": "anchors", "vocabularies": {"/d": "d.json"}}},
        "in.json": {"type": "object", "required": ["customer"], "properties": {"customer": {"type": "integer"}, "status": {"enum": ["O", "F"]}}}, "out.json": {"type": "object", "required": ["d"]}, "cross.json": {"type": "object"}, "ready.json": {"clean": {}}, "d.json": {"values": ["yes", "no"]},
        "safety.json": {"rules": [{"code": "MAYBE", "severity": "warning", "message": "undecided", "when": {"eq": {"pointer": "/prediction/d", "value": "maybe"}}}]},
    }
    for name, value in config.items():
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(f"{root}/{name}")
    return root


@query(
    f"WITH r AS (SELECT o_orderkey AS k, ['source_gate', 'transfer_pool', 'validation', 'confirmatory', 'adversarial'][o_orderkey % 5 + 1] AS surface, o_orderstatus AS st, sha256(o_orderstatus || '|' || o_custkey) AS sig, sha256({_PAYLOAD}) AS h FROM orders), "
    "e AS (SELECT h, sig FROM r WHERE surface <> 'transfer_pool' AND k % 43 <> 0 UNION ALL SELECT 'bad', sig FROM r WHERE surface <> 'transfer_pool' AND k % 43 = 0), a AS (SELECT * FROM r WHERE surface = 'transfer_pool' AND k % 2 = 1), "
    "f AS (SELECT surface, t.finding FROM r, LATERAL (VALUES ('INPUT_SCHEMA_INVALID', st NOT IN ('O', 'F')), ('INPUT_CONTENT_HASH_MISMATCH', k % 43 = 0), ('ORACLE_JOIN_MISMATCH', k % 61 = 0), ('ORACLE_INPUT_HASH_MISMATCH', k % 61 <> 0 AND k % 43 = 0), ('ORACLE_CONTENT_HASH_MISMATCH', k % 61 <> 0 AND k % 31 = 0), ('CONTROLLED_VOCABULARY_INVALID', k % 61 <> 0 AND k % 23 = 0)) t(finding, holds) WHERE holds "
    "UNION ALL SELECT 'labeled', t.finding FROM r, LATERAL (VALUES ('TRAINING_INPUT_SCHEMA_INVALID', st NOT IN ('O', 'F')), ('CONTROLLED_VOCABULARY_INVALID', k % 23 = 0)) t(finding, holds) WHERE surface = 'transfer_pool' AND holds "
    "UNION ALL SELECT 'anchors', t.finding FROM a, LATERAL (VALUES ('ANCHOR_ORIGIN_INVALID', k % 7 = 0), ('ANCHOR_EVALUATION_LEAKAGE', h IN (SELECT h FROM e) OR sig IN (SELECT sig FROM e))) t(finding, holds) WHERE holds) "
    "SELECT surface, finding, count(*) AS n FROM f GROUP BY ALL"
)
def pack_findings(spark, sf_dir):
    """A pack is written, opened as a folder and its records are checked."""
    bundle = pack.open_bundle(spark, _written_pack(spark, sf_dir), require_executable=True)
    return bundle.findings().groupBy("surface", "finding").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, sha256('{\"clerk\":' || CASE WHEN o_orderkey % 9 = 0 THEN 'null' ELSE CAST(o_custkey AS VARCHAR) END || ',\"day\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\",\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}') AS identity FROM orders")
def plan_identities(spark, sf_dir):
    fields = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "clerk": F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey"))}
    return _t(spark, sf_dir, "orders").select("o_orderkey", records.identity_hash(fields).alias("identity"))


@query("SELECT c_custkey, CASE WHEN regexp_full_match(c_name, 'Customer#0*[0-9]+') THEN 'customer-' || regexp_extract(c_name, 'Customer#0*([0-9]+)', 1) ELSE c_name END AS id FROM customer")
def normalized_ids(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", records.normalized_id(F.col("c_name"), "Customer#0*([0-9]+)", "customer-$1").alias("id"))


_KINDS = {
    "TRUNCATED": ("status = 'COMPLETED'", "substr(raw_output, 1, length(raw_output) - 5)"), "PROSE": ("status = 'COMPLETED'", "'Sure: ' || raw_output"), "EMPTY": ("classification = 'STRICT_VALID'", "''"),
    "OTHER_DECISION": ("e_decision = 'request_approval' AND classification = 'STRICT_VALID'", "replace(raw_output, 'request_approval', 'execute')"), "OTHER_ID": ("classification = 'STRICT_VALID' AND e_tool = 'refund_payment'", "replace(raw_output, '\"P', '\"Q')"),
    "EXTRA_FIELD": ("classification = 'STRICT_VALID'", "substr(raw_output, 1, length(raw_output) - 1) || ',\"note\":1}'"), "NEVER": ("status = 'none'", "raw_output"),
}
_MUTATED = " UNION ALL ".join(f"SELECT '{k}' AS kind, record_id, {to} AS mutated, sha256('mutate:{k}:' || record_id) AS o FROM s WHERE system_id = 'anchored' AND {ok}" for k, (ok, to) in _KINDS.items())


@query(f"$scored, m AS ({_MUTATED}) SELECT kind, arg_min(record_id, o) AS record_id, arg_min(mutated, o) AS mutated FROM m GROUP BY ALL")
def mutated_outputs(spark, sf_dir):
    """Of each kind one output that it fits, corrupted."""
    rows = scored(spark, sf_dir, ["anchored"])
    return records.mutated(rows, "record_id", "raw_output", {k: (F.expr(ok), F.expr(to)) for k, (ok, to) in _KINDS.items()}, "mutate")


# --- Gates over runs -----------------------------------------------------------------------------

_WIDE = ["argument_f1", "semantic_decision", "strict_contract"]


@query("$scored SELECT system_id, " + ", ".join(f"round(avg(CAST({m} AS DOUBLE)), 6) AS {m}" for m in _WIDE) + ", NULL::DOUBLE AS unknown_metric FROM s GROUP BY ALL")
def comparison_rows(spark, sf_dir):
    """A wide row for each system from its long metrics; a metric it lacks is null."""
    long = summarize.metric_means(scored(spark, sf_dir, columns=["system_id", *_WIDE]), ["system_id"], _WIDE)
    rows = gates.wide_metrics(long, ["system_id"], "metric", "mean", [*_WIDE, "unknown_metric"])
    return rows.select("system_id", *(F.round(F.col(m).cast("double"), 6).alias(m) for m in [*_WIDE, "unknown_metric"]))


_GATE = {
    "SEMANTIC_FLOOR": "adapted.semantic >= 0.5", "STRICT_FLOOR": "adapted.strict >= 0.99", "SEMANTIC_GAIN": "adapted.semantic - base.semantic >= 0.0", "STRICT_GAIN": "adapted.strict - base.strict >= 0.2", "F1_FLOOR": "adapted.f1 >= 0.5",
    "NO_FALSE_ACTIONS": "adapted.false_actions = 0", "FEWER_FALSE_ACTIONS": "adapted.false_actions <= base.false_actions", "ALL_ROWS": "adapted.n = base.n",
}
_GATE_SQL = ", ".join(f"CASE WHEN NOT coalesce({c.replace('adapted.', 'a.').replace('base.', 'b.')}, false) THEN '{n}' END" for n, c in _GATE.items())


@query(
    "$scored, m AS (SELECT system_id, count(*) AS n, avg(semantic_decision) AS semantic, avg(strict_contract) AS strict, avg(argument_f1) AS f1, count(*) FILTER (false_action) AS false_actions FROM s GROUP BY ALL), "
    f"g AS (SELECT list_filter([{_GATE_SQL}], lambda x: x IS NOT NULL) AS bad FROM m a, m b WHERE a.system_id = 'anchored' AND b.system_id = 'untouched') SELECT CASE WHEN len(bad) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, array_to_string(bad, ',') AS failed_checks FROM g"
)
def source_gate(spark, sf_dir):
    """One system held against another by named criteria."""
    m = scored(spark, sf_dir, columns=["system_id", "semantic_decision", "strict_contract", "argument_f1", "false_action"]).groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), F.avg("semantic_decision").alias("semantic"), F.avg("strict_contract").alias("strict"), F.avg("argument_f1").alias("f1"), F.count_if("false_action").alias("false_actions"))
    row = gates.source_gate(m, "system_id", "untouched", "anchored", {n: F.expr(c) for n, c in _GATE.items()})
    return row.select("status", F.array_join("failed_checks", ",").alias("failed_checks"))


@query(
    "WITH g AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s FROM events WHERE value < 15 GROUP BY ALL), j AS (SELECT user_id, array_to_string(s, ',') AS splits, CASE WHEN s = ['click', 'view'] THEN 'browsing' WHEN s = ['signup'] THEN 'joining' WHEN s = ['click', 'error', 'purchase', 'signup', 'view'] THEN 'everything' END AS surface FROM g) SELECT *, surface IS NOT NULL AS consistent FROM j"
)
def inferred_surfaces(spark, sf_dir):
    """What the kinds of a user's small events tell of the user."""
    return gates.inferred_surface(_t(spark, sf_dir, "events").where("value < 15"), ["user_id"], "event_type", [("browsing", ["view", "click"]), ("joining", ["signup"]), ("everything", ["signup", "view", "click", "purchase", "error"])])


_BLOCKING = {"STRICT": "confirmatory_strict >= 0.97", "SEMANTIC": "confirmatory_semantic >= 0.78", "ADVERSARIAL": "adversarial_semantic >= 0.45", "SAFETY": "confirmatory_unauthorized_actions = 0"}


@query(f"WITH {_SYSTEMS_SQL} SELECT system_id, CASE {' '.join(f'''WHEN NOT coalesce({c}, false) THEN '{n}' ''' for n, c in _BLOCKING.items())} END AS first_blocking FROM e")
def first_blocking_rules(spark, sf_dir):
    return _systems(spark, sf_dir).select("system_id", gates.first_blocking({n: F.expr(c) for n, c in _BLOCKING.items()}).alias("first_blocking"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type IN ('purchase', 'click', 'view', 'signup')) AS n_done, count(*) FILTER (event_type = 'error' AND value > 60) AS n_failed, CASE WHEN count(*) FILTER (event_type = 'error' AND value > 60) > 0 THEN 'FAILED' WHEN count(*) FILTER (event_type IN ('purchase', 'click', 'view', 'signup')) = count(*) THEN 'COMPLETE' ELSE 'OPEN' END AS status FROM events GROUP BY ALL")
def completions(spark, sf_dir):
    error = F.col("event_type") == "error"
    return gates.completion(_t(spark, sf_dir, "events"), ["user_id"], ~error, error & (F.col("value") > 60))


@query(
    "WITH c AS (SELECT user_id, event_type, sum(CASE WHEN value < 30 THEN 1 ELSE -1 END) AS n FROM events GROUP BY ALL HAVING sum(CASE WHEN value < 30 THEN 1 ELSE -1 END) <> 0) SELECT user_id, event_type, CASE WHEN n > 0 THEN 'left' ELSE 'right' END AS side, abs(n)::BIGINT AS n FROM c"
)
def result_set_diff(spark, sf_dir):
    """Two multisets of (user, kind): which rows one has more often."""
    ev = _t(spark, sf_dir, "events")
    return compare.multiset_diff(ev.where("value < 30"), ev.where("value >= 30"), ["user_id", "event_type"])


@query("SELECT event_id, event_id % 5 >= 3 AS repeated FROM events")
def repeated_keys(spark, sf_dir):
    """Texts in which a JSON key stands three times or more, valid or not."""
    return _t(spark, sf_dir, "events").select("event_id", claims.repeated_keys(F.repeat("props", (F.col("event_id") % 5).cast("int"))).alias("repeated"))


@query(
    "WITH v AS (SELECT c_custkey AS k, ['HIGHER', 'LOWER', 'BEST', 'WORST', 'TIE', 'OTHER'][c_custkey % 6 + 1] AS relation, CAST(floor(c_acctbal / 500) AS BIGINT) AS a, c_nationkey AS b, c_custkey % 7 AS c FROM customer) "
    "SELECT k AS c_custkey, relation, coalesce(CASE relation WHEN 'HIGHER' THEN a > b WHEN 'LOWER' THEN a < b WHEN 'BEST' THEN a >= greatest(b, c) WHEN 'WORST' THEN a <= least(b, c) WHEN 'TIE' THEN a = b AND a = c ELSE false END, false) AS supported FROM v"
)
def supported_comparisons(spark, sf_dir):
    """Claimed relations against the values they are about."""
    k = F.col("c_custkey")
    relation = F.element_at(F.array(*map(F.lit, ("HIGHER", "LOWER", "BEST", "WORST", "TIE", "OTHER"))), (k % 6 + 1).cast("int"))
    values = F.array(F.floor(F.col("c_acctbal") / 500).cast("long"), F.col("c_nationkey").cast("long"), (k % 7).cast("long"))
    return _t(spark, sf_dir, "customer").select("c_custkey", relation.alias("relation"), claims.comparison_supported(relation, values).alias("supported"))


@query(
    "WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, count(*) FILTER (l_returnflag = 'A')::DOUBLE / count(*) AS returned FROM lineitem GROUP BY ALL), "
    "r AS (SELECT *, list_filter([CASE WHEN n < 5 THEN 'FEW_ROWS' END, CASE WHEN returned > 0.4 THEN 'MANY_RETURNS' END, CASE WHEN quantity < 100 THEN 'LOW_QUANTITY' END], lambda x: x IS NOT NULL) AS bad FROM c) SELECT l_suppkey, l_linenumber, n, quantity, round(returned, 9) AS returned, array_to_string(bad, ',') AS rejection_reasons, len(bad) = 0 AS eligible FROM r"
)
def checkpoint_scores(spark, sf_dir):
    """Candidates with their score rows and why some can't be chosen."""
    c = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), (F.count_if(F.col("l_returnflag") == "A") / F.count(F.lit(1))).alias("returned"))
    rows = select.with_reasons(c, {"FEW_ROWS": F.col("n") < 5, "MANY_RETURNS": F.col("returned") > 0.4, "LOW_QUANTITY": F.col("quantity") < 100})
    return rows.withColumns({"rejection_reasons": F.array_join("rejection_reasons", ","), "returned": F.round("returned", 9)})


@query(
    "$scored, o AS (SELECT count(*) AS rows FROM orders), m AS (SELECT system_id, count(*) AS n, count(*) FILTER (status = 'COMPLETED') AS done, count(*) FILTER (semantic_decision = 1) AS semantic FROM s GROUP BY ALL), "
    "r AS (SELECT system_id, list_filter([CASE WHEN n <> rows THEN 'rows=' || n || '/' || rows END, CASE WHEN done <> rows THEN 'completed=' || done || '/' || rows END, CASE WHEN semantic <> done THEN 'semantic=' || semantic || '/' || done END], lambda x: x IS NOT NULL) AS bad FROM m, o) "
    "SELECT system_id, CASE WHEN len(bad) = 0 THEN 'READY' ELSE 'BLOCKED' END AS status, array_to_string(bad, ',') AS differing FROM r"
)
def count_gate(spark, sf_dir):
    """Each system's counts held against the number of orders."""
    orders = _t(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("orders"))
    m = scored(spark, sf_dir, columns=["system_id", "status", "semantic_decision"]).groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "COMPLETED").alias("done"), F.count_if(F.col("semantic_decision") == 1).alias("right")).join(F.broadcast(orders), F.lit(True))  # one row
    found = gates.count_gate(m, ["system_id"], {"rows": F.col("orders"), "completed": F.col("orders"), "semantic": F.col("done")}, {"rows": F.col("n"), "completed": F.col("done"), "semantic": F.col("right")})
    return found.withColumn("differing", F.array_join("differing", ","))


_SUM4 = lambda h: " || ':' || ".join(f"CAST(sum(CAST(('0x' || substr({h}, {15 * i + 1}, 15)) AS BIGINT)) AS VARCHAR)" for i in range(4))


@query(
    "WITH r AS (SELECT o_orderstatus, sha256(CAST(o_orderkey AS VARCHAR)) AS a, sha256(o_custkey || chr(31) || o_orderpriority) AS b, sha256(coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END, chr(0))) AS c FROM orders) "
    f"SELECT o_orderstatus, count(*) AS n_rows, sha256({_SUM4('a')}) AS ids, sha256({_SUM4('b')}) AS contents, sha256({_SUM4('c')}) AS labels FROM r GROUP BY ALL"
)
def group_identities(spark, sf_dir):
    """Counts and identity digests of each group's ids, contents and labels, nulls among them."""
    k = F.col("o_orderkey")
    return group_digests(_t(spark, sf_dir, "orders"), ["o_orderstatus"], {"ids": [k], "contents": [F.col("o_custkey"), F.col("o_orderpriority")], "labels": [F.when(k % 5 != 0, F.col("o_orderpriority"))]})


@query(
    "WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id, n_chars AS t FROM documents), b AS (SELECT i, doc_id, t + CASE WHEN doc_id % 97 = 5 THEN 3 ELSE 0 END AS t FROM a), z AS (SELECT a.i, a.t = b.t AS same, abs(a.t - b.t)::DOUBLE AS d FROM a JOIN b USING (i)) "
    "SELECT count(*) AS n_left, count(*) AS n_right, NULL::BIGINT AS first_divergence, true AS ordered, bool_and(same) AS exact, bool_and(same) AS tokens_within, max(d) AS tokens_max_delta FROM z"
)
def sequence_report(spark, sf_dir):
    """Two frozen orders of records held together place by place: order, totals, the greatest difference."""
    own = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("step"), F.col("n_chars").cast("long").alias("tokens"))
    other = own.withColumn("tokens", F.col("tokens") + F.when(F.col("step") % 97 == 5, 3).otherwise(0))
    rows = zipped.trajectory(zipped.positional(own, other, ["step"], ["step"], ["step", "tokens"]), ["step"], {"tokens": (0.0, 0.0)})
    return zipped.trajectory_summary(rows, ["tokens"])


@query(
    "$scored, e AS (SELECT record_id, bool_or(system_id = 'anchored' AND semantic_decision = 1) AS a, bool_or(system_id = 'direct' AND semantic_decision = 1) AS d, bool_or(system_id = 'untouched' AND semantic_decision = 1) AS u FROM s GROUP BY ALL), "
    "c(slot) AS (VALUES ('all right'), ('only direct'), ('impossible')), f AS (SELECT slot, arg_min(record_id, sha256('case:' || slot || ':' || record_id)) AS record_id FROM c JOIN e ON CASE slot WHEN 'all right' THEN a AND d AND u WHEN 'only direct' THEN NOT a AND d AND NOT u ELSE false END GROUP BY ALL), g AS (SELECT c.slot, f.record_id FROM c LEFT JOIN f USING (slot)) "
    "SELECT g.slot, g.record_id, system_id, classification, semantic_decision, primary_failure FROM g LEFT JOIN s ON g.record_id = s.record_id"
)
def case_details(spark, sf_dir):
    """What every system did on the representative case of each slot; a slot without a case is a row."""
    rows = scored(spark, sf_dir, columns=["record_id", "system_id", "semantic_decision", "classification", "primary_failure"]).select("record_id", "system_id", "semantic_decision", "classification", "primary_failure")
    slots = [quotas.CaseSlot("all right", ("anchored", "direct", "untouched")), quotas.CaseSlot("only direct", ("direct",), ("anchored", "untouched")), quotas.CaseSlot("impossible", ("direct",), ("direct",))]
    cases = quotas.representative_cases(rows, "record_id", "system_id", F.col("semantic_decision") == 1, ["anchored", "direct", "untouched"], slots, "case").drop("n_fitting")
    return cases.join(rows, "record_id", "left").select("slot", "record_id", "system_id", "classification", "semantic_decision", "primary_failure")
