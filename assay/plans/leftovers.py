"""More of the catalogue: residuals, accounts, replays, pool selections, audits and the generic evaluator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, distribution, records, residuals, select
from ..operators.evaluate import Comparison, Evaluator, evaluate
from ..operators.score import parse, score
from ..operators.summarize import count_true
from ..operators.zipped import with_ordinals
from ..sources.jsonl import ids_in
from ..sources.shared import save
from . import routing
from .catalogue import _t, query
from .scored import DUCKDB, FIELD_FLAGS, scored

_BLOCKERS = ["UNAUTHORIZED_AUTO_APPROVAL", "ACTION_WITHOUT_REQUEST"]


@query(
    "$scored, g AS (SELECT system_id, surface, grp, count(*) AS n, count(*) FILTER (schema_valid AND vocabulary_conformant AND n_blockers = 0) AS operational, "
    + ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in FIELD_FLAGS) + ", " + ", ".join(f"count(*) FILTER (list_contains(codes, '{c}')) AS {c.lower()}" for c in _BLOCKERS)
    + ", sum(semantic_decision) AS good FROM s GROUP BY ALL) SELECT system_id, surface, sum(n)::BIGINT AS n, sum(operational)::BIGINT AS operational, "
    + ", ".join(f"sum({f})::BIGINT AS {f}" for f in FIELD_FLAGS) + ", " + ", ".join(f"sum({c.lower()})::BIGINT AS {c.lower()}" for c in _BLOCKERS) + ", round(min(good / n), 6) AS group_floor FROM g GROUP BY ALL"
)
def atomic_summary(spark, sf_dir):
    rows = residuals.atomic_summary(scored(spark, sf_dir), ["system_id", "surface"], FIELD_FLAGS, _BLOCKERS, "grp")
    return rows.withColumn("group_floor", F.round("group_floor", 6))


@query("$scored SELECT record_id, system_id, status, semantic_decision, len(codes)::INT AS n_findings FROM s WHERE NOT coalesce(semantic_decision = 1 AND status = 'COMPLETED' AND len(codes) = 0, false)")
def residual_rows(spark, sf_dir):
    return residuals.imperfect(scored(spark, sf_dir)).select("record_id", "system_id", "status", "semantic_decision", F.size("findings").alias("n_findings"))


@query("$scored, r AS (SELECT * FROM s WHERE NOT coalesce(semantic_decision = 1 AND status = 'COMPLETED' AND len(codes) = 0, false)) SELECT system_id, profile, count(*) AS n FROM (SELECT system_id, unnest(list_distinct(tags)) AS profile FROM r) GROUP BY ALL")
def residual_profiles(spark, sf_dir):
    return residuals.profile_counts(residuals.imperfect(scored(spark, sf_dir, columns=["system_id", "status", "semantic_decision", "findings", "tags"])), ["system_id"], "tags")


@query(
    "$scored, m AS (SELECT system_id, surface, count(*) AS n, sum(semantic_decision) AS good, count(*) FILTER (status = 'COMPLETED') AS done FROM s GROUP BY ALL), "
    "a AS (SELECT system_id, surface, t.* FROM m, LATERAL (VALUES ('n', n::DOUBLE), ('good', good::DOUBLE), ('done', done::DOUBLE)) t(measure, v)) "
    "SELECT system_id, surface, measure, CASE WHEN measure = 'good' AND surface = 'adversarial' THEN v + 1 ELSE v END AS stored, v AS rebuilt, NOT (measure = 'good' AND surface = 'adversarial') AS agrees FROM a"
)
def replayed_summary(spark, sf_dir):
    """A stored summary, one surface of which was tampered with, against the one its rows give again."""
    summary = lambda df: df.groupBy("system_id", "surface").agg(F.count(F.lit(1)).alias("n"), F.sum("semantic_decision").alias("good"), F.count_if(F.col("status") == "COMPLETED").alias("done"))
    rows = scored(spark, sf_dir, columns=["system_id", "surface", "status", "semantic_decision"])
    stored = save(summary(rows).withColumn("good", F.col("good") + (F.col("surface") == "adversarial").cast("int")), "stored-summary")
    return residuals.replayed(stored, summary(rows), ["system_id", "surface"], ["n", "good", "done"])


@query(f"WITH {DUCKDB} SELECT grp, count(*) AS n, count(*) AS n_perfect FROM s WHERE system_id = 'anchored' GROUP BY ALL")
def oracle_self_check(spark, sf_dir):
    """Each expected contract, given as an output, must score as perfect."""
    df = routing.predictions(spark, sf_dir).where("system_id = 'anchored'").withColumn("raw_output", F.col("expected_json"))
    quoted = lambda c: F.array(F.concat(F.lit('"'), c, F.lit('"')))
    allowed = F.create_map(F.lit("payment_id"), quoted(F.col("payment_id")), F.lit("amount_minor"), F.array(F.col("amount_minor").cast("string")), F.lit("customer_id"), quoted(F.col("customer_id")), F.lit("currency"), F.array(F.lit('"USD"')))
    tools = F.array(F.lit("refund_payment"), F.lit("escalate_fraud_review"))
    df = df.withColumns({"expected": F.parse_json("expected_json"), "allowed_values": F.map_filter(allowed, lambda k, v: F.get(v, F.lit(0)).isNotNull()), "authorized_tools": tools})
    perfect = (F.col("semantic_decision") == 1) & (F.col("strict_contract") == 1) & (F.col("argument_f1") == 1)
    return score(parse(df)).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), count_true(perfect).alias("n_perfect"))


_REASON = "CASE WHEN status <> 'COMPLETED' THEN 'NOT_COMPLETED' WHEN classification = 'UNPARSEABLE' THEN 'UNPARSEABLE' WHEN semantic_decision = 0 THEN 'WRONG' END"


@query(
    f"$scored, c AS (SELECT coalesce({_REASON}, 'ACCEPTED') AS reason, count(*) FILTER (system_id = 'direct') AS n_first, count(*) FILTER (system_id = 'anchored') AS n_second FROM s WHERE system_id IN ('direct', 'anchored') GROUP BY ALL) "
    "SELECT reason, n_first, n_second, round(n_first / (SELECT sum(n_first) FROM c), 6)::DOUBLE AS share_first, round(n_second / (SELECT sum(n_second) FROM c), 6)::DOUBLE AS share_second FROM c"
)
def attempt_comparison(spark, sf_dir):
    rows = residuals.attempts(scored(spark, sf_dir, ["direct", "anchored"], columns=["system_id", "status", "classification", "semantic_decision"]).withColumn("reason", F.expr(_REASON)), "system_id", "reason", "direct", "anchored")
    return rows.withColumns({c: F.round(c, 6) for c in ("share_first", "share_second")})


@query("SELECT event_type, max(CASE WHEN isfinite(v) THEN v END) AS greatest, count(*) FILTER (isfinite(v) AND v > 100) AS n_over, coalesce(bool_and(isfinite(v)), true) AS all_finite FROM (SELECT event_type, CASE WHEN event_type = 'error' AND value > 180 THEN 'NaN'::DOUBLE WHEN event_type = 'signup' AND value < 1 THEN '-Infinity'::DOUBLE ELSE value END AS v FROM events) GROUP BY ALL")
def finite_profile(spark, sf_dir):
    v = F.when((F.col("event_type") == "error") & (F.col("value") > 180), float("nan")).when((F.col("event_type") == "signup") & (F.col("value") < 1), float("-inf")).otherwise(F.col("value"))
    return residuals.finite_profile(_t(spark, sf_dir, "events").withColumn("v", v), ["event_type"], "v", 100.0)


@query("SELECT user_id, count(*) AS n, sum(CAST(floor(value * 100) AS BIGINT))::BIGINT AS cost, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS seconds FROM events GROUP BY ALL")
def user_accounts(spark, sf_dir):
    return residuals.accounts(_t(spark, sf_dir, "events"), ["user_id"], F.floor(F.col("value") * 100), "ts")


@query("SELECT user_id, coalesce(max(CASE WHEN event_type = 'error' AND regexp_extract(props, '([0-9]+)', 1) <> '' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END), -1)::BIGINT AS last_step FROM events GROUP BY ALL")
def error_steps(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", F.col("props"))
    return residuals.last_steps(_t(spark, sf_dir, "events").withColumn("_text", F.coalesce(text, F.lit(""))), ["user_id"], "_text", r"([0-9]+)", -1)


@query(
    "WITH d AS (SELECT d.doc_id, source, coalesce(quality = 1, false) AS ok, sha256('11:' || d.doc_id) AS o FROM documents d LEFT JOIN labels l USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY source, ok ORDER BY o) AS k FROM d) "
    "SELECT doc_id, source, CASE WHEN NOT ok THEN 'ineligible' WHEN k <= 5 THEN 'selected' ELSE 'unselected' END AS status FROM r"
)
def pool_selection(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    order = F.sha2(F.concat(F.lit("11:"), F.col("doc_id").cast("string")), 256)
    return select.pool_selection(docs, ["source"], F.col("quality") == 1, order, 5).select("doc_id", "source", "status")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('12:' || doc_id)) AS k FROM documents) WHERE k <= 14 OR source = 'src1'")
def quota_but_one(spark, sf_dir):
    order = F.sha2(F.concat(F.lit("12:"), F.col("doc_id").cast("string")), 256)
    return select.quota_but(_t(spark, sf_dir, "documents").select("doc_id", "source"), "source", order, 14, ["src1"])


@query(
    "WITH f AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('12:' || doc_id)) AS k, sha256('13:' || doc_id) AS o FROM documents QUALIFY k <= 14) "
    "SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY o) <= 10 THEN 'selected' ELSE 'unselected' END AS status FROM f"
)
def anchors_and_rest(spark, sf_dir):
    """Ten of fourteen by keyed hash; the other four are kept as the rest."""
    order = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")), 256)
    first = select.quota_but(_t(spark, sf_dir, "documents").select("doc_id", "source"), "source", order(12), 14, [])
    return select.pool_selection(first, ["source"], F.lit(True), order(13), 10)


@query(
    "WITH p AS (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '/(en|de|fr|es)/', 1) AS v FROM pages) "
    "SELECT host, count(*) FILTER (v = 'en') AS n_en, count(*) FILTER (v = 'de') AS n_de, count(*) FILTER (v = 'en') = 1 AND count(*) FILTER (v = 'de') = 1 AS balanced FROM p GROUP BY ALL"
)
def balanced_variants(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"), "url")
    return select.balanced_variants(pages, "host", "url", "/(en|de|fr|es)/", ["en", "de"], 1)


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer ORDER BY c_custkey")
def ordered_customers(spark, sf_dir):
    """All customers by a key that must be unique, with the place of each."""
    rows = select.ordered_unique(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return with_ordinals(rows, ["c_custkey"], "place").orderBy("c_custkey").select("c_custkey", "c_name", "place")


@query("SELECT count(*) AS n_rows, count(*) - count(DISTINCT doc_id) AS repeated_id, count(*) - count(DISTINCT sha256(text)) AS repeated_content, count(*) - count(DISTINCT lang || ':' || source || ':' || n_chars) AS repeated_signature FROM documents")
def dataset_audit(spark, sf_dir):
    signature = F.concat_ws(":", "lang", "source", F.col("n_chars").cast("string"))
    return residuals.dataset_audit(_t(spark, sf_dir, "documents"), {"id": F.col("doc_id"), "content": F.sha2("text", 256), "signature": signature})


@query("SELECT l_orderkey, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY ALL HAVING sum(l_linenumber) IS DISTINCT FROM 10")
def group_totals(spark, sf_dir):
    return residuals.group_totals(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", 10)


@query(
    "WITH a AS (SELECT user_id AS k, count(*) AS v FROM events WHERE event_type = 'error' GROUP BY ALL), b AS (SELECT user_id AS k, count(*) AS v FROM events WHERE event_type = 'signup' GROUP BY ALL) "
    "SELECT CASE WHEN a.v IS NULL THEN 'right only' WHEN b.v IS NULL THEN 'left only' WHEN a.v = b.v THEN 'equal' ELSE 'differs' END AS origin, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY ALL"
)
def origin_map_diff(spark, sf_dir):
    counts = lambda kind: _t(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias("v"))
    return residuals.origin_map_diff(counts("error"), counts("signup"), "user_id", ["v"])


@query("SELECT CASE WHEN b < 6 THEN 'train' WHEN b < 8 THEN 'validation' WHEN b < 9 THEN 'test' END AS split, count(*) AS n FROM (SELECT doc_id % 10 AS b FROM documents) GROUP BY ALL")
def split_names(spark, sf_dir):
    split = residuals.split_name(F.col("doc_id") % 10, [("train", 6), ("validation", 8), ("test", 9)])
    return _t(spark, sf_dir, "documents").groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, CASE WHEN t IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS status, coalesce(t, '') AS output FROM (SELECT page_id, nullif(regexp_extract(coalesce(url, ''), 'utm_source=([a-z]+)', 1), '') AS t FROM pages)")
def typed_outputs(spark, sf_dir):
    text = F.regexp_extract(F.coalesce("url", F.lit("")), "utm_source=([a-z]+)", 1)
    rows = _t(spark, sf_dir, "pages").select("page_id", F.when(text != "", text).alias("t"), F.lit(None).cast("string").alias("status"))
    return residuals.typed_outputs(rows, "t").select("page_id", "status", "output")


@query("SELECT o_orderkey, sha256('{\"customer\":' || CASE WHEN o_custkey IS NULL THEN 'false' ELSE 'true' END || ',\"large\":' || CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END || ',\"status\":\"' || o_orderstatus || '\"}') AS digest FROM orders")
def presence_digests(spark, sf_dir):
    facts = {"customer": F.col("o_custkey"), "large": F.col("o_totalprice") > 100000, "status": F.col("o_orderstatus")}
    return _t(spark, sf_dir, "orders").select("o_orderkey", residuals.presence_digest(facts, ["customer"]).alias("digest"))


@query(
    "WITH h AS (SELECT c_custkey, c_name AS t, sha256('id:' || c_custkey) AS h FROM customer), n AS (SELECT *, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % length(t) + 1 AS p, substr('ABCDEFGH', (CAST(('0x' || substr(h, 9, 8)) AS BIGINT) % 8 + 1)::INT, 1) AS c FROM h) "
    "SELECT c_custkey, substr(t, 1, p::INT - 1) || c || substr(t, p::INT + 1) AS changed FROM n"
)
def substituted_ids(spark, sf_dir):
    key = F.concat(F.lit("id:"), F.col("c_custkey").cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", residuals.substituted(F.col("c_name"), key, "ABCDEFGH").alias("changed"))


_EVALUATOR = Evaluator(
    output_schema={"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}},
    cross_field_schema={"properties": {"k": {"maximum": 80}}},
    comparisons=[Comparison("k", "/k", "numeric", 10.0), Comparison("same", "/k", "exact", semantic=False)],
    required_pointers=["/k"], vocabularies={"/k": list(range(0, 90, 3))},
    safety_rules=[
        {"code": "OVER", "severity": "blocker", "message": "far from what was expected", "when": {"and": [{"not": {"in": {"pointer": "/prediction/k", "value": list(range(50))}}}, {"exists": "/prediction/k"}]}},
        {"code": "DIFFERS", "severity": "warning", "message": "another value", "when": {"ne": {"pointer": "/prediction/k", "value": {"pointer": "/expected/k"}}}},
    ],
    whole_output_json_fence=True,
)


@query(
    "WITH e AS (SELECT event_id, event_type, event_id % 100 AS x, CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN props || 'x' WHEN 2 THEN '[' || props || ']' ELSE props END AS raw, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), "
    "c AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'NORMALIZED_VALID' WHEN 1 THEN 'UNPARSEABLE' WHEN 2 THEN 'UNPARSEABLE' ELSE 'STRICT_VALID' END AS classification FROM e), "
    "f AS (SELECT *, classification <> 'UNPARSEABLE' AS valid, classification <> 'UNPARSEABLE' AND k <= 80 AS able FROM c) "
    "SELECT event_type, classification, count(*) AS n, count(*) FILTER (valid) AS schema_valid, count(*) FILTER (valid AND k % 3 = 0 AND k < 90) AS vocabulary_conformant, count(*) FILTER (able) AS cross_field_conformant, "
    "count(*) FILTER (able AND abs(k - x) <= 10) AS semantic_match, count(*) FILTER (able AND k = x) AS structural_exact, count(*) FILTER (able AND classification = 'STRICT_VALID') AS strict_valid, "
    "round(sum(CASE WHEN able THEN (CAST(abs(k - x) <= 10 AS INT) + CAST(k = x AS INT)) / 2.0 ELSE 0 END), 6)::DOUBLE AS field_total, count(*) FILTER (valid AND k >= 50) AS n_blockers, count(*) FILTER (valid AND k <> x) + count(*) FILTER (valid AND k >= 50) AS n_findings FROM f GROUP BY ALL"
)
def generic_evaluation(spark, sf_dir):
    """The declared evaluator on outputs of three kinds: plain, fenced and broken."""
    case = F.col("event_id") % 5
    raw = F.when(case == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(case == 1, F.concat("props", F.lit("x"))).when(case == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    none = F.parse_json(F.lit("{}"))
    df = _t(spark, sf_dir, "events").select("event_id", "event_type", raw.alias("raw_output"), F.parse_json(F.concat(F.lit('{"k":'), (F.col("event_id") % 100).cast("string"), F.lit("}"))).alias("expected"), none.alias("payload"), none.alias("safety_context"))
    rows = evaluate(df, _EVALUATOR)
    flags = ["schema_valid", "vocabulary_conformant", "cross_field_conformant", "semantic_match", "structural_exact", "strict_valid"]
    return rows.groupBy("event_type", "classification").agg(
        F.count(F.lit(1)).alias("n"), *(count_true(F.col(f)).alias(f) for f in flags), F.round(F.sum("field_mean"), 6).alias("field_total"), F.sum("n_blockers").alias("n_blockers"), F.sum(F.size("safety_findings")).cast("bigint").alias("n_findings")
    )


@query("WITH b(name, lo, hi) AS (VALUES ('short', 0, 499), ('middle', 500, 1999), ('long', 2500, 1000000)) SELECT name AS bucket, count(*) AS n FROM documents LEFT JOIN b ON n_chars BETWEEN lo AND hi GROUP BY ALL")
def bucket_ranges(spark, sf_dir):
    buckets = spark.createDataFrame([("n_chars", "short", 0, 499), ("n_chars", "middle", 500, 1999), ("n_chars", "long", 2500, 1_000_000), ("other", "any", 0, 9)], "field string, name string, minimum long, maximum long")
    return distribution.bucket_join(_t(spark, sf_dir, "documents"), "n_chars", "n_chars", buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT event_id, '/a/b/c/k' AS path, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value, json_extract(props, '$.k')::VARCHAR AS actual FROM events WHERE CAST(floor(value) AS BIGINT)::VARCHAR IS DISTINCT FROM json_extract(props, '$.k')::VARCHAR"
)
def nested_diff(spark, sf_dir):
    """Differences three objects deep, at their own paths."""
    ev = _t(spark, sf_dir, "events")
    inside = lambda c: F.concat(F.lit('{"a":{"b":{"c":'), c, F.lit("}},\"same\":[1,{}]}"))
    wanted = ev.select("event_id", inside(F.concat(F.lit('{"k":'), F.floor("value").cast("string"), F.lit("}"))).alias("j"))
    actual = ev.select("event_id", inside(F.col("props")).alias("j"))
    return compare.subset_diff(compare.leaves(wanted, "event_id", "j"), compare.leaves(actual, "event_id", "j"), "event_id")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events UNION SELECT 'u' || user_id FROM events")
def nested_ids(spark, sf_dir):
    """Ids that named fields hold at the top and eight levels down."""
    deep = F.concat(F.lit('{"record_id":"'), F.col("event_id").cast("string"), F.lit('","x":[{"a":{"b":{"c":{"d":[{"e":{"example_ids":["u'), F.col("user_id").cast("string"), F.lit('"]}}]}}}}]}'))
    return ids_in(_t(spark, sf_dir, "events").select(deep.alias("j")), "j")


_INPUTS = (
    "SELECT o_orderkey AS i, 'order-' || CAST(o_orderkey AS STRING) AS record_id, o_orderstatus AS grp, '{\"k\":' || CASE WHEN o_orderkey % 47 = 0 THEN '\"x\"' ELSE CAST(o_orderkey AS STRING) END || '}' AS payload, "
    "'{\"group\":\"' || CASE WHEN o_orderkey % 53 = 0 THEN 'X' ELSE o_orderstatus END || '\"}' AS coverage, CASE WHEN o_orderkey % 59 = 0 THEN '{\"d\":7}' WHEN o_orderkey % 37 = 0 THEN '{\"d\":\"maybe\"}' WHEN o_orderkey % 23 = 0 THEN 'yes' ELSE '{\"d\":\"yes\"}' END AS answer FROM orders"
)
_IN_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}
_OUT_SCHEMA = {"type": "object", "required": ["d"], "properties": {"d": {"type": "string"}}}
_KNOWN = {"/d": ["yes", "no"]}


def _records(spark, sf_dir):
    _t(spark, sf_dir, "orders").createOrReplaceTempView("_assay_orders")
    df = spark.sql(_INPUTS.replace("FROM orders", "FROM _assay_orders")).withColumnRenamed("grp", "group")
    df = df.withColumn("content_sha256", F.when(F.col("i") % 43 == 0, "bad").otherwise(F.sha2("payload", 256)))
    return df.unionByName(df.where("i % 101 = 0"))


@query(
    f"WITH o AS ({_INPUTS.replace('STRING', 'VARCHAR')}), r AS (SELECT *, CASE WHEN i % 43 = 0 THEN 'bad' ELSE sha256(payload) END AS h, 1 AS copies FROM o UNION ALL SELECT *, CASE WHEN i % 43 = 0 THEN 'bad' ELSE sha256(payload) END, 2 FROM o WHERE i % 101 = 0), "
    "c AS (SELECT r.*, t.* FROM r, LATERAL (VALUES ('COVERAGE_GROUP_MISMATCH', i % 53 = 0), ('INPUT_SCHEMA_INVALID', i % 47 = 0), ('INPUT_CONTENT_HASH_MISMATCH', i % 43 = 0), ('DUPLICATE_RECORD_ID', copies = 2), "
    "('ORACLE_JOIN_MISMATCH', i % 61 = 0), ('ORACLE_INPUT_HASH_MISMATCH', i % 61 <> 0 AND i % 29 = 0), ('ORACLE_CONTENT_HASH_MISMATCH', i % 61 <> 0 AND i % 31 = 0), ('ORACLE_SCHEMA_INVALID', i % 61 <> 0 AND (i % 59 = 0 OR (i % 37 <> 0 AND i % 23 = 0))), ('CONTROLLED_VOCABULARY_INVALID', i % 61 <> 0 AND (i % 59 = 0 OR i % 37 = 0))) t(finding, holds)) "
    "SELECT finding, count(*) AS n FROM c WHERE holds GROUP BY ALL"
)
def record_findings(spark, sf_dir):
    inputs = _records(spark, sf_dir)
    oracles = inputs.dropDuplicates(["record_id"]).where("i % 61 <> 0").select(
        "record_id", F.col("answer").alias("expected"), F.when(F.col("i") % 29 == 0, "other").otherwise(F.col("content_sha256")).alias("input_content_sha256"), F.when(F.col("i") % 31 == 0, "bad").otherwise(F.sha2("answer", 256)).alias("content_sha256")
    )
    found = records.input_findings(inputs, _IN_SCHEMA, "group").unionByName(records.oracle_findings(inputs, oracles, _OUT_SCHEMA, _KNOWN))
    return found.groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH o AS ({_INPUTS.replace('STRING', 'VARCHAR')}), r AS (SELECT *, 1 AS copies FROM o UNION ALL SELECT *, 2 FROM o WHERE i % 101 = 0), "
    "c AS (SELECT r.*, t.* FROM r, LATERAL (VALUES ('COVERAGE_GROUP_MISMATCH', i % 53 = 0), ('TRAINING_INPUT_SCHEMA_INVALID', i % 47 = 0), ('INPUT_CONTENT_HASH_MISMATCH', i % 43 = 0), ('DUPLICATE_LABELED_RECORD_ID', copies = 2), ('ASSISTANT_LABEL_HASH_MISMATCH', i % 31 = 0), "
    "('TRAINING_LABEL_INVALID_JSON', NOT json_valid(answer)), ('TRAINING_LABEL_SCHEMA_INVALID', i % 59 = 0), ('CONTROLLED_VOCABULARY_INVALID', i % 59 = 0 OR i % 37 = 0)) t(finding, holds)) "
    "SELECT finding, count(*) AS n FROM c WHERE holds GROUP BY ALL"
)
def labeled_findings(spark, sf_dir):
    labeled = _records(spark, sf_dir).withColumn("assistant_label", F.col("answer")).withColumn("label_sha256", F.when(F.col("i") % 31 == 0, "bad").otherwise(F.sha2("answer", 256)))
    return records.labeled_findings(labeled, _IN_SCHEMA, _OUT_SCHEMA, "group", _KNOWN).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH a AS (SELECT item_id, sha256(text) AS h, sha256(lower(text)) AS g FROM benchmark), d AS (SELECT doc_id, 'anchor' || CASE WHEN doc_id % 7 = 0 THEN '-x' ELSE '' END AS o, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'anchor' END AS s, sha256(text) AS h, sha256(lower(text)) AS g FROM documents) "
    "SELECT finding, count(*) AS n FROM d, LATERAL (VALUES ('ANCHOR_ORIGIN_INVALID', o <> 'anchor'), ('ANCHOR_SURFACE_INVALID', s <> 'anchor'), ('ANCHOR_EVALUATION_LEAKAGE', h IN (SELECT h FROM a) OR g IN (SELECT g FROM a) OR CAST(doc_id AS VARCHAR) IN (SELECT CAST(item_id AS VARCHAR) FROM a))) t(finding, holds) WHERE holds GROUP BY ALL"
)
def anchor_findings(spark, sf_dir):
    key = lambda df, i: df.select(F.col(i).cast("string").alias("record_id"), F.sha2("text", 256).alias("content_sha256"), F.sha2(F.lower("text"), 256).alias("semantic_signature"))
    docs = _t(spark, sf_dir, "documents")
    anchors = key(docs, "doc_id").withColumn("_d", F.col("record_id").cast("long")).withColumns({"label_origin": F.when(F.col("_d") % 7 == 0, "anchor-x").otherwise("anchor"), "surface": F.when(F.col("_d") % 5 == 0, "test").otherwise("anchor")})
    return records.anchor_findings(anchors, key(_t(spark, sf_dir, "benchmark"), "item_id")).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))
