"""More of the catalogue: replays, plugins, slots, dependent quotas, trajectories, stage machines, star joins."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import functions as F

from ..functions import openjson, plugins
from ..functions.jsontext import iso_text
from ..operators import digest_tree, machine, matching, quotas, replay, star, zipped
from ..operators.summarize import count_true
from ..sources.shared import save, shared_dir
from . import routing
from .catalogue import _t, query
from .scored import score_rows, scored

# --- Replays -------------------------------------------------------------------------------------

_REPLAYED = ["classification", "strict_contract", "semantic_decision", "argument_f1", "argument_precision", "argument_recall"]


def _run_with_tampering(spark, sf_dir):
    """A stored run some of whose parser results and metrics are not what its outputs give."""
    rows = score_rows(routing.predictions(spark, sf_dir))
    k = F.col("o_orderkey")
    return rows.withColumns({
        "classification": F.when(k % 211 == 3, "UNPARSEABLE").otherwise(F.col("classification")),
        "argument_f1": F.col("argument_f1") + F.when(k % 307 == 5, 0.125).otherwise(0.0),
        "semantic_decision": F.when(k % 401 == 7, 1 - F.col("semantic_decision")).otherwise(F.col("semantic_decision")),
    })


@query(
    "$scored, d AS (SELECT * FROM s WHERE status <> 'FAILED') SELECT record_id, system_id, 'PARSER_MISMATCH' AS finding, 'classification' AS fields FROM d WHERE o_orderkey % 211 = 3 AND classification <> 'UNPARSEABLE' "
    "UNION ALL SELECT record_id, system_id, 'METRICS_MISMATCH', array_to_string(list_filter([CASE WHEN o_orderkey % 307 = 5 THEN 'argument_f1' END, CASE WHEN o_orderkey % 401 = 7 THEN 'semantic_decision' END], lambda x: x IS NOT NULL), ',') FROM d WHERE o_orderkey % 307 = 5 OR o_orderkey % 401 = 7"
)
def replayed_rows(spark, sf_dir):
    """Every stored output parsed and scored again; the rows and fields that say something else."""
    path = f"{shared_dir(spark)}/assay-{uuid.uuid4().hex}"
    rows = _run_with_tampering(spark, sf_dir)
    kept = [*routing_columns(spark, sf_dir), *_REPLAYED]
    stored = digest_tree.store(rows.select(*kept), f"{path}/stored", ["record_id", "system_id"], _REPLAYED)
    return replay.replay_rows(stored, lambda df: score_rows(df.drop(*_REPLAYED)), f"{path}/rebuilt", ["classification"])


def routing_columns(spark, sf_dir) -> list[str]:
    return routing.predictions(spark, sf_dir).columns


_ARTIFACTS = {
    "classes": (["system_id", "classification"], lambda df: df.groupBy("system_id", "classification").agg(F.count(F.lit(1)).alias("n"))),
    "failures": (["system_id", "tag"], lambda df: df.select("system_id", F.explode("tags").alias("tag")).groupBy("system_id", "tag").agg(F.count(F.lit(1)).alias("n"))),
    "groups": (["system_id", "surface", "grp"], lambda df: df.groupBy("system_id", "surface", "grp").agg(F.count(F.lit(1)).alias("n"), count_true(F.col("semantic_decision") == 1).alias("semantic"))),
    "summary": (["system_id", "surface"], lambda df: df.groupBy("system_id", "surface").agg(F.count(F.lit(1)).alias("n"), F.sum("semantic_decision").alias("good"), count_true(F.col("status") == "COMPLETED").alias("done"))),
}


@query(
    "$scored, k AS (SELECT 'classes' AS kind, count(DISTINCT (system_id, classification)) AS n, count(DISTINCT CASE WHEN classification = 'STRICT_VALID' THEN system_id END) AS bad FROM s "
    "UNION ALL SELECT 'failures', count(DISTINCT (system_id, tag)), 0 FROM (SELECT system_id, unnest(tags) AS tag FROM s) UNION ALL SELECT 'groups', count(DISTINCT (system_id, surface, grp)), 0 FROM s "
    "UNION ALL SELECT 'summary', count(DISTINCT (system_id, surface)), count(DISTINCT CASE WHEN surface = 'adversarial' THEN system_id END) FROM s) "
    "SELECT kind, CASE WHEN bad > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, n AS n_stored, n AS n_rebuilt, bad AS n_differing, false AS single_surface FROM k"
)
def replayed_artifacts(spark, sf_dir):
    """Stored tables of four kinds, two of them tampered with, against those that the run's rows give."""
    rows = scored(spark, sf_dir)
    stored = {kind: build(rows) for kind, (_, build) in _ARTIFACTS.items()}
    stored["classes"] = stored["classes"].withColumn("n", F.col("n") + (F.col("classification") == "STRICT_VALID").cast("int"))
    stored["summary"] = stored["summary"].withColumn("good", F.col("good") + (F.col("surface") == "adversarial").cast("int"))
    stored = {kind: save(df, kind) for kind, df in stored.items()}
    return replay.replay_artifacts(stored, {k: build for k, (_, build) in _ARTIFACTS.items()}, {k: keys for k, (keys, _) in _ARTIFACTS.items()}, rows, "surface")


# --- Plugins -------------------------------------------------------------------------------------

MARGIN = {"plugin_id": "margin", "version": "1.0.0", "sha256": "1bedee7d34a4dc19943e093483b997a07a3b36068ab647e6199c06228d59d435", "schema": "k long, over boolean, margin long"}


@query(
    "SELECT event_id, CASE WHEN value > 150 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN value > 150 THEN 'ValueError: value out of range' END AS error, CASE WHEN value <= 150 THEN k END AS k, CASE WHEN value <= 150 THEN k > value END AS over, CASE WHEN value <= 150 THEN k - CAST(floor(value) AS BIGINT) END AS margin "
    "FROM (SELECT event_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
)
def plugin_scores(spark, sf_dir):
    """A pinned plugin on every event; rows it cannot judge are FAILED rows."""
    plugin = plugins.load(spark, str(Path(__file__).with_name("margin_plugin.py")), **MARGIN)
    rows = _t(spark, sf_dir, "events").select("event_id", plugins.evaluate(plugin, event_id=F.col("event_id"), value=F.col("value"), props=F.col("props")).alias("r"))
    return rows.select("event_id", "r.status", "r.error", "r.value.*")


# --- Slots and quotas ----------------------------------------------------------------------------

_ATTEMPTS = 4
_ATTEMPTS_SQL = (
    f"a AS (SELECT c_custkey AS slot, t.attempt, ['a' || (c_custkey // 3) || ':' || t.attempt, 'b' || substr(sha256('slot' || c_custkey), 1, 3) || ':' || (t.attempt % 3)] AS keys FROM customer, (SELECT unnest(range({_ATTEMPTS})) AS attempt) t), "
    "x AS (SELECT DISTINCT 'a' || (o_custkey // 3) || ':0' AS key FROM orders WHERE o_orderstatus = 'P')"
)


def _attempts(spark, sf_dir):
    k, n = F.col("slot"), F.col("attempt")
    text = lambda *c: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in c))
    slots = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(_ATTEMPTS - 1))).alias("attempt"))
    first = text("a", F.expr("slot div 3").cast("string"), ":", n.cast("string"))
    second = text("b", F.substring(F.sha2(text("slot", k.cast("string")), 256), 1, 3), ":", (n % 3).cast("string"))
    taken = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(text("a", F.expr("o_custkey div 3").cast("string"), ":0").alias("key"))
    return slots.withColumn("keys", F.array(first, second)), taken


@query(
    f"WITH RECURSIVE {_ATTEMPTS_SQL}, o AS (SELECT slot, row_number() OVER (ORDER BY slot) AS i FROM (SELECT DISTINCT slot FROM a)), b AS (SELECT i, slot, attempt, keys FROM a JOIN o USING (slot)), "
    "r(i, held, slot, attempt, rejected) AS (SELECT 0::BIGINT, (SELECT list(key) FROM x), NULL::BIGINT, NULL::BIGINT, 0::BIGINT UNION ALL "
    "SELECT b.i, CASE WHEN min(CASE WHEN NOT list_has_any(b.keys, r.held) THEN b.attempt END) IS NULL THEN any_value(r.held) ELSE list_concat(any_value(r.held), arg_min(b.keys, b.attempt) FILTER (NOT list_has_any(b.keys, r.held))) END, any_value(b.slot), min(CASE WHEN NOT list_has_any(b.keys, r.held) THEN b.attempt END), "
    f"coalesce(min(CASE WHEN NOT list_has_any(b.keys, r.held) THEN b.attempt END), {_ATTEMPTS}) FROM r JOIN b ON b.i = r.i + 1 GROUP BY b.i) "
    "SELECT slot, attempt::INT AS attempt, rejected AS n_rejected, CASE WHEN attempt IS NULL THEN 'EXHAUSTED' ELSE 'ACCEPTED' END AS status FROM r WHERE i > 0"
)
def filled_slots(spark, sf_dir):
    """Each customer a slot of four attempts with two keys each; those of some orders are taken."""
    attempts, taken = _attempts(spark, sf_dir)
    return matching.first_free(attempts, taken).select("slot", "attempt", "n_rejected", "status")


_KEY = "sha256('limited:' || doc_id)"
_QUOTAS = [("en long", "lang = 'en' AND n_chars > 2000", 2), ("en", "lang = 'en'", 3), ("de", "lang = 'de'", 2), ("good", "quality = 1", 4), ("good de", "quality = 1 AND lang = 'de'", 1), ("short", "n_chars < 300", 2), ("toxic", "toxic = 1", 3), ("any", "true", 5)]


def _quota_sql() -> str:
    steps, before = ["d AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))", "g0 AS (SELECT lang, source, arg_min(doc_id, sha256('archetype:' || doc_id)) AS doc_id FROM d GROUP BY ALL)", "t0 AS (SELECT doc_id, 'representative' AS quota, 1 AS rank FROM g0)"], "t0"
    for i, (name, condition, size) in enumerate(_QUOTAS, 1):
        steps.append(f"p{i} AS (SELECT doc_id, '{name}' AS quota, row_number() OVER (ORDER BY {_KEY}, doc_id)::INT AS rank FROM d WHERE {condition} AND doc_id NOT IN (SELECT doc_id FROM {before}) QUALIFY row_number() OVER (ORDER BY {_KEY}, doc_id) <= {size})")
        steps.append(f"t{i} AS (SELECT * FROM {before} UNION ALL SELECT * FROM p{i})")
        before = f"t{i}"
    return f"WITH {', '.join(steps)} SELECT doc_id, quota, rank FROM {before}"


@query(_quota_sql())
def dependent_quotas(spark, sf_dir):
    """A representative of each language and source, then eight quotas, each over what those before it left."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(_t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return quotas.representatives_then(docs, ["lang", "source"], "doc_id", ("archetype", "limited"), [quotas.Quota(n, F.expr(c), k) for n, c, k in _QUOTAS])


_CASES = [
    quotas.CaseSlot("all right", right=("anchored", "direct", "untouched")), quotas.CaseSlot("all wrong", wrong=("anchored", "direct", "untouched")),
    quotas.CaseSlot("only anchored", right=("anchored",), wrong=("direct", "untouched")), quotas.CaseSlot("anchored lost", wrong=("anchored",), right=("direct", "untouched")), quotas.CaseSlot("impossible", right=("direct",), wrong=("direct",)),
]


@query(
    "$scored, e AS (SELECT record_id, bool_or(system_id = 'anchored' AND semantic_decision = 1) AS a, bool_or(system_id = 'direct' AND semantic_decision = 1) AS d, bool_or(system_id = 'untouched' AND semantic_decision = 1) AS u FROM s GROUP BY ALL), "
    "c(slot) AS (VALUES ('all right'), ('all wrong'), ('only anchored'), ('anchored lost'), ('impossible')), f AS (SELECT slot, record_id FROM c JOIN e ON CASE slot WHEN 'all right' THEN a AND d AND u WHEN 'all wrong' THEN NOT (a OR d OR u) WHEN 'only anchored' THEN a AND NOT d AND NOT u WHEN 'anchored lost' THEN NOT a AND d AND u ELSE false END) "
    "SELECT c.slot, arg_min(record_id, sha256('case:' || c.slot || ':' || record_id)) AS record_id, count(record_id) AS n_fitting FROM c LEFT JOIN f USING (slot) GROUP BY ALL"
)
def representative_cases(spark, sf_dir):
    return quotas.representative_cases(scored(spark, sf_dir).select("record_id", "system_id", "semantic_decision"), "record_id", "system_id", F.col("semantic_decision") == 1, ["anchored", "direct", "untouched"], _CASES, "case")


# --- Trajectories --------------------------------------------------------------------------------

_TOLERANCE = {"loss": (0.5, 1e-6), "tokens": (0.0, 0.0)}


def _zipped(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").cast("double").alias("loss"), F.col("o_custkey").alias("tokens"))
    other = orders.withColumn("loss", F.col("loss") + F.when(F.col("step") % 101 == 0, 0.75).when(F.col("step") % 13 == 0, 0.25).otherwise(0.0)).withColumn("tokens", F.col("tokens") + (F.col("step") % 997 == 5).cast("int"))
    return zipped.positional(orders, other, ["step"], ["step"], ["step", "loss", "tokens"])


_ZIPPED = (
    "a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey AS step, o_totalprice AS loss, o_custkey AS tokens, o_totalprice + CASE WHEN o_orderkey % 101 = 0 THEN 0.75::DOUBLE WHEN o_orderkey % 13 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS other, o_custkey + CASE WHEN o_orderkey % 997 = 5 THEN 1 ELSE 0 END AS others FROM orders), "
    "t AS (SELECT ordinal, 'both' AS presence, true AS same_step, loss = other AND tokens = others AS exact, abs(loss - other) AS loss_delta, abs(tokens - others)::DOUBLE AS tokens_delta, abs(loss - other) <= greatest(0.5, 1e-6 * greatest(abs(loss), abs(other))) AS loss_within, tokens = others AS tokens_within FROM a)"
)


@query(f"WITH {_ZIPPED} SELECT *, max(loss_delta) OVER (ORDER BY ordinal) AS loss_running_max, max(tokens_delta) OVER (ORDER BY ordinal) AS tokens_running_max FROM t")
def trajectory_steps(spark, sf_dir):
    """Two runs held together by place, with running maxima of their differences."""
    return zipped.trajectory(_zipped(spark, sf_dir), ["step"], _TOLERANCE)


@query(
    "WITH a AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, user_id AS step, value AS loss FROM events WHERE event_type = 'error'), b AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, user_id AS step, value AS loss FROM events WHERE event_type = 'signup'), "
    "z AS (SELECT coalesce(a.i, b.i) AS i, a.i IS NOT NULL AND b.i IS NOT NULL AND a.step IS NOT DISTINCT FROM b.step AS same, abs(a.loss - b.loss) AS delta FROM a FULL JOIN b ON a.i = b.i), f AS (SELECT min(CASE WHEN NOT same THEN i END) AS first_divergence FROM z) "
    "SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, first_divergence, first_divergence IS NULL AS ordered, false AS exact, false AS loss_within, "
    "CASE WHEN (SELECT count(*) FROM a) = (SELECT count(*) FROM b) THEN coalesce((SELECT max(delta) FROM z WHERE i < first_divergence), 0.0) ELSE 0.0 END AS loss_max_delta FROM f"
)
def trajectory_verdict(spark, sf_dir):
    """Two runs that part: lengths, the first place where they do, and nothing within tolerance."""
    ev = _t(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.col("user_id").alias("step"), F.col("value").alias("loss"))
    rows = zipped.positional(ev.where("event_type = 'error'"), ev.where("event_type = 'signup'"), ["ts", "event_id"], ["ts", "event_id"], ["step", "loss"])
    return zipped.trajectory_summary(zipped.trajectory(rows, ["step"], {"loss": (0.5, 1e-6)}), ["loss"])


# --- Stage machines ------------------------------------------------------------------------------

#: Over the kinds of events: a user signs up, views, clicks and buys; an error keeps the stage.
FUNNEL = machine.Machine.line(["signup", "view", "click", "purchase"], failed="error")
_FUNNEL_SQL = " ".join(f"WHEN s = '{a}' AND e = '{b}' THEN '{c}'" for (a, b), c in FUNNEL.legal.items())


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "
    f"r(user_id, i, s, bad, first) AS (SELECT DISTINCT user_id, 0::BIGINT, 'new', 0::BIGINT, NULL::BIGINT FROM e UNION ALL SELECT user_id, i, coalesce(t, s), bad + CASE WHEN t IS NULL THEN 1 ELSE 0 END, coalesce(first, CASE WHEN t IS NULL THEN i - 1 END) FROM (SELECT e.user_id, e.i, s, bad, first, CASE {_FUNNEL_SQL.replace(' e = ', ' e.event_type = ')} END AS t FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)) "
    f"SELECT user_id, arg_max(s, i) AS state, max(i) AS n_events, max(bad) AS n_illegal, min(first) AS first_illegal, CASE arg_max(s, i) {' '.join(f'''WHEN '{a}' THEN '{b}' ''' for a, b in FUNNEL.resume.items())} END AS resumes_at FROM r GROUP BY ALL"
)
def stage_runs(spark, sf_dir):
    return machine.runs(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", FUNNEL)


# --- Open JSON -----------------------------------------------------------------------------------


@query(
    "SELECT event_id, sha256('{\"a\":[{\"keep\":' || json_extract(props, '$.k')::VARCHAR || ',\"list\":[{},1]},' || CASE WHEN event_id % 3 = 0 THEN '[{}]' ELSE '[\"é\",{}]' END || '],\"b\":{}}') AS sha256 FROM events"
)
def stripped_digests(spark, sf_dir):
    """Digests of documents without two named fields, at the top, in objects of lists and in lists of lists."""
    k = F.get_json_object("props", "$.k")
    inner = F.when(F.col("event_id") % 3 == 0, '[{"content_sha256":1}]').otherwise('["é",{"content_sha256":[{"deep":2}]}]')
    text = F.concat(F.lit('{"b":{"latency_ms":3.5},"content_sha256":"x","a":[{"latency_ms":null,"keep":'), k, F.lit(',"list":[{"content_sha256":{"a":1}},1]},'), inner, F.lit("]}"))
    docs = _t(spark, sf_dir, "events").select("event_id", text.alias("j"))
    return openjson.content_digests(docs, "event_id", "j", ["content_sha256", "latency_ms"])


# --- Star joins and rollups ----------------------------------------------------------------------


@query(
    "WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS key, 1 AS d, 0 AS l, 0 AS e, n_chars AS n, NULL::INT AS q, NULL::INT AS t, NULL::INT AS c FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, 1, 0, NULL, quality, toxic, NULL FROM labels UNION ALL SELECT CAST(vec_id AS VARCHAR), 0, 0, 1, NULL, NULL, NULL, label FROM embeddings), "
    "g AS (SELECT key, sum(d) AS d, sum(l) AS l, sum(e) AS e, min(n) AS n, min(q) AS q, min(t) AS t, min(c) AS c FROM s GROUP BY ALL) "
    "SELECT code, count(*) AS n FROM g, LATERAL (VALUES ('MISSING_DOCUMENT', d = 0), ('MISSING_LABEL', l = 0), ('DUPLICATE_DOCUMENT', d > 1), ('DUPLICATE_LABEL', l > 1), ('DUPLICATE_VECTOR', e > 1), ('GOOD_BUT_SHORT', d = 1 AND l = 1 AND q = 1 AND n < 300), ('TOXIC_IN_FIRST_CLUSTERS', d = 1 AND l = 1 AND e > 0 AND t = 1 AND c < 4)) x(code, holds) WHERE holds GROUP BY ALL"
)
def star_findings(spark, sf_dir):
    """Documents, labels and vectors by one key: what is missing, repeated, or says something else."""
    sides = {"document": star.Side(_t(spark, sf_dir, "documents"), "doc_id", ("n_chars",)), "label": star.Side(_t(spark, sf_dir, "labels"), "doc_id", ("quality", "toxic")), "vector": star.Side(_t(spark, sf_dir, "embeddings"), "vec_id", ("label",))}
    lineage = {"GOOD_BUT_SHORT": (F.col("label.quality") == 1) & (F.col("document.n_chars") < 300), "TOXIC_IN_FIRST_CLUSTERS": (F.col("label.toxic") == 1) & (F.col("vector.label") < 4)}
    return star.findings(star.matched(sides), list(sides), lineage, ("vector",)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH o AS (SELECT o_orderstatus AS s, o_orderpriority AS p, floor(o_totalprice)::BIGINT AS v FROM orders), l AS (SELECT 'all' AS level, count(*) AS n, sum(v)::BIGINT AS total FROM o UNION ALL SELECT 'o_orderstatus:' || s, count(*), sum(v)::BIGINT FROM o GROUP BY s UNION ALL SELECT 'o_orderpriority:' || p, count(*), sum(v)::BIGINT FROM o GROUP BY p) "
    "SELECT * FROM l UNION ALL SELECT 'not ' || level, (SELECT n FROM l WHERE level = 'all') - n, (SELECT total FROM l WHERE level = 'all') - total FROM l WHERE level <> 'all'"
)
def rollups(spark, sf_dir):
    return star.rollups(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], {"n": F.lit(1).cast("long"), "total": F.floor("o_totalprice")})


@query(
    "WITH j AS (SELECT lang, toxic, n_chars, e.label AS cluster, url IS NULL AS without_url FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN embeddings e ON e.vec_id = d.doc_id JOIN pages p ON p.page_id = d.doc_id WHERE quality = 1) "
    "SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (n_chars > 1000) AS n_long, count(*) FILTER (cluster < 4) AS n_first_clusters, count(*) FILTER (without_url) AS n_without_url FROM j GROUP BY ALL"
)
def cohort_counts(spark, sf_dir):
    """Four sides by one key in one aggregation; of those that all match once, a cohort and its counts."""
    sides = {
        "candidate": star.Side(_t(spark, sf_dir, "documents"), "doc_id", ("lang", "n_chars")), "oracle": star.Side(_t(spark, sf_dir, "labels"), "doc_id", ("quality", "toxic")),
        "prediction": star.Side(_t(spark, sf_dir, "embeddings"), "vec_id", ("label",)), "filter": star.Side(_t(spark, sf_dir, "pages"), "page_id", ("url",)),
    }
    rows = star.complete(star.matched(sides), list(sides)).where("oracle.quality = 1")
    return rows.groupBy("candidate.lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("oracle.toxic") == 1).alias("n_toxic"), F.count_if(F.col("candidate.n_chars") > 1000).alias("n_long"), F.count_if(F.col("prediction.label") < 4).alias("n_first_clusters"), F.count_if(F.col("filter.url").isNull()).alias("n_without_url"),
    )


@query(
    "$scored, m AS (SELECT system_id, surface, count(*) AS n, avg(semantic_decision) AS semantic, count(*) FILTER (false_action) AS false_actions FROM s GROUP BY ALL) SELECT a.system_id AS system_id, a.n AS confirmatory_n, round(a.semantic, 6) AS confirmatory_semantic, b.n AS adversarial_n, round(b.semantic, 6) AS adversarial_semantic, b.false_actions AS adversarial_false_actions, round(b.semantic - a.semantic, 6) AS change FROM m a JOIN m b ON a.system_id = b.system_id AND a.surface = 'confirmatory' AND b.surface = 'adversarial'"
)
def system_profiles(spark, sf_dir):
    """Each system's figures on two surfaces side by side."""
    m = scored(spark, sf_dir, columns=["system_id", "surface", "semantic_decision", "false_action"]).groupBy("system_id", "surface").agg(F.count(F.lit(1)).alias("n"), F.avg("semantic_decision").alias("semantic"), F.count_if("false_action").alias("false_actions"))
    sides = {s: star.Side(m.where(F.col("surface") == s), "system_id", ("n", "semantic", "false_actions")) for s in ("confirmatory", "adversarial")}
    rows = star.complete(star.matched(sides, "system_id"), list(sides))
    return rows.select("system_id", F.col("confirmatory.n").alias("confirmatory_n"), F.round("confirmatory.semantic", 6).alias("confirmatory_semantic"), F.col("adversarial.n").alias("adversarial_n"), F.round("adversarial.semantic", 6).alias("adversarial_semantic"), F.col("adversarial.false_actions").alias("adversarial_false_actions"), F.round(F.col("adversarial.semantic") - F.col("confirmatory.semantic"), 6).alias("change"))


@query(
    "WITH k AS (SELECT source || ':' || sha256(text) AS key, count(*) AS r, count(quality) AS a FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL) SELECT code, count(*) AS n FROM k, LATERAL (VALUES ('DUPLICATE_RUN', r > 1), ('MISSING_ANALYSIS', a = 0), ('DUPLICATE_ANALYSIS', a > 1)) t(code, holds) WHERE holds GROUP BY ALL"
)
def run_index(spark, sf_dir):
    """Runs matched to an analysis by source and content hash: what is repeated or not analysed."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", "source", F.sha2("text", 256)).alias("key"))
    analysed = docs.join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    sides = {"run": star.Side(docs, "key", ("doc_id",)), "analysis": star.Side(analysed, "key", ("doc_id",))}
    return star.findings(star.matched(sides), list(sides), {}).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, '{\"at\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00\",\"user\":' || user_id || '}' AS json FROM events")
def iso_records(spark, sf_dir):
    """Rows as canonical JSON with their times as ISO text."""
    rows = _t(spark, sf_dir, "events").select("event_id", F.struct(iso_text(F.col("ts").cast("timestamp")).alias("at"), F.col("user_id").alias("user")).alias("r"))
    return rows.select("event_id", F.to_json("r").alias("json"))


_POOL = (
    "h AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), q AS (SELECT lang, source, CAST(n // 8 % 5 AS INT) AS quota FROM h), "
    "s AS (SELECT lang, source, lang || chr(31) || source || chr(31) || lpad(CAST(k AS VARCHAR), 10, '0') AS slot FROM (SELECT *, unnest(range(quota)) AS k FROM q)), "
    "a AS (SELECT slot, t.attempt, ['k' || substr(sha256(slot || ':' || t.attempt), 1, 2)] AS keys FROM s, (SELECT unnest(range(3)) AS attempt) t), x AS (SELECT DISTINCT 'k' || substr(sha256('x' || n_nationkey), 1, 2) AS key FROM nation)"
)


@query(
    f"WITH RECURSIVE {_POOL}, o AS (SELECT slot, row_number() OVER (ORDER BY slot) AS i FROM s), b AS (SELECT i, slot, attempt, keys FROM a JOIN o USING (slot)), "
    "r(i, held, slot, attempt) AS (SELECT 0::BIGINT, (SELECT list(key) FROM x), NULL::VARCHAR, NULL::BIGINT UNION ALL "
    "SELECT b.i, CASE WHEN min(CASE WHEN NOT list_has_any(b.keys, r.held) THEN b.attempt END) IS NULL THEN any_value(r.held) ELSE list_concat(any_value(r.held), arg_min(b.keys, b.attempt) FILTER (NOT list_has_any(b.keys, r.held))) END, any_value(b.slot), min(CASE WHEN NOT list_has_any(b.keys, r.held) THEN b.attempt END) FROM r JOIN b ON b.i = r.i + 1 GROUP BY b.i), "
    "f AS (SELECT lang, source, count(*) AS n FROM r JOIN s USING (slot) WHERE i > 0 AND attempt IS NULL GROUP BY ALL) "
    "SELECT t.finding, lang || '|' || source AS detail, n FROM f, (VALUES ('QUOTA_NOT_MET'), ('ATTEMPTS_EXHAUSTED')) t(finding)"
)
def pool_audits(spark, sf_dir):
    """Slots of each stratum's quota filled with retries, and the findings that would bar the pool."""
    counts = _t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    quota = counts.select("lang", "source", F.expr("cast(n div 8 % 5 as int)").alias("quota"))
    slots = matching.quota_slots(quota, ["lang", "source"], "quota", ["lang", "source"])
    attempts = slots.select("slot", F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("attempt"))
    key = lambda text: F.concat(F.lit("k"), F.substring(F.sha2(text, 256), 1, 2))
    attempts = attempts.withColumn("keys", F.array(key(F.concat_ws(":", "slot", F.col("attempt").cast("string")))))
    taken = _t(spark, sf_dir, "nation").select(key(F.concat(F.lit("x"), F.col("n_nationkey").cast("string"))).alias("key"))
    return matching.audits(matching.first_free(attempts, taken).join(slots, "slot"), quota, ["lang", "source"], "quota", taken)
