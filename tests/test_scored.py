import json

from pyspark.sql import functions as F

from assay.functions.compare import equal
from assay.functions.contract import plain_fields
from assay.functions.jsontext import strict_value, strip
from assay.operators.score import parse
from assay.plans import routing
from assay.plans.scored import scored

SF = "/root/testdata/sf0.001"


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """A file cut into many ranges whose rows all lie in one: the outputs still go to many tasks."""
    spark.read.parquet(f"{SF}/orders.parquet").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{SF}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        used = routing.predictions(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert used >= spark.sparkContext.defaultParallelism


def test_only_asked_columns_are_written(spark):
    rows = scored(spark, SF, columns=["system_id", "classification"])
    assert rows.columns == ["system_id", "classification"]
    assert rows.count() == 3 * spark.read.parquet(f"{SF}/orders.parquet").count()


def test_strip_and_strict_values(spark):
    spaces = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not 0x1C <= ord(c) <= 0x1F)
    texts = [spaces + "{}" + spaces, "[1],[2]", "1],[2", '{"a":"]"}', "{}]", "1,2", "", "{} {}", "​{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.j for r in df.select("i", F.to_json(strict_value(strip(F.col("t")))).alias("j")).orderBy("i").collect()]
    assert got == ["{}", None, None, '{"a":"]"}', None, None, None, None, None]


def test_numbers_of_two_kinds_differ(spark):
    pairs = [("1", "1.0", False), ("1", "1", True), ('"1"', "1", False), (None, None, True), ("[1]", "[1]", True), ("null", None, False)]
    df = spark.createDataFrame([(json.dumps(i), a, b) for i, (a, b, _) in enumerate(pairs)], "i string, a string, b string")
    got = [r.e for r in df.select("i", equal(F.try_parse_json("a"), F.try_parse_json("b")).alias("e")).orderBy("i").collect()]
    assert got == [e for _, _, e in pairs]


def _contract(**changed):
    fields = {"decision": "execute", "tool": "refund_payment", "arguments": {"amount_minor": 5, "currency": "USD", "payment_id": "P1"}, "approval_required": False, "policy_code": "A-01", "reason_code": "R_1"} | changed
    return json.dumps({k: v for k, v in fields.items() if v is not ...}, separators=(",", ":"))


_PAY = {"amount_minor": 5, "currency": "USD", "payment_id": "P1"}
_TEXTS = [
    _contract(), _contract(arguments=_PAY | {"amount_minor": 0}), _contract(arguments=_PAY | {"amount_minor": -1}), _contract(arguments=_PAY | {"amount_minor": 5.0}), _contract(arguments=_PAY | {"amount_minor": 10**17}), _contract(arguments=_PAY | {"amount_minor": 10**30}),
    _contract(arguments=_PAY | {"amount_minor": "5"}), _contract(arguments=_PAY | {"payment_id": ""}), _contract(arguments=_PAY | {"payment_id": "a,b:c}"}), _contract(arguments=_PAY | {"payment_id": 'q"\\'}), _contract(arguments=_PAY | {"payment_id": None}), _contract(arguments=_PAY | {"currency": True}), _contract(arguments=_PAY | {"x y": [1]}),
    _contract(arguments={"payment_id": "P1", "currency": "USD", "amount_minor": 5}), _contract(arguments={}), _contract(arguments={f"k{i}": i for i in range(20)}), _contract(arguments=[]), _contract(arguments=None), _contract(arguments=...), _contract().replace('"currency":"USD"', '"currency":"USD","currency":"USD"'),
    _contract().replace("5", "-0"), _contract().replace("5", "05"), _contract().replace("5", "5e1"), _contract().replace(":", ": ").replace(",", ", "), _contract().replace("A-01", "A\t01"), _contract().replace("A-01", "A\\t01"), _contract().replace("A-01", "Ä€\U0001f600"), _contract(policy_code=""), _contract(policy_code=7), _contract(reason_code=None),
    _contract(tool=None), _contract(tool=None, arguments={}), _contract(tool=None, arguments={}, decision="refuse"), _contract(tool="null"), _contract(tool="other"), _contract(tool=1), _contract(decision="maybe"), _contract(decision=3), _contract(decision="request_approval"), _contract(decision="request_approval", approval_required=True), _contract(approval_required="false"), _contract(note=1),
    _contract(tool="pause_subscription", arguments={"subscription_id": "S", "pause_days": 30}), _contract(tool="pause_subscription", arguments={"subscription_id": "S", "pause_days": 31}), _contract(tool="offer_retention", arguments={"offer_code": "SAVE10_3MO", "subscription_id": "S"}), _contract(tool="cancel_subscription", arguments={"subscription_id": "S", "effective_mode": "immediate"}), _contract(tool="escalate_fraud_review", arguments={"customer_id": "C", "payment_id": "P"}),
    _contract() + "}", _contract() + "]", _contract()[:-1], "[" + _contract() + "]", "{}",
]


def test_plain_contracts_are_read_as_others(spark):
    """What the text alone shows is what opening the object gives: two spaces more send a text to the general way."""
    wide = [t.replace("{", "{  ", 1) for t in _TEXTS]
    df = spark.createDataFrame([(i, w, t) for i, pair in enumerate(zip(_TEXTS, wide)) for w, t in enumerate(pair)], "i int, w int, raw_output string")
    plain = df.select("i", "w", plain_fields(F.col("raw_output")).isNotNull().alias("p")).where("p").select("w").collect()
    assert {r.w for r in plain} == {0} and len(plain) > 20
    got = parse(df).drop("raw_output", "candidate")
    rows = {(r.i, r.w): {c: sorted(v) if isinstance(v, list) and c != "errors" else v for c, v in r.asDict().items() if c != "w"} for r in got.collect()}
    for i, text in enumerate(_TEXTS):
        assert rows[i, 0] == rows[i, 1], text
    valid = {i for i in range(len(_TEXTS)) if rows[i, 0]["classification"] == "STRICT_VALID"}
    assert valid == {0, 1, 4, 13, 23, 25, 26, 32, 39, 42, 44, 45, 46} | {i for i, t in enumerate(_TEXTS) if '"amount_minor":-0' in t} | {8, 9}


def test_scoring_opens_no_value_of_a_plain_contract(spark):
    """JSON is parsed only below a test of `_plain`."""
    df = spark.createDataFrame([(0, _contract())], "i int, raw_output string")
    assert "CASE WHEN isnull(_plain" in parse(df).select("classification")._jdf.queryExecution().optimizedPlan().toString()
