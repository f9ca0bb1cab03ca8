import pytest
from pyspark.sql import functions as F

from tidemark.functions import cells
from tidemark.functions.session import shared_folder
from tidemark.operators import entities, frames, incidents, quality
from tidemark.plans.views import levels


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_tokens_round_trip(spark):
    values = [(F.lit(-5).cast("int"), "int"), (F.lit(-(2**62)), "bigint"), (F.lit(None).cast("boolean"), "boolean"), (F.lit(-1).cast("smallint"), "smallint"), (F.lit(7), "timestamp")]
    token = cells.identity_token(values)
    assert one(spark, *cells.token_values(token, ["int", "bigint", "boolean", "smallint", "timestamp"])) == (-5, -(2**62), None, -1, 7)
    assert one(spark, *cells.token_values(token, ["bigint"])) == (None,)
    (text,) = one(spark, cells.identity_token([(F.lit("é?"), "string")]))
    assert text == "AQkDAAAAw6k_"


def test_hmac_of_the_standard(spark):
    assert one(spark, cells.hmac_sha256(b"Jefe", F.lit("what do ya want for nothing?"))) == ("5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843",)
    long = cells.hmac_sha256(b"\xaa" * 131, F.lit("Test Using Larger Than Block-Size Key - Hash Key First"))
    assert one(spark, long) == ("60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54",)


def test_sums_of_deltas_keep_the_last_reason(spark):
    x = lambda a, b: (F.lit(a).cast("bigint"), F.lit(b).cast("bigint"))
    reason = lambda parts, **k: one(spark, cells.delta_sum(parts, **k).alias("d"))[0].reason
    assert reason([x(5, 1), x(2, 2)]) is None
    assert reason([x(1, 5), x(2, None)]) == "missing"
    assert reason([x(2, None), x(1, 5)]) == "reset"
    assert reason([x(None, None)]) == "missing"
    assert reason([x(None, None), x(3, 1)], nullable=True) is None
    assert reason([x(5, 1)], pair=F.lit("gap")) == "gap"


def test_quantized_values(spark):
    code = lambda v, m: one(spark, cells.quantized(F.lit(v).cast("double"), F.lit(m).cast("double")))[0]
    assert [code(0, 0), code(1, 2), code(2, 2), code(None, 2)] == [0, 128, 255, None]


def test_a_cursor_must_be_a_row(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", None), ("d", 1)], "entity string, v int")
    page = lambda *c: [r.entity for r in frames.frame_page(df, "v", True, "entity", 10, c).collect()]
    assert page(3, "a") == ["b", "d", "c"]
    assert page(None, "c") == []
    assert [r.entity for r in frames.frame_page(df, "v", False, "entity", 10, (1, "d")).collect()] == ["a", "b", "c"]
    with pytest.raises(Exception, match="no row of the frame"):
        page(2, "a")


def test_columns_that_a_layout_lacks_are_not_applicable(spark):
    rows = spark.createDataFrame([(1, 1, 10, 500_000.0)], "datid int, relid int, ts long, n_mod_since_analyze double")
    got = {r.column: (r.level, r.reason) for r in levels(rows, "tables", 10).collect()}
    assert got["n_ins_since_vacuum"] == (None, "not_applicable")
    assert got["n_mod_since_analyze"] == ("warning", None)


def test_gaps_touch_but_do_not_meet(spark):
    rows = spark.createDataFrame([(1, 10), (1, 20), (1, 30), (1, 40)], "k int, ts long")
    gaps = spark.createDataFrame([(1, 20, 30), (1, 40, 50), (2, 0, 99)], "k int, gap_from long, gap_to long")
    got = {r.ts: r.in_gap for r in quality.pairs_in_gaps(rows, gaps, ["k"]).collect()}
    assert got == {10: False, 20: False, 30: True, 40: False}


def test_relations_of_objects(spark):
    left = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 9)], "id int, k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, x string")
    got = sorted(tuple(r) for r in entities.object_relation(left, right, ["k"], ["x"], True).select("id", "x", "relation").collect())
    assert got == [(1, "a", "one"), (2, None, "many"), (3, None, "no_key"), (4, None, "none")]


def test_findings_of_any_measure(spark):
    rule = next(r for r in incidents.RULES if r.id == "PG-SLOT-016")
    rows = spark.createDataFrame([(1, "s", 1, 50, 1000, 100, 1), (1, "s", 2, 90, 1000, 100, 1), (1, "t", 1, 90, 1000, 100, 1), (1, "t", 2, 80, 1000, 100, 1), (1, "u", 1, 1, 1, 1, 5)], "cluster int, slot string, ts long, retained_bytes long, safe_wal_size long, max_keep_bytes long, status int")
    assert [(r.entity, r.value) for r in incidents.findings(rows, rule, ["cluster"], ["slot"]).collect()] == [('{"slot":"s"}', 0.9)]
    assert incidents.evaluate({}, ["cluster"]) is None


def test_a_cluster_needs_a_shared_folder(spark):
    class Remote:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Remote())
    assert shared_folder(spark)
