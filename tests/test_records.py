"""Loosely typed records."""

from pyspark.sql import functions as F

from lodestack.functions import records


def test_normal_summary(spark):
    rows = [('{"note_title": " T ", "summary": "' + "s" * 400 + '", "key_points": "a, b\\nc,,d,e", "tags": ["x", "", 5, "' + "y" * 50 + '"]}',), ('{"note_title": "T"}',), ("no json",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(records.normal_summary("j")).collect()]
    assert (got[0]["note_title"], len(got[0]["summary"]), got[0]["key_points"], got[0]["error"]) == ("T", 300, ["a", "b", "c", "d"], None)
    assert got[0]["tags"] == ["x", "5", "y" * 40]
    assert all(g["error"] for g in got[1:]) and got[2]["key_points"] == [] and got[3]["note_title"] == ""


def test_errors(spark):
    df = spark.createDataFrame([("Bearer abc.def failed in /home/me/x with key k1", 401)], "m string, s int")
    assert df.select(records.sanitized_error("m", "k1")).first()[0] == "Bearer [removed] failed in [home]/x with key [removed]"
    cases = [(401, "", "auth"), (429, "", "rate limit"), (503, "", "unavailable"), (None, "Read timed out", "timeout"), (400, "", "protocol"), (None, None, "other")]
    got = spark.createDataFrame(cases, "s int, m string, w string").select("w", records.error_class(F.col("s"), F.col("m")).alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)


def test_last_message(spark):
    lines = ['{"type":"item.completed","item":{"type":"agent_message","text":"one"}}', "broken", '{"type":"item.completed","item":{"type":"agent_message","text":"two"}}', '{"type":"turn.completed","usage":{"input_tokens":3,"output_tokens":4}}']
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)] + [("s", 0, '{"type":"other"}')], "run_id string, seq int, line string")
    assert sorted(map(tuple, records.last_message(df).collect())) == [("r", "two", 3, 4), ("s", None, None, None)]
