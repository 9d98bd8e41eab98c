"""Bodies of unknown shape: values, errors wherever they stand, and rejects."""

from fieldloom.sources.bodies import outcomes, parsed


def test_bodies(spark):
    bodies = {
        1: '{"status":"success","values":{"A":2,"B":"x y"}}', 2: '{"status":"success","values":{}}', 3: '{"error":{"code":"C","message":"m"}}', 4: '{"status":"success","body":{"error":{"code":"D"}}}',
        5: '{"detail":[{"loc":["a"]}]}', 6: '{"detail":"no"}', 7: "[1, 2]", 8: "3", 9: "null", 10: '{"code":404}', 11: '{"a":1', 12: "", 13: None, 14: '{"a":1,"a":2}',
    }
    good, bad = parsed(spark.createDataFrame(list(bodies.items()), "i int, body string"))
    got = {r.i: tuple(r)[2:] for r in outcomes(good, ("A", "B")).collect()}
    error = ("error", "INTERNAL_ERROR")
    assert got == {
        1: ("success", None, None, "2", "x y"), 2: ("success", None, None, None, None), 3: ("error", "C", "m", None, None), 4: ("error", "D", None, None, None),
        5: (*error, None, None, None), 6: (*error, "no", None, None), 7: (*error, None, None, None), 8: (*error, None, None, None), 9: (*error, None, None, None), 10: (*error, None, None, None),
    }
    assert {(r.i, r.error_code) for r in bad.collect()} == {(i, "INVALID_REQUEST") for i in (11, 12, 13, 14)}
    assert outcomes(good.where("false"), ("A",)).count() == 0
