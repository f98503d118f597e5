from meridian.operators import scopes


def test_decode_scopes(spark):
    rows = spark.createDataFrame([(1, "BFAAA,CDB,EGAA,FF", ["foo"]), (2, "BAAA", []), (3, "CAA", []), (4, "BBAAC,CAA", ["a"]), (5, None, None)], "map_id int, scopes string, names array<string>")
    out = scopes.decode_scopes(rows).collect()
    one = [(r.what, r.start_line, r.start_col, r.end_line, r.end_col, r.name, r.is_stack_frame, r.definition) for r in out if r.map_id == 1]
    assert one == [("scope", 0, 0, 3, 1, "foo", True, None), ("range", 0, 0, 0, 5, None, True, 0)]
    assert {r.map_id: r.error for r in out if r.error} == {2: "UnclosedScope", 3: "UnmatchedScopeEnd", 4: "InvalidNameIndex"}
