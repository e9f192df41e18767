import json
import random
from itertools import permutations

import __spark_entry__
from tonearm.operators import drift

SCHEMA = "feed_id string, batch_no int, track_ref bigint, payload string, frames string"


def _dumps(spark, rows):
    return spark.createDataFrame([(f, n, t, p if p is None or isinstance(p, str) else json.dumps(p), "x") for f, n, t, p in rows], SCHEMA)


def _two_files(spark):
    files = {
        3: [(1, {"TYER": "1999", "A": "x", "B": 1, "C": None}), (2, {"TYER": "2001", "A": "y", "B": 2})],
        7: [(1, {"YEAR": 1999, "B": "1", "D": "x1"}), (2, {"YEAR": 2001, "B": "2"}), (2, {"YEAR": 2001, "B": "2"})],
    }
    rows = [("f", n, t, p) for n, records in files.items() for t, p in records]
    rows += [("g", 1, 1, {"OTHER": 1}), (None, 1, 1, {"A": 1}), ("f", None, 1, {"A": 1}), ("g", 2, 1, None), ("g", 2, 2, "no json"), ("g", 2, None, {"OTHER": 1})]
    return _dumps(spark, rows)


def test_changes_between_files(spark):
    got = {tuple(r) for r in drift.changes(_two_files(spark)).collect()}
    assert got == {("f", 7, "renamed", "TYER", "YEAR"), ("f", 7, "removed", "A", ""), ("f", 7, "removed", "C", ""), ("f", 7, "added", "D", ""), ("f", 7, "retyped", "B", "")}
    assert drift.changes(_two_files(spark).limit(0)).count() == 0


def test_consistent_table(spark):
    rows = {(r.feed_id, r.batch_no, r.track_ref): r.frames for r in drift.consistent(_two_files(spark)).collect() if r.feed_id == "f" and r.batch_no}
    assert rows["f", 3, 1] == {"YEAR": "1999", "A": "x", "B": "1", "C": None}
    assert rows["f", 7, 2] == {"YEAR": "2001", "B": "2"}
    # a name that is used again after its rename, and two renames in a row
    v = lambda n: [(t, f"value {t}") for t in range(4)]
    rows = [("f", 1, t, {"A": x}) for t, x in v(1)] + [("f", 2, t, {"B": x}) for t, x in v(2)] + [("f", 3, t, {"C": x, "A": "new"}) for t, x in v(3)]
    got = {(r.batch_no, r.track_ref): r.frames for r in drift.consistent(_dumps(spark, rows)).collect()}
    assert got[1, 0] == got[2, 0] == {"C": "value 0"} and got[3, 1] == {"C": "value 1", "A": "new"}


def test_nested_fields_and_moves(spark):
    rows = [("f", 1, t, {"COM": {"lang": "x", "text": f"t{t}"}, "N": f"n{t}"}) for t in range(3)] + [("f", 2, t, {"COM": {"lng": "x", "text": f"t{t}", "n": f"n{t}"}}) for t in range(3)]
    got = {(r.change_kind, r.frame_id, r.new_frame_id, r.depth) for r in drift.scripts(_dumps(spark, rows)).collect()}
    assert got == {("renamed", "COM/lang", "COM/lng", 1), ("removed", "N", "", 0), ("added", "COM/n", "", 1), ("moved", "N", "COM/n", 0)}


def test_fields_of_a_renamed_frame(spark):
    rows = [("f", 1, t, {"COM": {"text": f"t{t}", "lang": "x"}}) for t in range(3)] + [("f", 2, t, {"COMM": {"text": f"t{t}"}, "L": "x"}) for t in range(3)]
    got = {(r.change_kind, r.frame_id, r.new_frame_id) for r in drift.scripts(_dumps(spark, rows)).collect()}
    assert got == {("renamed", "COM", "COMM"), ("removed", "COM/lang", ""), ("added", "L", ""), ("moved", "COM/lang", "L")}


def test_matching_is_cheapest():
    rnd = random.Random(3)
    for n in (1, 2, 4, 6):
        for _ in range(20):
            cost = [[rnd.randint(0, 9) for _ in range(n)] for _ in range(n)]
            best = min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))
            assert sum(cost[i][j] for i, j in enumerate(drift.matching(cost))) == best


def test_registered():
    assert {"p3_found", "p3_scripts", "p3_table"} <= __spark_entry__.queries().keys()
