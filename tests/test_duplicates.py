"""Removal of copies on hand-made rows: what stays, what moves, what is archived, and that nothing is lost."""

from emberlog.operators import duplicates as DU


def test_copies_labels_and_evidence(spark):
    raws = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "a", 30), (4, "b", 10), (5, "b", 20), (6, "c", 10), (7, None, 10), (8, None, 10)], "raw_id long, line_hash string, imported_us long")
    logs = spark.createDataFrame([(102, 2), (103, 3), (106, 6), (107, 7), (108, 8)], "log_id long, raw_id long")
    raw_map, log_map = DU.copies(raws, logs)
    # line a: the second copy is the first with a log; line b has no log at all
    assert {tuple(r) for r in raw_map.collect()} == {(1, 2), (3, 2), (5, 4)}
    assert [tuple(r) for r in log_map.collect()] == [(103, 102)]
    labels = spark.createDataFrame([(1, 102, 5), (2, 103, 25), (3, 103, 40), (4, 106, 9), (5, 107, 10)], "label_id long, log_id long, created_us long")
    got = {r.label_id: (r.log_id, r.state) for r in DU.label_moves(labels, log_map).collect()}
    assert got == {1: (102, "stays"), 2: (102, "archived"), 3: (102, "moves"), 4: (106, "stays"), 5: (107, "stays")}
    evidence = spark.createDataFrame([(1, 102), (1, 103), (2, 103), (2, 103), (3, 106)], "alert_id long, log_id long")
    assert {tuple(r) for r in DU.repointed(evidence, log_map).collect()} == {(1, 102), (2, 102), (3, 106)}
    assert {r.log_id for r in DU.removed(logs, log_map, "log_id").collect()} == {102, 106, 107, 108}
    plan = {r.measure: r.value for r in DU.plan(raws, raw_map, log_map, labels, evidence).collect()}
    assert plan == {"stored_lines": 8, "lines_stored_more_than_once": 2, "copies_to_remove": 3, "logs_to_remove": 1, "labels_to_move": 1, "labels_to_archive": 1, "evidence_rows_on_copies": 3, "alerts_citing_a_copy": 2}
    assert {r.label_id for r in DU.misattached(labels, logs, raws).collect()} == {1, 2, 4}


def test_third_of_rows_in_one_line(spark):
    raws = spark.range(900).selectExpr("id AS raw_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id AS string) END AS line_hash", "id AS imported_us")
    logs = spark.range(900).selectExpr("id + 1000 AS log_id", "id AS raw_id").filter("raw_id <> 0")
    raw_map, log_map = DU.copies(raws, logs)
    assert raw_map.count() == 299 and {r.kept_log for r in log_map.collect()} == {1003}
    none = DU.copies(raws.limit(0), logs.limit(0))
    assert none[0].count() == none[1].count() == 0
