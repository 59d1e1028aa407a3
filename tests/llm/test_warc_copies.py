"""Damage in groups of equal records, and records that only a replica has."""

from foliospark.llm import warc

PAGES = "page_id long, url string, html string"


def frame(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_audit_sees_lost_and_damaged_copies(spark):
    rows = [(i, "u", "h") for i in range(40)] + [(7, "u", "h")] * 9
    pages = frame(spark, rows)
    lost = warc.audit(pages, frame(spark, rows[:41]), file_records=64).collect()
    assert {(r["page_id"], r["copies"]) for r in lost if r["corrupt"]} == {(7, 10)}
    damaged = warc.audit(pages, frame(spark, [*rows[:-1], (7, "u", "x")]), file_records=64).collect()
    assert 7 in {r["page_id"] for r in damaged if r["corrupt"]}


def test_fixity_flags_only_what_differs(spark):
    rows = [(i, "u", "h") for i in range(300)] + [(7, "u", "h")] * 9 + [(8, "u", str(k)) for k in range(50)] + [(None, None, None)]
    replica = [r for r in rows if r[0] != 20]
    replica[-1] = (None, None, "x")
    replica.remove((7, "u", "h"))
    replica += [(9, "u", "extra"), (8, "u", "3")]
    for files in (1, 64):
        got = warc.fixity(frame(spark, rows), frame(spark, replica), file_records=files).collect()
        bad = {(r["page_id"], r["copies"], r["replica_copies"], r["record_no"] is None) for r in got if r["corrupt"]}
        assert bad == {(20, 1, 0, False), (7, 10, 9, False), (8, 1, 2, False), (9, 0, 1, True), (None, 1, 0, False), (None, 0, 1, True)}
        assert sum(r["copies"] for r in got) == len(rows) and sum(r["replica_copies"] for r in got) == len(replica)


def test_fixity_of_empty_sides(spark):
    pages = frame(spark, [(i, "u", "h") for i in range(50)])
    assert not [r for r in warc.fixity(pages, pages).collect() if r["corrupt"]]
    assert all(r["corrupt"] and r["replica_copies"] == 0 for r in warc.fixity(pages, pages.limit(0)).collect())
    added = warc.fixity(pages.limit(0), pages).collect()
    assert len(added) == 50 and all(r["corrupt"] and r["copies"] == 0 for r in added)
