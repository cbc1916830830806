import json

import pytest
from pyspark.sql import functions as F

from hitloom.plans import jobs, star_tables
from hitloom.plans.migration import migrate, quarantined, total_rows
from hitloom.schema import LEGACY, LEGACY_COLUMNS
from hitloom.sources.legacy import read_legacy


def row(**changes):
    usual = dict(zip(LEGACY_COLUMNS, ("05-Jan-2024:00:03:52", "1.1.1.1", "GET", "/x/", "200", "10", "r/", "UA", "u", "a")))
    return tuple({**usual, **changes}[c] for c in LEGACY_COLUMNS)


def test_migration(spark, tmp_path):
    rows = [
        row(),
        row(date=""),
        row(date=None),
        row(httpMethod="", requestURI="/empty"),
        row(httpMethod="\\x16{", requestURI="/a.js"),
        row(requestURI="/s.xml"),
        row(date="31-Feb-2024:00:00:00", requestURI="/bad"),
        row(remoteUser=None, requestURI="/null"),
    ]
    spark.createDataFrame(rows, LEGACY).write.parquet(str(tmp_path / "old"))
    legacy = read_legacy(spark, str(tmp_path / "old"))
    assert total_rows(legacy).first()[0] == len(rows)
    got = {r["request_uri"]: r for r in migrate(legacy).filter("non_default = ''").collect()}
    assert set(got) == {"/x/", "/empty", "/null"}
    assert got["/x/"]["date"] == "2024-01-05 00:03:52"
    assert (got["/x/"]["referrer"], got["/x/"]["remote_user"], got["/x/"]["authenticated_user"]) == ("r/", "u", "a")
    assert got["/empty"]["http_method"] == "Invalid"
    assert got["/null"]["remote_user"] == ""
    kept = [json.loads(r["non_default"]) for r in quarantined(migrate(legacy)).collect()]
    assert sorted(k["requestURI"] for k in kept) == ["/a.js", "/bad"]
    assert all(r["remote_ip"] == "" for r in migrate(legacy).filter("non_default <> ''").collect())


def test_the_older_table_as_csv(spark, tmp_path):
    path = str(tmp_path / "csv")
    spark.createDataFrame([row(), row(userAgent='a "quoted", agent')], LEGACY).write.csv(path, header=True, escape='"')
    legacy = read_legacy(spark, path, "csv", header="true", escape='"')
    assert sorted(r["userAgent"] for r in legacy.collect()) == ["UA", 'a "quoted", agent']
    assert migrate(legacy).filter("non_default = ''").count() == 2



def test_chunks_go_on_after_a_failure(spark, tmp_path, monkeypatch):
    numbers = [*range(40), None, None, 7, 7]
    rows = [(n, *row(requestURI=f"/{i}")) for i, n in enumerate(numbers)]
    old = spark.createDataFrame(rows, "row_no bigint, " + ", ".join(f"{c} string" for c in LEGACY_COLUMNS))
    path, store = str(tmp_path / "star"), jobs.migrate_table
    calls = []

    def failing(*args, **kwargs):
        calls.append(args[-1])
        if len(calls) == 3:
            raise RuntimeError("lost")
        return store(*args, **kwargs)

    monkeypatch.setattr(jobs, "migrate_table", failing)
    with pytest.raises(RuntimeError):
        jobs.migrate_in_chunks(old, path, chunk_rows=10)
    assert 0 < star_tables.stored_fact(spark, path).count() < len(rows)
    # Other sizes don't matter once chunks are planned.
    left = jobs.migrate_in_chunks(old, path, chunk_rows=3, most_chunks=1)
    assert left == 2 and jobs.migrate_in_chunks(old, path) == 0 and jobs.migrate_in_chunks(old, path) == 0
    assert sorted(calls) == [0, 1, 2, 2, 3, 4]
    uris = star_tables.stored_totals(spark, path).filter("dim = 'request_uri'").collect()
    assert sorted((r["value"], r["count"]) for r in uris) == sorted((f"/{i}", 1) for i in range(len(rows)))
    assert star_tables.stored_last_row(spark, path).first()["request_uri"] == "/39"
    with pytest.raises(ValueError, match="changed"):
        jobs.migrate_in_chunks(old.filter(F.col("row_no") != 5), path)
    empty = str(tmp_path / "empty")
    assert jobs.migrate_in_chunks(old.limit(0), empty) == 0 and star_tables.stored_fact(spark, empty).count() == 0
