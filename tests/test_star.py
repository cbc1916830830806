import datetime
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hitloom.operators import counts, failures, star
from hitloom.operators.lookups import skew_proof_lookup
from hitloom.operators.records import parse_lines, without_assets
from hitloom.operators.resume import resume_after
from hitloom.plans import jobs, reports, star_tables
from hitloom.schema import DIMENSIONS, FACT_FIELDS
from hitloom.sources import access_log
from hitloom.workloads import inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    lines = inputs.log_lines(spark, SF).filter("value <> ''")
    return without_assets(parse_lines(lines)).cache()


def as_counts(df):
    return {(r["dim"], r["value"]): r["count"] for r in df.collect()}


def test_counts_agree_with_a_plain_loop(kept):
    wanted = Counter((d, r[d]) for r in kept.collect() for d in DIMENSIONS if r[d])
    assert as_counts(counts.count_values(kept)) == dict(wanted)


def test_rejects_are_counted_but_are_no_facts(kept):
    totals = counts.count_values(kept, ["remote_ip"]).agg(F.sum("count")).first()[0]
    assert totals > star.fact_rows(kept).count()


def test_merge_of_parts_is_the_whole(kept):
    odd = F.col("line_no") % 2 == 1
    merged = counts.merge_counts(
        counts.count_values(kept.filter(odd)), counts.count_values(kept.filter(~odd))
    )
    assert as_counts(merged) == as_counts(counts.count_values(kept))


@pytest.mark.parametrize("small", [star.SMALL_DIMENSION, 0])
def test_roundtrip(spark, kept, tmp_path, monkeypatch, small):
    monkeypatch.setattr(star, "SMALL_DIMENSION", small)
    star_tables.write_batch(kept, str(tmp_path))
    back = star.read_back(
        star_tables.stored_fact(spark, str(tmp_path)), star_tables.stored_dimensions(spark, str(tmp_path))
    ).select("position.seq", *FACT_FIELDS)
    wanted = kept.filter("non_default = ''").select("line_no", *FACT_FIELDS)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wanted.collect()))


def test_a_repeated_batch_changes_nothing_and_an_unfinished_one_is_not_seen(spark, kept, tmp_path):
    path = str(tmp_path)
    half = F.col("line_no") < 500
    assert star_tables.write_batch(kept.filter(half), path, 0)
    assert star_tables.write_batch(kept.filter(~half), path, 1)
    assert not star_tables.write_batch(kept.filter(~half), path, 1)
    whole = as_counts(counts.count_values(kept))
    assert as_counts(star_tables.stored_totals(spark, path)) == whole
    star.with_keys(counts.count_values(kept)).write.partitionBy("dim").parquet(f"{path}/counts/batch=unfinished")
    assert as_counts(star_tables.stored_totals(spark, path)) == whole
    assert star_tables.compact_counts(spark, path) == 2
    read = star_tables.stored_counts(spark, path)
    assert as_counts(read) == whole and all("base-" in name for name in read.inputFiles())
    assert star_tables.write_batch(kept.filter(half), path, 0, run="again")
    assert as_counts(star_tables.stored_totals(spark, path)) == as_counts(
        counts.merge_counts(counts.count_values(kept), counts.count_values(kept.filter(half)))
    )


def test_a_failed_replay_of_a_committed_batch_loses_nothing(spark, kept, tmp_path):
    path = str(tmp_path)
    star_tables.write_batch(kept, path, 0)
    facts, totals = star_tables.stored_fact(spark, path).count(), as_counts(star_tables.stored_totals(spark, path))
    broken = kept.withColumn("user_agent", F.raise_error(F.lit("lost")).cast("string"))
    assert not star_tables.write_batch(broken, path, 0)
    with pytest.raises(Exception, match="lost"):
        star_tables.write_batch(broken, path, 1)
    assert star_tables.stored_fact(spark, path).count() == facts
    assert as_counts(star_tables.stored_totals(spark, path)) == totals
    assert star_tables.write_batch(kept, path, 1)
    assert star_tables.stored_fact(spark, path).count() == 2 * facts


def test_an_empty_store(spark, tmp_path):
    path = str(tmp_path / "none")
    assert star_tables.stored_totals(spark, path).count() == star_tables.stored_fact(spark, path).count() == 0
    assert star_tables.compact_counts(spark, path) == 0


def test_colliding_keys_fail(spark, kept, tmp_path, monkeypatch):
    monkeypatch.setattr(star, "value_key", lambda value: F.encode(F.length(value).cast("string"), "UTF-8"))
    with pytest.raises(Exception, match="two values share a key"):
        star.checked_dimensions(counts.count_values(kept)).collect()
    star_tables.write_batch(kept, str(tmp_path))
    with pytest.raises(Exception, match="two values share a key"):
        star_tables.stored_dimensions(spark, str(tmp_path)).collect()


def test_the_stored_failure_report_reads_its_days_and_does_not_move_the_fact(spark, kept, tmp_path):
    star_tables.write_batch(kept, str(tmp_path))
    report = reports.stored_report(spark, str(tmp_path), "top_unsuccessful", 3, "2024-02-10")
    text = report._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*day#\d+ >= 2024-01-11", text)
    assert not re.search(r"Exchange hashpartitioning\((http_method_id|day|commit)#", text)


def test_log_jobs_store_what_is_new(spark, tmp_path):
    path, log = str(tmp_path / "star"), str(tmp_path / "log")
    lines = inputs.log_lines(spark, SF).coalesce(1).sortWithinPartitions("line_no")
    jobs.migrate_table(inputs.legacy_rows(spark, SF), path)
    old = star_tables.stored_fact(spark, path).count()
    access_log.land_lines(lines.filter("line_no < 400"), f"{log}/a")
    assert jobs.ingest_batch(spark, f"{log}/*", path, 0)
    assert not jobs.ingest_batch(spark, f"{log}/*", path, 0)
    access_log.land_lines(lines.filter("line_no >= 400"), f"{log}/b")
    assert jobs.ingest_batch(spark, f"{log}/*", path, 1)
    assert jobs.ingest_batch(spark, f"{log}/*", path, 2)
    whole = without_assets(parse_lines(access_log.read_log_lines(spark, f"{log}/*")))
    assert star_tables.stored_fact(spark, path).count() - old == whole.filter("non_default = ''").count()


def test_both_ways_to_the_failure_report_agree(spark, kept, tmp_path):
    star_tables.write_batch(kept, str(tmp_path), 0)
    stored = reports.top_unsuccessful_stored(
        star_tables.stored_fact(spark, str(tmp_path)),
        star_tables.stored_counts(spark, str(tmp_path)),
        1000,
        "2024-02-10",
    )
    direct = reports.top_unsuccessful(kept, 1000, "2024-02-10")
    assert stored.collect() == direct.collect() != []


def test_failures_by_day_add_up_over_batches_and_compaction(spark, kept, tmp_path):
    path = str(tmp_path)
    part = F.col("line_no") % 3
    for batch in range(2):
        star_tables.write_batch(kept.filter(part == batch), path, batch)
    star_tables.compact_counts(spark, path)
    star_tables.write_batch(kept.filter(part == 2), path, 2)
    wanted = {}
    for r in kept.filter("ts is not null").collect():
        digits = re.match(r"\s*([+-]?[0-9]+)", r["status_code"])
        failed = not 200 <= int(digits[1] if digits else 0) <= 399
        if r["http_method"] == "GET" and failed and r["request_uri"] and r["user_agent"]:
            wanted.setdefault((r["ts"].date(), r["status_code"], r["request_uri"]), []).append(r["user_agent"])
    keys = {r["key"]: r["uri"] for r in kept.select(F.col("request_uri").alias("uri"), star.value_key(F.col("request_uri")).alias("key")).collect()}
    groups = failures.merged(star_tables.stored_failures(spark, path), *failures.GROUP).collect()
    got = {(r["day"], r["status_code"], keys[r["request_uri_id"]]): (r["count"], r["user_agent"]) for r in groups}
    assert got == {group: (len(agents), min(agents)) for group, agents in wanted.items()} and len(got) == len(groups) > 0
    for n in (1, 3, 1000):
        report = reports.stored_report(spark, path, "top_unsuccessful", n, "2024-02-10")
        assert sorted(map(tuple, report.collect())) == sorted(map(tuple, reports.run_report(kept, "top_unsuccessful", n, "2024-02-10").collect()))
    files = report.inputFiles()
    assert not any("/fact/" in name for name in files) and any("/failures/" in name for name in files)


def test_failures_of_an_empty_batch_and_an_empty_store(spark, kept, tmp_path):
    path = str(tmp_path)
    assert star_tables.stored_failures(spark, path).count() == 0
    star_tables.write_batch(kept.limit(0), path, 0)
    assert star_tables.compact_counts(spark, path) == 1
    assert star_tables.stored_failures(spark, path).count() == 0
    assert reports.stored_report(spark, path, "top_unsuccessful", 3, "2024-02-10").collect() == []
    assert star_tables.stored_last_row(spark, path).collect() == []


def test_the_stored_last_row_reads_one_batch_and_no_fact(spark, kept, tmp_path):
    path = str(tmp_path)
    good = kept.filter("non_default = ''")
    for batch, part in enumerate((good.filter("line_no >= 500"), good.filter("line_no < 500"), kept.filter("non_default <> ''"))):
        star_tables.write_batch(part, path, batch)
    last = star_tables.stored_last_row(spark, path)
    wanted = good.filter("line_no < 500").orderBy(F.desc("line_no")).first()
    assert [tuple(r) for r in last.collect()] == [tuple(wanted[f] for f in star.LAST_ROW_FIELDS)]
    counts_read = star.last_row(star_tables.stored_fact(spark, path), star_tables.stored_counts(spark, path))
    assert counts_read.collect() == last.collect()
    assert all("/counts/batch=000000000001-" in name for name in last.inputFiles()) and last.inputFiles()


def test_a_batch_parses_its_records_once_and_holds_nothing_afterwards(spark, kept, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = kept.count()
    star_tables.write_batch(kept.mapInPandas(counted, kept.schema), str(tmp_path))
    assert seen.value == rows
    held = [r.name() for r in spark.sparkContext._jsc.getPersistentRDDs().values()]
    broken = kept.withColumn("user_agent", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        star_tables.write_batch(broken, str(tmp_path), 1)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == len(held)


def test_the_window_includes_its_first_midnight(spark, lines_of):
    text = '1.1.1.1 - - [{} +0000] "GET /x HTTP/1.1" 500 1 "-" "UA"'
    records = parse_lines(
        lines_of(*[text.format(d) for d in ("11/Jan/2024:00:00:00", "10/Jan/2024:23:59:59", "01/Jan/2030:00:00:00")])
    )
    assert [tuple(r) for r in reports.top_unsuccessful(records, 5, "2024-02-10").collect()] == [
        ("/x with user agent UA", 2)
    ]


def test_a_stored_field_report_reads_one_field(spark, kept, tmp_path):
    star_tables.write_batch(kept, str(tmp_path), 0)
    report = reports.stored_report(spark, str(tmp_path), "top_uris", 3)
    text = report._jdf.queryExecution().executedPlan().toString()
    assert "(dim#" in text.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert report.collect() == reports.run_report(kept, "top_uris", 3).collect()


def test_the_default_window_ends_today_in_utc(spark):
    wanted = datetime.datetime.now(datetime.timezone.utc).date() - datetime.timedelta(days=30)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Pacific/Kiritimati", "Pacific/Pago_Pago"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            (got,) = spark.range(1).select(reports.window_start()).first()
            assert abs((got - wanted).days) == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_report_names_and_sizes(kept):
    with pytest.raises(ValueError):
        reports.run_report(kept, "nope")
    with pytest.raises(ValueError):
        reports.run_report(kept, "top_ips", 0)
    short = reports.run_all_reports(kept, 2, "2024-02-10").collect()
    long = reports.run_all_reports(kept, 1001, "2024-02-10").filter("rank <= 2").collect()
    assert sorted(map(tuple, short)) == sorted(map(tuple, long))
    assert [r["rank"] for r in reports.run_report(kept, "top_ips", 4).orderBy("rank").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("share", [1 / 2_000, 0.2, 2.0])
def test_lookup_with_hot_and_missing_keys(spark, monkeypatch, share):
    monkeypatch.setattr("hitloom.operators.lookups.HOT_SHARE", share)
    keys = [1] * 400 + [None] * 300 + list(range(2, 100)) + [1000]
    rows = spark.createDataFrame(list(enumerate(keys)), "n bigint, k bigint")
    weights = Counter(k for k in keys if k not in (None, 1000))
    lookup = spark.createDataFrame([(k, f"v{k}", n) for k, n in weights.items()], "k bigint, v string, w bigint")
    got = skew_proof_lookup(rows, "k", lookup, "k", "v", "w", "out", ["n"]).collect()
    assert len(got) == len(keys)
    for r in got:
        assert r["out"] == (f"v{r['k']}" if r["k"] in weights else None)


def test_last_row_and_resume(spark, kept):
    dims = star.with_keys(counts.count_values(kept, star.LAST_ROW_FIELDS))
    (last,) = star.last_row(star.fact_rows(kept), dims, ["line_no"]).collect()
    good = kept.filter("non_default = ''").orderBy(F.desc("line_no")).first()
    assert tuple(last) == tuple(good[f] for f in star.LAST_ROW_FIELDS)
    nothing = star.last_row(star.fact_rows(kept.limit(0)), dims, ["line_no"])
    assert nothing.collect() == []
    assert resume_after(kept, nothing).count() == kept.count()


def test_resume_takes_the_first_match(lines_of, spark):
    text = '1.1.1.1 - - [05/Jan/2024:00:00:0{} +0000] "GET /x HTTP/1.1" 200 1 "-" "UA"'
    records = parse_lines(lines_of(*[text.format(s) for s in (1, 2, 2, 3)], "odd line"))
    last = records.filter("line_no = 2").select(*star.LAST_ROW_FIELDS)
    assert sorted(r["line_no"] for r in resume_after(records, last).collect()) == [2, 3, 4]
    unknown = last.withColumn("remote_ip", F.lit("9.9.9.9"))
    assert resume_after(records, unknown).count() == 5
    placed = records.withColumn("line_pos", F.struct(F.lit("s").alias("segment"), F.col("line_no").alias("seq")))
    assert sorted(r["line_no"] for r in resume_after(placed, last, "line_pos").collect()) == [2, 3, 4]
