from hitloom.operators.counts import count_values
from hitloom.operators.records import parse_lines, without_assets
from hitloom.operators.star import last_row
from hitloom.plans import star_tables
from hitloom.sources.access_log import land_lines, read_log_lines, set_segment_times
from hitloom.streaming import ingest
from hitloom.workloads import inputs

SF = "/root/testdata/sf0.001"


def as_counts(df):
    return {(r["dim"], r["value"]): r["count"] for r in df.collect()}


def run(spark, segments, path):
    records = ingest.stream_records(spark, segments, max_files_per_trigger=1)
    ingest.start_star_stream(records, path, f"{path}-checkpoint", interval=None).awaitTermination()


def test_stream_equals_batch_across_restarts(spark, tmp_path):
    segments, path = str(tmp_path / "segments"), str(tmp_path / "star")
    lines = inputs.log_lines(spark, SF).coalesce(1).sortWithinPartitions("line_no")  # a log is in order
    land_lines(lines.filter("line_no < 400"), f"{segments}/a")
    run(spark, f"{segments}/*", path)
    first = as_counts(star_tables.stored_totals(spark, path))
    run(spark, f"{segments}/*", path)  # a restart without news
    assert as_counts(star_tables.stored_totals(spark, path)) == first
    land_lines(lines.filter("line_no >= 400"), f"{segments}/b")
    run(spark, f"{segments}/*", path)
    batch = without_assets(parse_lines(read_log_lines(spark, f"{segments}/*")))
    assert as_counts(star_tables.stored_totals(spark, path)) == as_counts(count_values(batch))

    fact = star_tables.stored_fact(spark, path)
    assert fact.count() == batch.filter("non_default = ''").count()
    (last,) = last_row(fact, star_tables.stored_counts(spark, path)).collect()
    ordered = without_assets(parse_lines(lines.filter("value <> ''"))).filter("non_default = ''")
    good = ordered.orderBy("line_no", ascending=False).first()
    assert tuple(last) == (good["date"], good["remote_ip"], good["http_method"], good["request_uri"])


def test_old_segments_and_other_checkpoints(spark, tmp_path):
    segments, path = str(tmp_path / "segments"), str(tmp_path / "star")
    lines = inputs.log_lines(spark, SF)
    land_lines(lines.filter("line_no < 300"), f"{segments}/a")
    run(spark, f"{segments}/*", path)
    land_lines(lines.filter("line_no between 300 and 600"), f"{segments}/b")
    set_segment_times(spark, f"{segments}/b", days_back=30)
    run(spark, f"{segments}/*", path)
    seen = without_assets(parse_lines(lines.filter("value <> '' and line_no <= 600")))
    assert as_counts(star_tables.stored_totals(spark, path)) == as_counts(count_values(seen))

    other = str(tmp_path / "other")
    land_lines(lines.filter("line_no > 600"), f"{other}/c")
    records = ingest.stream_records(spark, f"{other}/*")
    ingest.start_star_stream(records, path, f"{path}-second", interval=None).awaitTermination()
    whole = without_assets(parse_lines(lines.filter("value <> ''")))
    assert as_counts(star_tables.stored_totals(spark, path)) == as_counts(count_values(whole))
    assert len({c["run"] for c in star_tables.commits(spark, path)}) == 2


def test_an_interval_stream_goes_on_until_it_is_stopped(spark, tmp_path):
    segments, path = str(tmp_path / "segments"), str(tmp_path / "records")
    land_lines(inputs.log_lines(spark, SF).filter("line_no < 200"), f"{segments}/a")
    records = ingest.stream_records(spark, f"{segments}/*").select("date", "remote_ip")
    query = ingest.start_record_stream(records, path, f"{path}-checkpoint", interval="1 second")
    try:
        query.processAllAvailable()
        first = spark.read.parquet(path).count()
        land_lines(inputs.log_lines(spark, SF).filter("line_no between 200 and 400"), f"{segments}/b")
        query.processAllAvailable()
        assert query.isActive and 0 < first < spark.read.parquet(path).count()
    finally:
        query.stop()


def test_range_changes_skip_repeats_and_late_snapshots(spark, tmp_path):
    import datetime
    import json

    from hitloom.streaming.ranges import RESPONSES, start_change_stream, stream_changes, stream_responses

    day = datetime.datetime(2024, 1, 1)
    landed, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def land(*rows):
        made = [(s, day + datetime.timedelta(hours=h) if h is not None else None, json.dumps({"success": ok, "result": {"etag": e, "ipv4_cidrs": nets, "ipv6_cidrs": []}})) for s, h, e, nets, ok in rows]
        spark.createDataFrame(made, RESPONSES).coalesce(1).write.mode("append").parquet(landed)
        start_change_stream(stream_changes(stream_responses(spark, landed)), out, checkpoint, interval=None).awaitTermination()
        found = spark.read.parquet(out).collect()
        return sorted(((r["source"], r["fetched_at"].hour if r["fetched_at"] else None, r["etag"], r["previous_etag"], r["etag_changed"], r["set_changed"]) for r in found), key=repr)

    first = land(("a", 1, "x", ["1/8", "2/8"], True), ("a", 2, "x", ["2/8", "1/8", "1/8"], True), (None, None, "n", [], True), ("a", 3, "bad", ["3/8"], False))
    assert first == [("a", 1, "x", "", True, True), (None, None, "n", "", True, False)]
    # Copies of earlier ones, one that is too late, and a change of the set under the same etag.
    second = land(("a", 1, "x", ["1/8"], True), ("a", 0, "late", ["9/8"], True), ("a", 5, "x", ["1/8"], True), (None, 4, "m", [], True))
    assert second == sorted([*first, ("a", 5, "x", "x", False, True), (None, 4, "m", "n", True, False)], key=repr)
    assert land(("a", 5, "x", ["1/8"], True)) == second


def changes_in_order(batches):
    """``source, at, etag, previous_etag, etag_changed, set_changed``, one snapshot after the other."""
    known, found = {}, []
    for batch in batches:
        for source, at, etag, nets in sorted(batch, key=lambda r: (str(r[0]), r[1], r[2], digest_of(r[3]))):
            last = known.get(source)
            if last and (at, etag) <= last[:2]:
                continue
            before = last or (None, "", "")
            if etag != before[1] or digest_of(nets) != before[2]:
                found.append((source, at, etag, before[1], etag != before[1], digest_of(nets) != before[2]))
            known[source] = (at, etag, digest_of(nets))
    return found


def digest_of(nets):
    import hashlib

    return hashlib.sha256("\n".join(sorted(set(nets))).encode()).hexdigest() if nets else ""


def test_range_changes_by_brute_force(spark, tmp_path):
    """Most snapshots of one source, many ranges, copies, late ones, and several sets under one time and etag."""
    import datetime
    import json
    import random

    from hitloom.streaming.ranges import RESPONSES, start_change_stream, stream_changes, stream_responses

    rng, day = random.Random(5), datetime.datetime(2024, 1, 1)
    landed, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    batches = []
    for number in range(3):
        batch = [(rng.choice(["hot", "hot", "hot", "hot", "a", None]), rng.randrange(number * 300 - 60, number * 300 + 360), rng.choice("xyz"), rng.sample(["1/8", "2/8", "3/8"], rng.randrange(3))) for _ in range(700)]
        batches.append(batch + batch[:50])
        made = [(s, day + datetime.timedelta(hours=h), json.dumps({"success": True, "result": {"etag": e, "ipv4_cidrs": nets, "ipv6_cidrs": []}})) for s, h, e, nets in batches[-1]]
        spark.createDataFrame(made, RESPONSES).repartition(3).write.mode("append").parquet(landed)
        start_change_stream(stream_changes(stream_responses(spark, landed)), out, checkpoint, interval=None).awaitTermination()
    hour = datetime.timedelta(hours=1)
    got = [(r["source"], (r["fetched_at"] - day) // hour, r["etag"], r["previous_etag"], r["etag_changed"], r["set_changed"]) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=repr) == sorted(changes_in_order(batches), key=repr)


def test_snapshots_of_a_source_pass_by():
    """Changes come out while snapshots still come in, whatever their order, so a task doesn't hold those of its source."""
    import pandas as pd
    import pyarrow as pa

    from hitloom.streaming import ranges

    class State:
        exists, get = True, (10, "e", "d10")

        def update(self, value):
            self.get = value

    def snapshots(*moments):
        rows = [("a", m, "e", f"d{m}") for m in moments]
        return pa.RecordBatch.from_pylist([dict(zip(("source", "at", "etag", "digest"), r)) for r in rows])

    parts = [b.to_pandas() for moments in ((30, 31, 32, 30), (12, 9, 10, 11), (40,)) for b in ranges._followed(iter([snapshots(*moments)]))]
    taken = []
    state = State()

    def batches():
        for part in parts:
            taken.append(len(part))
            yield part

    changes = ranges._changes(("a",), batches(), state)
    assert next(changes)["at"].tolist() == [31, 32] and len(taken) == 1
    rest = pd.concat(list(changes))
    assert sorted(rest["at"]) == [11, 12, 30, 40] and state.get == (40, "e", "d40")
