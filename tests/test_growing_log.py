"""Logs that grow, rotate and are truncated between batches, and the numbers of lines of closed ones."""

import gzip
import os
import random
import shutil

import pytest

from hitloom.sources import growing_log
from hitloom.sources.access_log import read_numbered_lines
from hitloom.sources.growing_log import GrowingLogReader, follow_log_lines


def read_all(reader, start, end):
    rows = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            rows += zip(batch.column("block").to_pylist(), batch.column("value").to_pylist())
    return rows


@pytest.mark.parametrize("range_bytes", [1, 3, 7, 50, 10_000])
@pytest.mark.parametrize("read_bytes", [5, 4096])
def test_ranges_give_each_line_once(tmp_path, monkeypatch, range_bytes, read_bytes):
    monkeypatch.setattr(growing_log, "READ_BYTES", read_bytes)
    rng = random.Random(range_bytes)
    lines = ["x" * rng.choice([0, 0, 1, 2, 9, 30]) + str(i) * rng.randrange(2) for i in range(60)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\nhalf a li")
    reader = GrowingLogReader(str(tmp_path), range_bytes)
    end = reader.latestOffset()
    rows = read_all(reader, {}, end)
    assert [v for _, v in sorted(rows)] == lines and len({p for p, _ in rows}) == len(lines)
    assert [p for p, _ in sorted(rows)] == [sum(len(line) + 1 for line in lines[:i]) for i in range(len(lines))]
    assert read_all(reader, end, reader.latestOffset()) == []


def values(reader, start, end):
    return sorted(v for _, v in read_all(reader, start, end))


def test_growth_rotation_truncation_and_copies(tmp_path):
    log, reader = tmp_path / "access.log", GrowingLogReader(str(tmp_path), 10)
    assert reader.latestOffset() == {}
    log.write_text("")
    assert reader.latestOffset() == {}
    log.write_text("one\ntwo\nthr")
    first = reader.latestOffset()
    assert values(reader, {}, first) == ["one", "two"]
    with log.open("a") as file:
        file.write("ee\nfour\n")
    second = reader.latestOffset()
    assert values(reader, first, second) == ["four", "three"]
    assert values(reader, first, second) == ["four", "three"]
    # Rotation by a new name, with lines added before it.
    with log.open("a") as file:
        file.write("five\n")
    os.rename(log, tmp_path / "access.log.1")
    log.write_text("six\n")
    third = reader.latestOffset()
    assert values(reader, second, third) == ["five", "six"]
    # A batch that is planned again after another rotation finds its files.
    os.rename(tmp_path / "access.log.1", tmp_path / "access.log.2")
    os.rename(log, tmp_path / "access.log.1")
    log.write_text("seven\n")
    assert values(reader, second, third) == ["five", "six"]
    fourth = reader.latestOffset()
    assert values(reader, third, fourth) == ["seven"]
    # Rotation by copy and truncation.
    with log.open("a") as file:
        file.write("eight\n")
    shutil.copy(log, tmp_path / "access.log.3")
    with log.open("r+") as file:
        file.truncate(0)
        file.write("nine\nten, longer than what was there\n")
    fifth = reader.latestOffset()
    assert values(reader, fourth, fifth) == ["eight", "nine", "ten, longer than what was there"]
    # A log that went before its lines were read.
    (tmp_path / "other.log").write_text("lost\n")
    sixth = reader.latestOffset()
    os.remove(tmp_path / "other.log")
    with pytest.raises(FileNotFoundError):
        values(reader, fifth, sixth)


def test_stream_across_restarts(spark, tmp_path):
    logs, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    logs.mkdir()

    def run():
        lines = follow_log_lines(spark, f"file://{logs}", range_bytes=64)
        writer = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(r["value"] for r in spark.read.parquet(out).collect())

    written = [f"line {i} é" for i in range(100)]
    (logs / "a.log").write_text("\n".join(written[:40]) + "\n\r\n\n")
    (logs / "b.log").write_bytes(b"bad \xff byte\n")
    assert run() == sorted([*written[:40], "bad � byte"])
    with (logs / "a.log").open("a") as file:
        file.write("\n".join(written[40:70]) + "\nno end")
    os.rename(logs / "a.log", logs / "a.log.1")
    (logs / "a.log").write_text("\n".join(written[70:]) + "\n")
    assert run() == sorted([*written, "bad � byte"])
    assert run() == sorted([*written, "bad � byte"])


@pytest.mark.parametrize("most_broadcast", [0, 1000])
def test_numbers_over_many_blocks_and_compressed_files(spark, tmp_path, most_broadcast):
    rng = random.Random(6)
    files = {name: ["" if rng.random() < 0.1 else f"{name} {i} " + "y" * rng.randrange(40) for i in range(n)] for name, n in (("b", 900), ("a", 500), ("c.gz", 300), ("d", 1))}
    files["e"] = [""] * 5
    for age, (name, lines) in enumerate(files.items()):
        data = ("\n".join(lines) + ("" if name == "a" else "\n")).encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
        os.utime(tmp_path / name, (1_700_000_000 + age, 1_700_000_000 + age))
    (tmp_path / "empty").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = read_numbered_lines(spark, str(tmp_path), most_broadcast).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    wanted, number = [], 0
    for name, lines in files.items():
        for i, line in enumerate(lines, 1):
            number += 1
            if line:
                wanted.append((name, i, number, line))
    assert sorted((os.path.basename(r["segment"]), r["line_no"], r["log_line_no"], r["value"]) for r in found) == sorted(wanted)
