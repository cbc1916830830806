import datetime
import ipaddress
import json
import random

import pytest

from hitloom.operators import range_changes, trust
from hitloom.operators.neighbors import with_neighbor
from hitloom.sources.trusted_ranges import (
    config_etags,
    config_ranges,
    read_config,
    read_responses,
    snapshot_ranges,
    valid_snapshots,
)

T0 = datetime.datetime(2024, 1, 1)


def response(spark, *bodies):
    rows = [("s", T0 + datetime.timedelta(hours=i), b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "source string, fetched_at timestamp_ntz, body string")


def body(etag="e1", v4=("10.0.0.0/14",), v6=("2400:cb00::/32",), success=True):
    result = {"etag": etag, "ipv4_cidrs": v4, "ipv6_cidrs": v6}
    return json.dumps({"success": success, "result": {k: v for k, v in result.items() if v is not None}})


def test_snapshots(spark):
    df = response(spark, body(), body(success=False), body(v6=None), "{bad", body(etag=None), "{}", body(v6=[]))
    got = valid_snapshots(df).orderBy("fetched_at").collect()
    assert [(r["fetched_at"].hour, r["etag"]) for r in got] == [(0, "e1"), (4, ""), (6, "e1")]
    ranges = snapshot_ranges(valid_snapshots(df)).filter("etag = ''").collect()
    assert sorted((r["family"], r["cidr"]) for r in ranges) == [(32, "10.0.0.0/14"), (128, "2400:cb00::/32")]


CONFIG = [
    "# ranges", "# Last etag:e0", "# Last etag: e1", "", "set_real_ip_from 10.0.0.0/14;", "set_real_ip_from 2400:cb00::/32;",
    "set_real_ip_from fc00::/7;", "real_ip_header X-Real-IP;", "set_real_ip_from  10.1.0.0/16;", "x 1bad/3;", "tail ",
    "set_real_ip_from 1.2.3.4;", "set_real_ip_from 1.2.3.4/;",
]


def test_config(spark):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(CONFIG)], "file string, line_no bigint, value string")
    assert [tuple(r) for r in config_etags(df).collect()] == [("f", "e1", len(CONFIG))]
    assert [r["etag"] for r in config_etags(df.filter("line_no <> 2")).collect()] == [None]
    assert [r["etag"] for r in config_etags(df.filter("line_no > 2")).collect()] == [None]
    assert {r["etag"] for r in config_ranges(df.filter("line_no > 2")).collect()} == {""}
    got = config_ranges(df).orderBy("line_no").collect()
    assert [(r["family"], r["cidr"]) for r in got] == [(32, "10.0.0.0/14"), (128, "2400:cb00::/32"), (32, "1.2.3.4")]
    wider = config_ranges(df, letter_start=True).filter("cidr = 'fc00::/7'")
    assert wider.count() == 1


def test_sets_changed_counts_repeats(spark):
    schema = "source string, family int, cidr string"
    old = spark.createDataFrame([("a", 32, "x"), ("a", 32, "x"), ("b", 32, "y"), ("c", 32, "z")], schema)
    new = spark.createDataFrame([("a", 32, "x"), ("b", 32, "y"), ("c", 32, "w"), ("d", 128, "v")], schema)
    got = {(r["source"], r["family"]): r["changed"] for r in range_changes.sets_changed(old, new).collect()}
    assert got == {("a", 32): True, ("b", 32): False, ("c", 32): True, ("d", 128): True}
    diff = {tuple(r) for r in range_changes.set_differences(old, new).collect()}
    assert diff == {("c", 32, "z", "removed"), ("c", 32, "w", "added"), ("d", 128, "v", "added")}


@pytest.mark.parametrize("following", [False, True])
def test_neighbors_across_ranges(spark, tmp_path, following):
    rng = random.Random(3)
    rows = sorted({(rng.choice("aab"), T0 + datetime.timedelta(minutes=rng.randrange(3000))) for _ in range(300)})
    rows = [(None, None), (None, T0), ("a", None), *rows]
    rows = [(k, t, f"v{i}") for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v string")
    got = {r["v"]: r["o"] for r in with_neighbor(df, "k", "t", "v", "o", str(tmp_path / "n"), following).collect()}
    step = 1 if following else -1
    for i, (k, _, v) in enumerate(rows):
        j = i + step
        near = rows[j] if 0 <= j < len(rows) and rows[j][0] == k else None
        assert got[v] == (near[2] if near else None)


def test_snapshot_differences_and_etags(spark, tmp_path):
    df = response(spark, body("e1", ["a/1", "b/2"], []), body("e1", ["a/1"], []), body("e2", [], []), body("e1", ["a/1"], ["c:/3"]))
    valid = valid_snapshots(df.union(df))
    got = {(r["fetched_at"].hour, r["cidr"], r["change"]) for r in
           range_changes.snapshot_differences(valid, str(tmp_path / "s")).collect()}
    assert got == {
        (0, "a/1", "added"), (0, "b/2", "added"), (1, "b/2", "removed"), (2, "a/1", "removed"),
        (3, "a/1", "added"), (3, "c:/3", "added"),
    }
    changes = range_changes.etag_changes(valid, str(tmp_path / "e")).orderBy("fetched_at").collect()
    assert [(r["fetched_at"].hour, r["etag"], r["previous_etag"]) for r in changes] == [
        (0, "e1", ""), (2, "e2", "e1"), (3, "e1", "e2"),
    ]


RANGES = ["10.0.0.0/14", "10.1.0.0/16", "192.168.1.128/25", "2400:cb00::/32", "2001:db8::1/128", "bad/8", "1.2.3.4", "5.6.7.8/"]


@pytest.mark.parametrize("join", [False, True])
def test_labels_agree_with_brute_force(spark, tmp_path, join):
    rng = random.Random(5)
    ips = [f"10.{rng.randrange(8)}.{rng.randrange(256)}.1" for _ in range(200)] + ["10.1.1.1"] * 300
    ips += [f"192.168.1.{rng.randrange(256)}" for _ in range(100)]
    ips += ["2400:cb00::9", "2400:cb01::9", "2001:DB8::1", "2001:db8::2", "junk", "", None, "1.2.3.4", "1.2.3.5", "5.6.7.8"]
    nets = [ipaddress.ip_network(r, strict=False) for r in (*RANGES[:5], RANGES[6])]
    folders = iter([str(tmp_path / str(i)) if join else None for i in range(9)])

    def trusted(ip):
        try:
            return any(ipaddress.ip_address(ip) in n for n in nets)
        except ValueError:
            return False

    rows = spark.createDataFrame([(i, ip, i % 7) for i, ip in enumerate(ips)], "n bigint, remote_ip string, bytes bigint")
    ranges = spark.createDataFrame([(r,) for r in RANGES], "cidr string")
    got = {r["n"]: r["trusted"] for r in trust.label_trusted(rows, ranges, folder=next(folders)).collect()}
    wanted = {i: trusted(ip) for i, ip in enumerate(ips)}
    assert got == wanted
    yes = trust.trusted_requests(rows, ranges, folder=next(folders)).count()
    no = trust.untrusted_requests(rows, ranges, folder=next(folders)).count()
    assert (yes, no) == (sum(wanted.values()), len(ips) - sum(wanted.values()))
    blocked = {r["family"]: (r["requests"], r["bytes"]) for r in
               trust.block_counters(rows, ranges, folder=next(folders)).collect()}
    for family, is_v6 in ((32, False), (128, True)):
        mine = [i for i, ip in enumerate(ips) if not wanted[i] and (":" in (ip or "")) == is_v6]
        assert blocked[family] == (len(mine), sum(i % 7 for i in mine))


def test_restored_addresses(spark):
    rows = [(1, "10.0.0.1", "9.9.9.9"), (2, "10.0.0.1", ""), (3, "10.0.0.1", None), (4, "11.0.0.1", "9.9.9.9")]
    df = spark.createDataFrame(rows, "n int, peer_ip string, header_ip string")
    ranges = spark.createDataFrame([("10.0.0.0/8",)], "cidr string")
    got = {r["n"]: r["remote_ip"] for r in trust.restore_addresses(df, ranges).collect()}
    assert got == {1: "9.9.9.9", 2: "10.0.0.1", 3: "10.0.0.1", 4: "11.0.0.1"}


def test_a_list_too_long_to_inline_is_refused(spark, monkeypatch):
    monkeypatch.setattr(trust, "INLINE_LIMIT", 2)
    ranges = spark.createDataFrame([(r,) for r in RANGES], "cidr string")
    rows = spark.createDataFrame([("10.0.0.1",)], "remote_ip string")
    with pytest.raises(ValueError, match="give a folder"):
        trust.label_trusted(rows, ranges)


def test_files_of_ranges(spark, tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "a.conf").write_text("# Last etag: e7\nset_real_ip_from 10.0.0.0/14;\n\n# end\n")
    lines = sorted((r["line_no"], r["value"]) for r in read_config(spark, str(tmp_path / "conf")).collect())
    assert lines == [(1, "# Last etag: e7"), (2, "set_real_ip_from 10.0.0.0/14;"), (3, ""), (4, "# end")]
    (got,) = config_ranges(read_config(spark, str(tmp_path / "conf"))).collect()
    assert (got["etag"], got["cidr"], got["line_no"]) == ("e7", "10.0.0.0/14", 2)
    landed = tmp_path / "api" / "source=edge" / "fetched_at=2024-01-01 00%3A00%3A00"
    landed.mkdir(parents=True)
    (landed / "r.json").write_text(body("e1\n"))
    (got,) = valid_snapshots(read_responses(spark, str(tmp_path / "api"))).collect()
    assert (got["source"], got["fetched_at"], got["ipv4_cidrs"]) == ("edge", T0, ["10.0.0.0/14"])


def test_short_prefixes_in_a_long_list(spark, tmp_path):
    ips = ["0.0.0.0", "255.255.255.255", "10.1.2.3", "::", "ffff::1", "2001:db8::1", "x", None]
    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "n int, remote_ip string")
    for number, (listed, wanted) in enumerate(
        [(["0.0.0.0/0", "10.0.0.0/8"], {0, 1, 2}), (["::/0"], {3, 4, 5}), (["128.0.0.0/1", "8000::/1"], {1, 4}), (["10.0.0.0/9", "10.128.0.0/9"], {2}), ([], set())]
    ):
        ranges = spark.createDataFrame([(r,) for r in listed], "cidr string")
        got = trust.label_trusted(rows, ranges, folder=str(tmp_path / str(number))).filter("trusted").collect()
        assert {r["n"] for r in got} == wanted


def test_minimal_cover_by_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [("b", "0.0.0.0/1"), ("b", "128.0.0.0/1"), ("c", "2001:db8::/33"), ("c", "2001:db8:8000::/33"), ("c", "::/128"), ("c", "junk"), (None, "1.2.3.4")]
    rows += [("e", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:fffe/127"), ("e", "255.255.255.255"), ("e", "255.255.255.254/32")]
    for key in ("hot", "hot", "hot", "a"):
        for _ in range(40):
            rows.append((key, f"10.0.0.{rng.randrange(256)}/{rng.choice([32, 32, 31, 30, 28])}"))
    df = spark.createDataFrame(rows, "source string, cidr string")
    found = {}
    for r in range_changes.minimal_cover(df, ["source"], str(tmp_path / "c")).collect():
        net = ipaddress.ip_network(r["cidr"])
        assert net.prefixlen == r["len"] == len(r["net_bits"]) and net.max_prefixlen == r["family"]
        assert format(int(net.network_address), f"0{r['family']}b")[: r["len"]] == r["net_bits"]
        found.setdefault(r["source"], []).append(net)
    for key in {k for k, _ in rows}:
        nets = [ipaddress.ip_network(c, strict=False) for k, c in rows if k == key and c != "junk"]
        wanted = [n for version in (4, 6) for n in ipaddress.collapse_addresses(x for x in nets if x.version == version)]
        assert sorted(map(str, found[key])) == sorted(map(str, wanted))


def test_trust_at_the_time_of_the_request(spark, tmp_path):
    rng = random.Random(12)
    hour = datetime.timedelta(hours=1)
    lists = [["10.0.0.0/14"], ["10.1.0.0/16", "2400:cb00::/32"], [], ["10.0.0.0/8"], ["10.1.1.0/24", "0.0.0.0/0"], ["bad"]]
    snapshots = []
    for source in ("main", "edge", None):
        for k in range(12):
            if rng.random() < 0.8:
                cidrs = rng.choice(lists)
                snapshots.append((source, T0 + k * hour, [c for c in cidrs if ":" not in c], [c for c in cidrs if ":" in c]))
    snapshots += [("main", None, ["0.0.0.0/0"], []), snapshots[0], ("edge", snapshots[0][1], ["9.9.9.9"], [])]
    ips = ["10.1.1.1", "10.2.1.1", "9.9.9.9", "2400:cb00::7", "junk", "", None]
    rows = []
    for i in range(400):
        source = rng.choice(["main", "main", "edge", None, "other"])
        rows.append((i, source, rng.choice(ips), rng.choice([None, T0 + rng.randrange(-3, 28) * hour / 2])))

    def trusted(source, ip, at):
        known = [t for s, t, *_ in snapshots if s == source and t is not None and at is not None and t <= at]
        if not known:
            return False
        nets = [c for s, t, *lists in snapshots if s == source and t == max(known) for c in sum(lists, []) if c != "bad"]
        try:
            return any(ipaddress.ip_address(ip) in ipaddress.ip_network(n) for n in nets)
        except ValueError:
            return False

    requests = spark.createDataFrame(rows, "n int, source string, remote_ip string, ts timestamp_ntz")
    published = spark.createDataFrame(snapshots, "source string, fetched_at timestamp_ntz, ipv4_cidrs array<string>, ipv6_cidrs array<string>")
    found = trust.label_trusted_then(requests, published, str(tmp_path / "t")).collect()
    assert sorted((r["n"], r["trusted"]) for r in found) == [(n, trusted(*rest)) for n, *rest in rows]
    assert 20 < sum(r["trusted"] for r in found) < 380
    assert not any(r["trusted"] for r in trust.label_trusted_then(requests, published.limit(0), str(tmp_path / "u")).collect())
