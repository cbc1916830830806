import datetime

import pytest
from pyspark.sql import functions as F

from hitloom.functions.numbers import leading_integer, unsuccessful
from hitloom.operators.records import parse_lines, rejects, without_assets
from hitloom.sources.access_log import read_log_lines, usable_lines

USUAL = '1.2.3.4 - - [05/Jan/2024:00:03:52 +0100] "GET {} HTTP/1.1" 200 1404 "{}" "Mozilla/5.0  (X11) a"'


def line(uri="/x", referrer="-"):
    return USUAL.format(uri, referrer)


def one(df):
    (row,) = df.collect()
    return row


def test_usual_line(lines_of):
    row = one(parse_lines(lines_of(line("/x", "https://a.example/p"))))
    assert row["date"] == "2024-01-05 00:03:52"
    assert row["ts"] == datetime.datetime(2024, 1, 5, 0, 3, 52)
    assert (row["remote_ip"], row["http_method"], row["request_uri"]) == ("1.2.3.4", "GET", "/x")
    assert (row["status_code"], row["response_size"], row["bytes"]) == ("200", "1404", 1404)
    assert row["referrer"] == "https://a.example/p"
    assert row["user_agent"] == "Mozilla/5.0 (X11) a"
    assert row["non_default"] == row["remote_user"] == row["authenticated_user"] == ""


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_session_zone_plays_no_role(spark, lines_of, zone):
    """02:30 does not exist in New York on that day, but it is what the log says."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = one(parse_lines(lines_of(line().replace("05/Jan/2024:00:03:52", "10/Mar/2024:02:30:00"))))
        assert row["date"] == "2024-03-10 02:30:00"
        assert row["ts"] == datetime.datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    "stamp, date",
    [
        ("[5/Jan/2024:00:03:52", "2024-01-05 00:03:52"),
        ("[05/jan/2024:00:03:52", "2024-01-05 00:03:52"),
        ('"[29/Feb/2024:23:59:59', "2024-02-29 23:59:59"),
        ("05-Dec-2024:10:00:00", "2024-12-05 10:00:00"),
        ("[31/Feb/2024:00:00:00", ""),
        ("[05/Jan/2024:00:03:60", ""),
        ("[05/Jan/2024:00:03", ""),
        ("[05/Jap/2024:00:03:52", ""),
        ("[05/Jan/2024:00:03:5Z", ""),
        ("-", ""),
    ],
)
def test_dates(lines_of, stamp, date):
    text = line().replace("[05/Jan/2024:00:03:52", stamp)
    row = one(parse_lines(lines_of(text)))
    assert row["date"] == date
    assert row["remote_ip"] == "1.2.3.4"
    assert row["non_default"] == ("" if date else text)
    assert (row["status_code"] == "200") == bool(date)


def test_short_line_is_kept_whole(lines_of):
    text = '1.2.3.4 - - [05/Jan/2024:00:03:52 +0000] "\\x16\\x03" 400 157 "-" "-"'
    row = one(parse_lines(lines_of(text)))
    assert row["non_default"] == text
    assert row["remote_ip"] == row["date"] == ""
    assert [tuple(r) for r in rejects(parse_lines(lines_of(text))).collect()] == [(0, "", text)]


def test_fields_shift_as_positions_say(lines_of):
    row = one(parse_lines(lines_of('::1 - - [05/Jan/2024:00:03:52 +0000] "-" 400 0 "-" "Long Agent Name"')))
    assert (row["http_method"], row["request_uri"], row["status_code"]) == ("-", "400", '"-"')
    row = one(parse_lines(lines_of(line("/a b"))))
    assert (row["request_uri"], row["status_code"]) == ("/a", 'HTTP/1.1"')
    assert row["status_int"] == 0


def test_strict_rejects_odd_status(lines_of):
    row = one(parse_lines(lines_of(line("/a b")), strict=True))
    assert row["non_default"] == line("/a b")
    assert row["remote_ip"] == "1.2.3.4"
    assert one(parse_lines(lines_of(line()), strict=True))["status_code"] == "200"


@pytest.mark.parametrize(
    "uri, both, trailing",
    [
        ("/", "/", "/"),
        ("//", "", ""),
        ("/blog/", "blog", "/blog"),
        ("/blog", "/blog", "/blog"),
        ("/a/b//", "a/b", "/a/b"),
    ],
)
def test_uri(lines_of, uri, both, trailing):
    assert one(parse_lines(lines_of(line(uri))))["request_uri"] == both
    assert one(parse_lines(lines_of(line(uri)), trailing_only=True))["request_uri"] == trailing


@pytest.mark.parametrize(
    "referrer, omit, kept",
    [
        ("-", "", ""),
        ("/", "", ""),
        ("https://a.example/", "", "https://a.example"),
        ("/a/", "", "a"),
        ("https://a.example", "", "https://a.example"),
        ("https://a.example/x", "a.example", ""),
        ("https://b.example/x", "a.example", "https://b.example/x"),
    ],
)
def test_referrer(lines_of, referrer, omit, kept):
    assert one(parse_lines(lines_of(line("/", referrer)), omit=omit))["referrer"] == kept


def test_runs_of_spaces_and_edges(lines_of):
    row = one(parse_lines(lines_of("  " + line().replace(" - - ", "   -  -   "))))
    assert row["remote_ip"] == ""  # a leading run makes an empty first token
    assert row["non_default"] != ""  # so the date is not where it should be
    assert one(parse_lines(lines_of(line() + "  ")))["user_agent"] == "Mozilla/5.0 (X11) a "


def test_assets(lines_of):
    uris = ["/a.js", "/a.css", "/f.woff2", "/a.js/", "/a.js?v=1", "/A.JS", "/s.xml", "/js"]
    kept = without_assets(parse_lines(lines_of(*[line(u) for u in uris], "short line")))
    assert [r["request_uri"] for r in kept.orderBy("line_no").collect()] == [
        "/a.js?v=1", "/A.JS", "/s.xml", "/js", "",
    ]


def test_usable_lines(lines_of):
    got = usable_lines(lines_of("a\r", "", "\r", "b\r\r", " "))
    assert [r["value"] for r in got.orderBy("line_no").collect()] == ["a", "b\r", " "]


def test_text_source_keeps_order(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.log").write_bytes(b"".join(b"%d-%d\r\n\n" % (i, j) for j in range(500)))
    rows = read_log_lines(spark, str(tmp_path), position=True).collect()
    assert len(rows) == 1500
    for i in range(3):
        mine = sorted((r["line_pos"]["block"], r["line_pos"]["seq"], r["value"]) for r in rows if r["value"].startswith(f"{i}-"))
        assert [v for _, _, v in mine] == [f"{i}-{j}" for j in range(500)]


def test_lenient_numbers(spark):
    cases = {"404": 404, "404abc": 404, " 12": 12, "-5x": -5, "abc": 0, "": 0, '"-"': 0, "9" * 30: 0}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r[0]: r[1] for r in df.select("s", leading_integer(F.col("s"))).collect()} == cases
    failed = df.filter(unsuccessful(F.col("s"))).count()
    assert failed == len(cases)
