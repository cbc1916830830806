import base64
import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitloom.llm import text, urls, warc
from hitloom.llm.queries import RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(value):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), value or ""))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\té.", max_size=12)), max_size=6), st.integers(1, 4))
def test_shingle_sets_have_the_sizes_of_sets_of_words(values, size):
    column = pa.array(values, pa.string())
    sizes = [n for part in text.slices(column) for n in (lambda s: (s.bounds[1:] - s.bounds[:-1]).tolist())(text.shingle_sets(part, size))]
    expected = []
    for value in values:
        words = words_of(value)
        runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        expected.append(len(runs))
    assert sizes == expected


def test_a_short_text_is_not_the_run_of_another():
    column = pa.array(["a b", "a b c", "A  B", ""], pa.large_string())
    two = text.shingle_sets(column, 3)
    assert two.bounds.tolist() == [0, 1, 2, 3, 3]
    assert two.hashes[0] == two.hashes[2] != two.hashes[1]


def test_long_words_and_slices():
    column = pa.array(["x" * 3_000_000, "y", None, "x" * 3_000_000 + "z"])
    parts = list(text.slices(column))
    assert [len(p) for p in parts] == [1, 2, 1]
    assert [len(text.word_hashes(p).hashes) for p in parts] == [1, 1, 1]


URLS = [
    ("https://a.example.org/es/1", "example.org/es/", "block"),
    ("https://EXAMPLE.org/en/1x", "example.org/en/1", "block"),
    ("https://example.org/en/2", "org/", "allow"),
    ("https://badexample.org/es/", "org/", "allow"),
    ("http://x.com/fr/?q", "com/fr/", "allow"),
    ("http://x.com/de/#f", "com/de/", "block"),
    ("http://x.com/fr", None, "allow"),
    ("http://x.org", None, "allow"),
    ("http://x.org:80/", None, "allow"),
    ("no scheme", None, "allow"),
    (None, None, "allow"),
    ("http://x.com/a://y.org/", None, "allow"),
]


def test_url_rules(spark):
    rows = spark.createDataFrame([(i, u, 1, 2) for i, (u, *_) in enumerate(URLS)], "page_id int, url string, host int, _found int")
    got = {r["page_id"]: r for r in urls.judge(rows, RULES).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(URLS))] == [(r, v) for _, r, v in URLS]
    assert (got[10]["host"], got[10]["path"], got[1]["host"], got[4]["path"]) == ("", "", "example.org", "/fr/")
    assert got[0]["_found"] == 2


def test_url_rules_without_rows_or_rules(spark):
    empty = spark.createDataFrame([], "url string")
    assert urls.judge(empty, RULES).columns == ["url", "host", "path", "rule", "verdict"]
    assert urls.judge(empty, RULES).count() == 0
    one = spark.createDataFrame([("http://a.b/c",)], "url string")
    assert urls.judge(one, [], default="block").first()["verdict"] == "block"


def test_only_candidates_of_the_rarest_token_run():
    index = urls.RuleIndex(RULES, {"h:org": 100, "h:example": 90, "p:es": 5, "p:en": 70, "h:com": 50, "p:fr": 9, "p:de": 9})
    assert set(index.by_token) == {"h:org", "p:es", "p:en", "p:fr", "p:de"}
    names = [rule.name for _, rule in index.candidates("a.example.org", "/es/x")]
    assert sorted(names) == ["example.org/es/", "org/"]
    assert index.candidates("a.net", "/x/") == []


def _archive(spark, tmp_path, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary, record_type int, _digest int")
    marked = warc.mark_revisits(pages, "page_id", "payload")
    records = marked.select(
        "record_type", F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("record_id"), F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.col("url").alias("target_uri"), F.col("refers_to").cast("string").alias("refers_to"), "payload",
    )
    folder = str(tmp_path / "archives")
    manifest = warc.stored_manifest(spark, warc.write_archives(records, folder, archive_bytes=2000), str(tmp_path / "manifest"))
    return manifest, warc.read_archives(manifest)


def test_warc_round_trip(spark, tmp_path):
    big = bytes(range(256)) * 2000
    rows = [
        (1, "http://a/ b\r\nX: y", b"same", 0, 0), (2, None, b"same", 0, 0), (7, "http://c", b"same", 0, 0), (3, "http://d", b"", 0, 0),
        (4, "http://e", big, 0, 0), (5, "http://f", b"\r\n\r\nWARC/1.1\r\n", 0, 0), (None, "http://g", b"same", 0, 0), (7, "http://c", b"same", 0, 0),
    ]
    manifest, read = _archive(spark, tmp_path, rows)
    got = {}
    for r in read.collect():
        got.setdefault(r["record_id"], []).append(r)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) == sum(map(len, got.values()))
    digest = base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    for key in ("1", "2", "none"):
        assert (got[key][0]["record_type"], got[key][0]["refers_to"], got[key][0]["payload_digest"], got[key][0]["payload_bytes"]) == ("revisit", "7", digest, 4)
        assert got[key][0]["payload"] is None
    assert [r["record_type"] for r in got["7"]] == ["response"] * 2
    assert bytes(got["4"][0]["payload"]) == big and bytes(got["5"][0]["payload"]) == rows[5][2] and bytes(got["3"][0]["payload"]) == b""
    assert got["2"][0]["target_uri"] is None and got["1"][0]["target_uri"] == "http://a/%20b%0D%0AX:%20y"


def test_warc_of_no_rows(spark, tmp_path):
    manifest, read = _archive(spark, tmp_path, [])
    assert manifest.count() == 0 and read.count() == 0


def test_short_payloads_are_all_responses(spark):
    rows = spark.createDataFrame([(1, b"ab"), (2, b"ab"), (3, b"abc"), (4, b"abc")], "id long, payload binary")
    got = {r["id"]: r["record_type"] for r in warc.mark_revisits(rows, "id", "payload", least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_broken_records_are_refused():
    good = warc.record_bytes("response", "x", "2024-01-01T00:00:00Z", b"payload")
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload", b"pAyload"), good + b"x", b"junk"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_an_archive_cut_short_is_refused(tmp_path):
    import gzip
    import io

    packed = gzip.compress(b"a" * 1000)
    assert list(warc.members(io.BytesIO(packed + packed))) == [b"a" * 1000] * 2
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(packed + packed[:-9])))
