"""Inputs derived from the test tables, each by one expression that Spark and DuckDB both run.

The tables hold no access log, so lines come from ``events``, range snapshots from ``orders``,
config files from ``customer`` and a long range list from ``supplier``. All of them grow with
the tables.
"""

from __future__ import annotations

import os

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.functions.once import computed_once

BACKSLASH = "chr(92)"

# Parts of a request, from a row of events.
REQUEST = {
    "line_no": "event_id",
    "ip": """CASE WHEN user_id % 10 < 8
        THEN '10.' || (user_id % 4) || '.' || (user_id * 7 % 256) || '.' || (user_id % 251)
        WHEN user_id % 10 = 8 THEN '2400:cb00::' || (user_id % 10000)
        ELSE '2001:db8::' || (user_id % 10000) || ':1' END""",
    "stamp": "{log_date}",
    "old_stamp": "{old_date}",
    "method": "CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END",
    "uri": """CASE event_id % 20 WHEN 0 THEN '/' WHEN 1 THEN '/app.js' WHEN 2 THEN '/style.css'
        WHEN 3 THEN '/font.woff2' WHEN 4 THEN '/sitemap.xml' WHEN 5 THEN '/blog/'
        WHEN 6 THEN '/blog' WHEN 7 THEN '/a/b/' WHEN 8 THEN '/one/' || event_id
        ELSE '/item/' || (event_id % 37) END""",
    "status": """CASE WHEN event_type = 'error'
        THEN CASE event_id % 3 WHEN 0 THEN '404' WHEN 1 THEN '500' ELSE '403' END
        WHEN event_id % 2 = 0 THEN '200' ELSE '301' END""",
    "size": "CAST(event_id * 13 % 5000 AS {text})",
    "ref": """CASE event_id % 5 WHEN 0 THEN '-' WHEN 1 THEN 'https://example.org/'
        WHEN 2 THEN 'https://self.example/x' WHEN 3 THEN 'https://search.example/q'
        ELSE 'https://example.org' END""",
    "agent": "'Agent/' || CASE WHEN user_id % 3 = 0 THEN user_id ELSE user_id % 7 END",
    "user_id": "user_id",
}

# One line of each kind, tested in this order; empty lines and four kinds of odd ones are mixed in.
LINE = f"""CASE
    WHEN line_no % 103 = 0 THEN ''
    WHEN line_no % 97 = 0 THEN ip || ' - - [' || stamp || ' +0000] "' || {BACKSLASH} || 'x16'
        || {BACKSLASH} || 'x03" 400 157 "-" "-"'
    WHEN line_no % 101 = 0 THEN ip || ' - - [31/Feb/2024:00:00:00 +0000] "GET ' || uri
        || ' HTTP/1.1" ' || status || ' 10 "-" "UA/1"'
    WHEN line_no % 107 = 0 THEN ip || ' - - [' || stamp || ' +0000] "-" 400 0 "-" "Long Agent Name"'
    WHEN line_no % 109 = 0 THEN ip || ' - - [' || stamp
        || ' +0000] "GET /a b HTTP/1.1" 200 0 "-" "Long Agent Name"'
    ELSE ip || ' - - [' || stamp || ' +0000] "' || method || ' ' || uri || ' HTTP/1.1" ' || status
        || ' ' || size || ' "' || ref || '" "Mozilla/5.0 (X11; Linux) ' || agent || '"' END"""

# A row of the older flat table.
LEGACY_ROW = {
    "row_no": "line_no",
    "date": """CASE WHEN line_no % 89 = 0 THEN '' WHEN line_no % 73 = 0 THEN '31-Feb-2024:00:00:00'
        ELSE old_stamp END""",
    "remoteIP": "ip",
    "httpMethod": f"""CASE WHEN line_no % 83 = 0 THEN {BACKSLASH} || 'x16' || chr(123)
        WHEN line_no % 79 = 0 THEN '' ELSE method END""",
    "requestURI": "uri",
    "statusCode": "status",
    "responseSize": "size",
    "referrer": "ref",
    "userAgent": "'Mozilla/5.0 (X11; Linux) ' || agent",
    "remoteUser": "CASE WHEN user_id % 10 = 0 THEN 'user' || (user_id % 50) ELSE '' END",
    "authenticatedUser": "CASE WHEN user_id % 20 = 0 THEN 'user' || (user_id % 50) ELSE '' END",
}

# A landed API response, from a row of orders; one source owns a third of them.
SNAPSHOT = {
    "source": """CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'edge-main'
        ELSE 'edge-' || (o_custkey % 40) END""",
    "fetched_at": "CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE {order_time} END",
    "body": """CASE WHEN o_orderkey % 47 = 0 THEN chr(123) || '"success":tr'
        ELSE chr(123) || '"success":' || CASE WHEN o_orderkey % 41 = 0 THEN 'false' ELSE 'true' END
        || ',"result":' || chr(123) || '"etag":"e' || substr(o_orderpriority, 1, 1)
        || '","ipv4_cidrs":["10.' || (o_custkey % 4) || '.0.0/16","10.' || (o_orderkey % 8 * 4)
        || '.0.0/14","172.16.' || (o_orderkey % 5) || '.0/24"]'
        || CASE WHEN o_orderkey % 43 = 0 THEN ''
           WHEN o_orderkey % 7 = 0 THEN ',"ipv6_cidrs":[]'
           ELSE ',"ipv6_cidrs":["2400:cb' || (10 + o_custkey % 6) || '::/32"]' END
        || chr(125) || chr(125) END""",
}

# A line of a config file, from a row of customer.
CONFIG_LINE = {
    "file": "'proxies-' || (c_custkey % 97)",
    "line_no": "c_custkey",
    "value": """CASE WHEN c_custkey % 13 = 0 THEN ''
        WHEN c_custkey % 11 = 0 THEN '# Last etag: e' || c_nationkey
        WHEN c_custkey % 14 = 0 THEN '# Last etag:x' || c_nationkey
        WHEN c_custkey % 37 = 0 THEN 'set_real_ip_from 10.9.' || (c_custkey % 256) || '.1;'
        WHEN c_custkey % 41 = 0 THEN 'set_real_ip_from 2400:cb' || (10 + c_nationkey) || '::1;'
        WHEN c_custkey % 17 = 0 THEN '# IPv4 ranges'
        WHEN c_custkey % 19 = 0 THEN 'real_ip_header X-Real-IP;'
        WHEN c_custkey % 23 = 0 THEN 'set_real_ip_from fc00::/7;'
        WHEN c_custkey % 29 = 0 THEN 'set_real_ip_from 2400:cb' || (10 + c_nationkey) || '::/32;'
        WHEN c_custkey % 31 = 0 THEN 'set_real_ip_from  10.0.0.0/8;'
        ELSE 'set_real_ip_from 10.' || (c_custkey % 256) || '.' || c_nationkey || '.0/24;' END""",
}

# A long list of ranges, from a row of supplier, with repeats.
SUPPLIER_RANGE = {
    "source": "CASE WHEN s_suppkey % 3 = 0 THEN 'edge-main' ELSE 'edge-' || s_nationkey END",
    "cidr": "'10.' || (s_suppkey % 4) || '.' || (s_suppkey * 7 % 251) || '.0/24'",
}

# The list that replaces it: sources of even nations get narrower ranges, the others stay.
NEW_RANGE = {
    "source": SUPPLIER_RANGE["source"],
    "cidr": """'10.' || (s_suppkey % 4) || '.' || (s_suppkey * 7 % 251)
        || CASE WHEN s_nationkey % 2 = 0 THEN '.0/25' ELSE '.0/24' END""",
}

# A request that came through a proxy.
PROXIED = {
    "line_no": "line_no",
    "peer_ip": "ip",
    "header_ip": "CASE WHEN line_no % 11 = 0 THEN '' ELSE '203.0.113.' || (line_no % 256) END",
}

# The same responses, spread over the time of the log.
LOG_SNAPSHOT = {**SNAPSHOT, "fetched_at": "CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE {log_time} END"}

# The network that a request came through: a source of snapshots, some unknown.
THROUGH = """CASE WHEN line_no % 61 = 0 THEN NULL WHEN line_no % 3 = 0 THEN 'edge-main'
    ELSE 'edge-' || (line_no % 45) END"""

# Ranges that hold a large part of all addresses, to be added to the long list.
SHORT_PREFIXES = ("10.0.0.0/15", "0.0.0.0/5", "2400::/8")

# The short list; the second range lies inside the first.
TRUSTED = ("10.0.0.0/15", "10.1.0.0/16", "2400:cb00::/32")

SPARK_WORDS = {
    "{log_date}": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
    "{old_date}": "date_format(ts, 'dd-MMM-yyyy:HH:mm:ss')",
    "{text}": "STRING",
    "{order_time}": "timestampadd(MICROSECOND, o_orderkey, CAST(o_orderdate AS TIMESTAMP_NTZ))",
    "{log_time}": "timestampadd(SECOND, o_orderkey * 7919 % 2592000, TIMESTAMP_NTZ '2024-01-01 00:00:00')",
}
DUCKDB_WORDS = {
    "{log_date}": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
    "{old_date}": "strftime(ts, '%d-%b-%Y:%H:%M:%S')",
    "{text}": "VARCHAR",
    "{order_time}": "o_orderdate + to_microseconds(o_orderkey)",
    "{log_time}": "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(o_orderkey * 7919 % 2592000)",
}


def _worded(expression: str, words: dict[str, str]) -> str:
    for word, text in words.items():
        expression = expression.replace(word, text)
    return expression


def duckdb_select(columns: dict[str, str], table: str) -> str:
    listed = ", ".join(f"{_worded(sql, DUCKDB_WORDS)} AS {name}" for name, sql in columns.items())
    return f"SELECT {listed} FROM {table}"


def _derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(_worded(sql, SPARK_WORDS)).alias(name) for name, sql in columns.items()])


def _table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A test table. One that comes in fewer splits than there are cores is spread by its ``key``:
    what follows costs far more per row than moving it. Tables with enough splits are not shuffled.
    """
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(_table(spark, sf_dir, "events", "event_id"), REQUEST)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, value``: the raw lines, blank ones included. Each line is put together once."""
    parts = requests(spark, sf_dir)
    return computed_once(parts, ["line_no"], value=F.expr(LINE))


def append_lines(lines: DataFrame, folder: str) -> None:
    """Add lines to the end of the files in a shared folder, as a server does with its log: each task has a file of its
    own. A task that runs again starts from the size that the file had before.
    """
    names = sorted(name for name in os.listdir(folder) if not name.startswith((".", "_")))
    sizes = [(f"{folder}/{name}", os.path.getsize(f"{folder}/{name}")) for name in names]

    def write(batches):
        path, size = sizes[TaskContext.get().partitionId()]
        with open(path, "r+b") as file:
            file.truncate(size)
            file.seek(size)
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    file.write(line.encode() + b"\n")
                yield batch

    dealt = lines.repartition(len(sizes), "line_no").select("value")
    dealt.mapInArrow(write, "value string").write.format("noop").mode("overwrite").save()


def legacy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(requests(spark, sf_dir), LEGACY_ROW)


def proxied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(requests(spark, sf_dir), PROXIED)


def responses(spark: SparkSession, sf_dir: str, columns: dict[str, str] = SNAPSHOT) -> DataFrame:
    return _derive(_table(spark, sf_dir, "orders", "o_orderkey"), columns)


def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(_table(spark, sf_dir, "customer", "c_custkey"), CONFIG_LINE)


def supplier_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(_table(spark, sf_dir, "supplier", "s_suppkey"), SUPPLIER_RANGE)


def new_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(_table(spark, sf_dir, "supplier", "s_suppkey"), NEW_RANGE)


def ranges_with_short_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = spark.createDataFrame([("wide", cidr) for cidr in SHORT_PREFIXES], "source string, cidr string")
    return supplier_ranges(spark, sf_dir).unionByName(short)


def trusted_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(cidr,) for cidr in TRUSTED], "cidr string")
