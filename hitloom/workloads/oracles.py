"""The same answers as DuckDB SQL over the test tables, written apart from the Spark code."""

from __future__ import annotations

from hitloom.schema import FACT_FIELDS
from hitloom.workloads import inputs
from hitloom.workloads.queries import AS_OF, NUMBERED_SEGMENTS, OMITTED, SECOND_BATCH, TOP_N

FIELDS = (
    "date, remote_ip, http_method, request_uri, status_code, response_size, referrer, user_agent,"
    " non_default, remote_user, authenticated_user"
).replace("\n", "")

NUMBERS = """
    CASE WHEN non_default = '' THEN
        coalesce(try_cast(nullif(regexp_extract(status_code, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0)
    END AS status_int,
    CASE WHEN non_default = '' THEN try_cast(response_size AS BIGINT) END AS bytes"""


def _lines() -> str:
    request = inputs.duckdb_select(inputs.REQUEST, "events")
    return f"requests AS ({request}), lines AS (SELECT line_no, {inputs.LINE} AS line FROM requests)"


def _parsed(omit: str = "", trailing_only: bool = False, strict: bool = False, name: str = "parsed") -> str:
    trim = "rtrim" if trailing_only else "trim"
    omitted = f"OR contains(r, '{omit}')" if omit else ""
    shape = "AND regexp_full_match(t[9], '[0-9]{3}')" if strict else ""
    return f"""{name}_tokens AS (
        SELECT line_no, line, string_split_regex(line, ' +') AS t FROM lines WHERE line <> ''),
    {name}_dated AS (
        SELECT *, CASE WHEN len(t) >= 12 {shape} THEN try_strptime(
            replace(replace(replace(t[4], '"', ''), '[', ''), '/', '-'), '%d-%b-%Y:%H:%M:%S') END AS ts,
            replace(t[7], '"', '') AS u, replace(t[11], '"', '') AS r FROM {name}_tokens),
    {name}_good AS (
        SELECT line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, t[1] AS remote_ip,
            replace(t[6], '"', '') AS http_method,
            CASE WHEN u LIKE '%/' AND length(u) > 1 THEN {trim}(u, '/') ELSE u END AS request_uri,
            t[9] AS status_code, t[10] AS response_size,
            CASE WHEN r = '-' {omitted} THEN '' WHEN r LIKE '%/' THEN {trim}(r, '/') ELSE r END AS referrer,
            replace(array_to_string(t[12:], ' '), '"', '') AS user_agent, '' AS non_default,
            '' AS remote_user, '' AS authenticated_user, ts
        FROM {name}_dated WHERE ts IS NOT NULL),
    {name}_bad AS (
        SELECT line_no, '' AS date, CASE WHEN len(t) >= 12 THEN t[1] ELSE '' END AS remote_ip,
            '' AS http_method, '' AS request_uri, '' AS status_code, '' AS response_size, '' AS referrer,
            '' AS user_agent, line AS non_default, '' AS remote_user, '' AS authenticated_user, ts
        FROM {name}_dated WHERE ts IS NULL),
    {name} AS (
        SELECT *, {NUMBERS} FROM (SELECT * FROM {name}_good UNION ALL SELECT * FROM {name}_bad))"""


KEPT = """kept AS (
        SELECT * FROM parsed WHERE NOT regexp_matches(request_uri, '[.](woff2|js|css)$'))"""


def _counts(source: str, name: str = "counts") -> str:
    return f"""{name} AS (
        SELECT dim, value, count(*) AS count FROM (
            UNPIVOT (SELECT {FIELDS} FROM {source}) ON {FIELDS} INTO NAME dim VALUE value)
        WHERE value <> '' GROUP BY dim, value)"""


# The keys: the first 128 bits of a hash, as text.
_KEY = "left(sha256({}), 32)"


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " " + select


LOG = (_lines(), _parsed(), KEPT)
COUNTED = (*LOG, _counts("kept"))

FAILURES = f"""failures AS (
        SELECT status_code, request_uri, count(*) AS count, min(user_agent) AS user_agent
        FROM kept
        WHERE http_method = 'GET' AND date >= CAST(DATE '{AS_OF}' - INTERVAL 30 DAY AS DATE)::VARCHAR
            AND status_int NOT BETWEEN 200 AND 399 AND request_uri <> '' AND user_agent <> ''
        GROUP BY status_code, request_uri)"""
TOP_FAILURES = f"""top_failures AS (
        SELECT row_number() OVER (ORDER BY count DESC, request_uri, status_code) AS place,
            request_uri || ' with user agent ' || user_agent AS value, count
        FROM failures QUALIFY place <= {TOP_N})"""

LAST = """last AS (
        SELECT date, remote_ip, http_method, request_uri FROM {source}
        WHERE non_default = '' AND remote_ip <> '' AND http_method <> '' AND request_uri <> ''
        ORDER BY line_no DESC LIMIT 1)"""


def _top(dim: str) -> str:
    return _with(
        *COUNTED,
        select=f"SELECT value, count FROM counts WHERE dim = '{dim}' ORDER BY count DESC, value LIMIT {TOP_N}",
    )


def _ranked(report: str, dim: str) -> str:
    return f"""SELECT '{report}' AS report, row_number() OVER (ORDER BY count DESC, value) AS rank,
        value, count FROM counts WHERE dim = '{dim}' QUALIFY rank <= {TOP_N}"""


# The older flat table

_LEGACY = f"legacy AS ({inputs.duckdb_select(inputs.LEGACY_ROW, 'requests')})"
_MIGRATED = """dated AS (
        SELECT *, httpMethod LIKE '%{%' OR contains(httpMethod, chr(92)) AS garbled
        FROM legacy WHERE date IS NOT NULL AND date <> ''),
    cleaned AS (
        SELECT *, CASE WHEN NOT garbled THEN try_strptime(date, '%d-%b-%Y:%H:%M:%S') END AS ts
        FROM dated WHERE garbled OR NOT regexp_matches(requestURI, '[.](woff2|js|xml|css)$')),
    migrated AS (
        SELECT row_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, remoteIP AS remote_ip,
            CASE WHEN httpMethod = '' THEN 'Invalid' ELSE httpMethod END AS http_method,
            requestURI AS request_uri, statusCode AS status_code, responseSize AS response_size,
            referrer, userAgent AS user_agent, '' AS non_default, remoteUser AS remote_user,
            authenticatedUser AS authenticated_user, ts
        FROM cleaned WHERE ts IS NOT NULL
        UNION ALL
        SELECT row_no, '', '', '', '', '', '', '', '', CAST(to_json(struct_pack(date := date,
            remoteIP := remoteIP, httpMethod := httpMethod, requestURI := requestURI,
            statusCode := statusCode, responseSize := responseSize, referrer := referrer,
            userAgent := userAgent, remoteUser := remoteUser,
            authenticatedUser := authenticatedUser)) AS VARCHAR), '', '', ts
        FROM cleaned WHERE ts IS NULL)"""
MIGRATED = (_lines(), _LEGACY, _MIGRATED)

# Trusted ranges

def _api(columns: dict[str, str]) -> str:
    return f"responses AS ({inputs.duckdb_select(columns, 'orders')}),{_VALID}"


_VALID = """
    valid AS (
        SELECT source, fetched_at, body->>'$.result.etag' AS etag, body FROM (
            SELECT source, fetched_at, try_cast(body AS JSON) AS body FROM responses)
        WHERE body->>'$.success' = 'true' AND json_type(body, '$.result.ipv4_cidrs') = 'ARRAY'
            AND json_type(body, '$.result.ipv6_cidrs') = 'ARRAY'),
    ranges AS (
        SELECT source, fetched_at, etag, 32 AS family,
            unnest(CAST(body->'$.result.ipv4_cidrs' AS VARCHAR[])) AS cidr FROM valid
        UNION ALL
        SELECT source, fetched_at, etag, 128 AS family,
            unnest(CAST(body->'$.result.ipv6_cidrs' AS VARCHAR[])) AS cidr FROM valid)"""
_API = _api(inputs.SNAPSHOT)

# The generated IPv6 ranges have two groups and then zeros.
_NET_BITS = """CASE WHEN family = 32 THEN
        left(array_to_string(list_transform(string_split(addr, '.'), lambda o: lpad(bin(CAST(o AS INTEGER)), 8, '0')), ''), len)
        ELSE left(lpad(bin(CAST('0x' || split_part(addr, ':', 1) AS INTEGER)), 16, '0')
            || lpad(bin(CAST('0x' || split_part(addr, ':', 2) AS INTEGER)), 16, '0')
            || repeat('0', 96), len) END"""

_SETS = f"""current_set AS (
        SELECT *, 32 AS family FROM ({inputs.duckdb_select(inputs.SUPPLIER_RANGE, 'supplier')})),
    new_set AS (
        SELECT *, 32 AS family FROM ({inputs.duckdb_select(inputs.NEW_RANGE, 'supplier')}))"""

# Membership by comparing numbers, not bits. IPv6 addresses of the log are told apart by their start.
_ADDRESS = """CASE WHEN contains({ip}, ':') OR {ip} = '' THEN NULL ELSE
        CAST(split_part({ip}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({ip}, '.', 2) AS BIGINT) * 65536
        + CAST(split_part({ip}, '.', 3) AS BIGINT) * 256 + CAST(split_part({ip}, '.', 4) AS BIGINT) END"""
_SHORT_LIST = f"""short_list AS (
        SELECT {_ADDRESS.format(ip="split_part(cidr, '/', 1)")} AS low,
            CAST(pow(2, 32 - CAST(split_part(cidr, '/', 2) AS INTEGER)) AS BIGINT) AS size
        FROM (SELECT unnest({[c for c in inputs.TRUSTED if ":" not in c]}) AS cidr))"""
_LONG_LIST = f"""long_list AS (
        SELECT DISTINCT {_ADDRESS.format(ip="split_part(cidr, '/', 1)")} AS low, 256 AS size
        FROM ({inputs.duckdb_select(inputs.SUPPLIER_RANGE, 'supplier')}))"""
_GOOD = f"""good AS (
        SELECT line_no, remote_ip, bytes, {_ADDRESS.format(ip="remote_ip")} AS address
        FROM parsed)"""


def _labelled(listed: str, ipv6_start: str | None) -> str:
    ipv6 = f"OR remote_ip LIKE '{ipv6_start}%'" if ipv6_start else ""
    return f"""labelled AS (
        SELECT line_no, remote_ip, bytes, coalesce(EXISTS (
            SELECT 1 FROM {listed} WHERE address >= low AND address < low + size), false) {ipv6} AS trusted
        FROM good)"""


SHORT = (*LOG, _GOOD, _SHORT_LIST, _labelled("short_list", "2400:cb00:"))
LONG = (*LOG, _GOOD, _LONG_LIST, _labelled("long_list", None))

_RECORD = f"line_no, {FIELDS}, ts, status_int, bytes"
_DIM_COUNTS = _with(*COUNTED, select="SELECT dim, value, count FROM counts")

ORACLES: dict[str, str] = {
    "log_lines": _with(_lines(), select="SELECT line AS value FROM lines WHERE line <> ''"),
    "parse_log": _with(_lines(), _parsed(), select=f"SELECT {_RECORD} FROM parsed"),
    "parse_strict": _with(_lines(), _parsed(strict=True), select=f"SELECT {_RECORD} FROM parsed"),
    "rejects": _with(
        _lines(), _parsed(), select="SELECT line_no, remote_ip, non_default FROM parsed WHERE non_default <> ''"
    ),
    "filter_assets": _with(*LOG, select="SELECT line_no, http_method, request_uri, non_default FROM kept"),
    "normalize_uri": _with(
        _lines(),
        _parsed(),
        _parsed(trailing_only=True, name="rtrimmed"),
        select="""SELECT p.line_no, p.request_uri, t.request_uri AS trailing_only_uri
            FROM parsed p JOIN rtrimmed t USING (line_no) WHERE p.non_default = ''""",
    ),
    "normalize_referrer": _with(
        _lines(), _parsed(), select="SELECT line_no, referrer FROM parsed WHERE non_default = ''"
    ),
    "omit_referrer": _with(
        _lines(), _parsed(omit=OMITTED), select="SELECT line_no, referrer FROM parsed WHERE non_default = ''"
    ),
    "dim_counts": _DIM_COUNTS,
    "dim_counts_merge": _DIM_COUNTS,
    "top_ips": _top("remote_ip"),
    "top_uris": _top("request_uri"),
    "top_referrers": _top("referrer"),
    "top_non_defaults": _top("non_default"),
    "top_unsuccessful": _with(*LOG, FAILURES, TOP_FAILURES, select="SELECT value, count FROM top_failures"),
    "top_unsuccessful_star": _with(*LOG, FAILURES, TOP_FAILURES, select="SELECT value, count FROM top_failures"),
    "unsuccessful_groups": _with(
        *LOG, FAILURES, select="SELECT status_code, request_uri, count, user_agent FROM failures"
    ),
    "report_ranked": _with(
        *COUNTED,
        FAILURES,
        TOP_FAILURES,
        select=" UNION ALL ".join(
            [
                _ranked("top_ips", "remote_ip"),
                _ranked("top_uris", "request_uri"),
                _ranked("top_referrers", "referrer"),
                _ranked("top_non_defaults", "non_default"),
                """SELECT 'top_unsuccessful' AS report, row_number() OVER (ORDER BY count DESC, value) AS rank,
                    value, count FROM top_failures""",
            ]
        ),
    ),
    "star_dims": _with(*COUNTED, select=f"SELECT dim, {_KEY.format('value')} AS id, value, count FROM counts"),
    "star_fact": _with(
        *LOG,
        select="SELECT line_no, "
        + ", ".join(f"CASE WHEN {name} <> '' THEN {_KEY.format(name)} END AS {name}_id" for name in FACT_FIELDS)
        + " FROM kept WHERE non_default = ''",
    ),
    "star_roundtrip": _with(
        *LOG,
        select=f"SELECT line_no, {FIELDS.replace(' non_default,', '')} FROM kept WHERE non_default = ''",
    ),
    "last_row": _with(*LOG, LAST.format(source="kept"), select="SELECT * FROM last"),
    "resume_after": _with(
        *LOG,
        f"stored AS (SELECT * FROM kept WHERE ts < TIMESTAMP '{SECOND_BATCH}')",
        LAST.format(source="stored"),
        """anchor AS (SELECT min(k.line_no) AS line_no FROM kept k JOIN last USING
            (date, remote_ip, http_method, request_uri))""",
        select="""SELECT k.line_no, k.date, k.remote_ip, k.http_method, k.request_uri, k.non_default
            FROM kept k, anchor WHERE anchor.line_no IS NULL OR k.line_no > anchor.line_no""",
    ),
    "v1_total": _with(*MIGRATED, select="SELECT count(*) AS total FROM legacy"),
    "v1_rows": _with(*MIGRATED, select=f"SELECT row_no, {FIELDS}, ts FROM migrated WHERE non_default = ''"),
    "v1_quarantine": _with(*MIGRATED, select="SELECT row_no, non_default FROM migrated WHERE non_default <> ''"),
    "v1_star": _with(*MIGRATED, _counts("migrated"), select="SELECT dim, value, count FROM counts"),
    "cidr_from_api": _with(_API, select="SELECT source, fetched_at, etag, family, cidr FROM ranges"),
    "cidr_from_conf": _with(
        f"config AS ({inputs.duckdb_select(inputs.CONFIG_LINE, 'customer')})",
        """etags AS (
            SELECT file, first(substr(value, 14) ORDER BY line_no) AS etag
            FROM config WHERE starts_with(value, '# Last etag: ') GROUP BY file)""",
        select="""SELECT file, line_no, coalesce(etag, '') AS etag,
            CASE WHEN contains(value, ':') THEN 128 ELSE 32 END AS family,
            replace(split_part(value, ' ', 2), ';', '') AS cidr
            FROM config LEFT JOIN etags USING (file)
            WHERE regexp_full_match(value, '[^ ]* [0-9][^ ]*')""",
    ),
    "cidr_parts": _with(
        _API,
        """parts AS (SELECT source, fetched_at, cidr, split_part(cidr, '/', 1) AS addr,
            CAST(split_part(cidr, '/', 2) AS INTEGER) AS len, family FROM ranges)""",
        select=f"SELECT *, {_NET_BITS} AS net_bits FROM parts",
    ),
    "cidr_changed": _with(
        _SETS,
        """old AS (SELECT source, family, list(cidr ORDER BY cidr) AS cidrs FROM current_set GROUP BY ALL),
        new AS (SELECT source, family, list(cidr ORDER BY cidr) AS cidrs FROM new_set GROUP BY ALL)""",
        select="""SELECT source, family, old.cidrs IS DISTINCT FROM new.cidrs AS changed
            FROM old FULL JOIN new USING (source, family)""",
    ),
    "cidr_set_diff": _with(
        _SETS,
        select="""SELECT *, 'added' AS change FROM (
                SELECT source, family, cidr FROM new_set EXCEPT SELECT source, family, cidr FROM current_set)
            UNION ALL SELECT *, 'removed' AS change FROM (
                SELECT source, family, cidr FROM current_set EXCEPT SELECT source, family, cidr FROM new_set)""",
    ),
    "cidr_diff": _with(
        _API,
        """steps AS (
            SELECT source, fetched_at,
                row_number() OVER (PARTITION BY source ORDER BY fetched_at NULLS FIRST) AS step
            FROM (SELECT DISTINCT source, fetched_at FROM valid)),
        present AS (SELECT DISTINCT source, fetched_at, family, cidr FROM ranges),
        numbered AS (
            SELECT p.*, s.step FROM present p JOIN steps s
            ON p.source IS NOT DISTINCT FROM s.source AND p.fetched_at IS NOT DISTINCT FROM s.fetched_at),
        earlier AS (
            SELECT s.source, s.fetched_at, p.family, p.cidr FROM steps s
            JOIN numbered p ON p.source IS NOT DISTINCT FROM s.source AND p.step = s.step - 1)""",
        select="""SELECT *, 'added' AS change FROM (SELECT * FROM present EXCEPT SELECT * FROM earlier)
            UNION ALL
            SELECT *, 'removed' AS change FROM (SELECT * FROM earlier EXCEPT SELECT * FROM present)""",
    ),
    "etag_changes": _with(
        _API,
        """stepped AS (SELECT source, fetched_at, etag,
            coalesce(lag(etag) OVER (PARTITION BY source ORDER BY fetched_at NULLS FIRST, etag), '') AS previous_etag
            FROM (SELECT DISTINCT source, fetched_at, etag FROM valid))""",
        select="SELECT * FROM stepped WHERE etag <> previous_etag",
    ),
    "trust_label": _with(*SHORT, select="SELECT line_no, remote_ip, bytes, trusted FROM labelled"),
    "trust_label_long_list": _with(*LONG, select="SELECT line_no, remote_ip, bytes, trusted FROM labelled"),
    "trusted_requests": _with(*LONG, select="SELECT line_no, remote_ip, bytes FROM labelled WHERE trusted"),
    "untrusted_requests": _with(*LONG, select="SELECT line_no, remote_ip, bytes FROM labelled WHERE NOT trusted"),
    "block_counters": _with(
        *SHORT,
        select="""SELECT CASE WHEN contains(remote_ip, ':') THEN 128 ELSE 32 END AS family,
            count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes
            FROM labelled WHERE NOT trusted GROUP BY 1""",
    ),
    "restore_real_ip": _with(
        _lines(),
        f"proxied AS ({inputs.duckdb_select(inputs.PROXIED, 'requests')})",
        f"""good AS (SELECT line_no, peer_ip AS remote_ip, header_ip AS bytes,
            {_ADDRESS.format(ip="peer_ip")} AS address FROM proxied)""",
        _SHORT_LIST,
        _labelled("short_list", "2400:cb00:"),
        select="""SELECT line_no, remote_ip AS peer_ip, bytes AS header_ip,
            CASE WHEN trusted AND bytes <> '' THEN bytes ELSE remote_ip END AS remote_ip FROM labelled""",
    ),
    "stream_ingest": _with(*LOG, select=f"SELECT {FIELDS}, ts, status_int, bytes FROM kept"),
    "stream_counts": _DIM_COUNTS,
    "stream_late_segments": _DIM_COUNTS,
    "star_migrate_then_stream": _with(
        *LOG,
        *MIGRATED[1:],
        _counts("kept", "log_counts"),
        _counts("migrated", "old_counts"),
        select="""SELECT dim, value, CAST(sum(count) AS BIGINT) AS count
            FROM (SELECT * FROM log_counts UNION ALL SELECT * FROM old_counts) GROUP BY dim, value
            UNION ALL SELECT 'fact', 'rows', (SELECT count(*) FROM kept WHERE non_default = '')
                + (SELECT count(*) FROM migrated WHERE non_default = '')""",
    ),
}

# A prefix belongs to the cover if ranges fill it and don't fill its parent. Each range counts as its share of the prefix.
ORACLES["cidr_cover"] = _with(
    _API,
    f"""nets AS (
        SELECT DISTINCT source, family, {_NET_BITS} AS net_bits FROM (
            SELECT source, family, split_part(cidr, '/', 1) AS addr, CAST(split_part(cidr, '/', 2) AS INTEGER) AS len FROM ranges)),
    outer_nets AS (
        SELECT * FROM nets n WHERE NOT EXISTS (SELECT 1 FROM nets o WHERE o.source IS NOT DISTINCT FROM n.source
            AND o.family = n.family AND length(o.net_bits) < length(n.net_bits) AND starts_with(n.net_bits, o.net_bits))),
    filled AS (
        SELECT source, family, prefix AS net_bits FROM (
            SELECT *, left(net_bits, len) AS prefix, len - length(net_bits) AS share
            FROM (SELECT *, unnest(range(length(net_bits) + 1)) AS len FROM outer_nets))
        GROUP BY source, family, prefix HAVING sum(pow(2, share)) = 1),
    cover AS (
        SELECT * FROM filled f WHERE NOT EXISTS (SELECT 1 FROM filled p WHERE p.source IS NOT DISTINCT FROM f.source
            AND p.family = f.family AND p.net_bits = left(f.net_bits, greatest(length(f.net_bits) - 1, 0))
            AND length(f.net_bits) > 0))""",
    select="""SELECT source, family, CAST(length(net_bits) AS INTEGER) AS len, net_bits,
        CASE WHEN family = 32 THEN array_to_string(list_transform(range(4),
                lambda i: CAST(CAST(substr(rpad(net_bits, 32, '0'), CAST(8 * i + 1 AS INTEGER), 8) AS BIT) AS INTEGER)), '.')
            ELSE array_to_string(list_transform(range(8),
                lambda i: printf('%x', CAST(CAST(substr(rpad(net_bits, 128, '0'), CAST(16 * i + 1 AS INTEGER), 16) AS BIT) AS INTEGER))), ':')
            END || '/' || length(net_bits) AS cidr FROM cover""",
)
ORACLES["trust_label_short_prefixes"] = _with(
    *LOG,
    _GOOD,
    f"""long_list AS (
        SELECT DISTINCT {_ADDRESS.format(ip="split_part(cidr, '/', 1)")} AS low,
            CAST(pow(2, 32 - CAST(split_part(cidr, '/', 2) AS INTEGER)) AS BIGINT) AS size
        FROM (SELECT cidr FROM ({inputs.duckdb_select(inputs.SUPPLIER_RANGE, 'supplier')})
            UNION ALL SELECT unnest({[c for c in inputs.SHORT_PREFIXES if ":" not in c]})))""",
    _labelled("long_list", "24"),
    select="SELECT line_no, remote_ip, bytes, trusted FROM labelled",
)
# The log's IPv6 addresses have nothing in common with a range but its first two groups.
ORACLES["trust_as_of"] = _with(
    *LOG,
    _api(inputs.LOG_SNAPSHOT),
    f"""asked AS (
        SELECT line_no, remote_ip, ts, {inputs.THROUGH} AS source, {_ADDRESS.format(ip="remote_ip")} AS address FROM parsed),
    moments AS (SELECT DISTINCT source, fetched_at FROM valid WHERE fetched_at IS NOT NULL),
    latest AS (
        SELECT a.line_no, max(m.fetched_at) AS fetched_at FROM asked a
        JOIN moments m ON m.source IS NOT DISTINCT FROM a.source AND m.fetched_at <= a.ts GROUP BY a.line_no),
    hits AS (
        SELECT DISTINCT a.line_no FROM asked a JOIN latest l USING (line_no)
        JOIN ranges r ON r.source IS NOT DISTINCT FROM a.source AND r.fetched_at = l.fetched_at
        WHERE CASE WHEN r.family = 128 THEN starts_with(a.remote_ip, replace(r.cidr, ':/32', ''))
            ELSE a.address // CAST(pow(2, 32 - CAST(split_part(r.cidr, '/', 2) AS INTEGER)) AS BIGINT)
                = {_ADDRESS.format(ip="split_part(r.cidr, '/', 1)")} // CAST(pow(2, 32 - CAST(split_part(r.cidr, '/', 2) AS INTEGER)) AS BIGINT) END)""",
    select="SELECT line_no, remote_ip, ts, source, line_no IN (SELECT line_no FROM hits) AS trusted FROM asked",
)
ORACLES["stream_range_changes"] = _with(
    _API,
    """sorted AS (
        SELECT source, fetched_at, etag, list_sort(list_distinct(
            CAST(body->'$.result.ipv4_cidrs' AS VARCHAR[]) || CAST(body->'$.result.ipv6_cidrs' AS VARCHAR[]))) AS nets FROM valid),
    listed AS (
        SELECT source, fetched_at, etag, min(CASE WHEN len(nets) > 0 THEN sha256(array_to_string(nets, chr(10))) ELSE '' END) AS digest
        FROM sorted GROUP BY ALL),
    stepped AS (
        SELECT source, fetched_at, etag, coalesce(lag(etag) OVER w, '') AS previous_etag, digest, coalesce(lag(digest) OVER w, '') AS previous_digest
        FROM listed WINDOW w AS (PARTITION BY source ORDER BY fetched_at NULLS FIRST, etag))""",
    select="""SELECT source, fetched_at, etag, previous_etag, etag <> previous_etag AS etag_changed, digest <> previous_digest AS set_changed
        FROM stepped WHERE etag <> previous_etag OR digest <> previous_digest""",
)
ORACLES["v1_star_chunks"] = _with(
    *MIGRATED,
    _counts("migrated"),
    select="""SELECT dim, value, count FROM counts
        UNION ALL SELECT 'fact', 'rows', (SELECT count(*) FROM migrated WHERE non_default = '')""",
)
ORACLES["numbered_log"] = _with(
    _lines(),
    f"""numbered AS (SELECT line_no % {NUMBERED_SEGMENTS} AS segment, line AS value,
        row_number() OVER (PARTITION BY line_no % {NUMBERED_SEGMENTS} ORDER BY line_no) AS line_no FROM lines)""",
    select="SELECT * FROM numbered WHERE value <> ''",
)
ORACLES["stream_growing_log"] = _DIM_COUNTS
ORACLES["report_stored"] = ORACLES["report_compacted"] = ORACLES["report_ranked"]
ORACLES["star_roundtrip_shuffled"] = ORACLES["star_roundtrip"]
ORACLES["resume_stored"] = ORACLES["resume_after"]
ORACLES["failures_by_day"] = _with(
    *LOG,
    select="""SELECT CAST(left(date, 10) AS DATE) AS day, status_code, request_uri, count(*) AS count, min(user_agent) AS user_agent
        FROM kept
        WHERE http_method = 'GET' AND date <> '' AND status_int NOT BETWEEN 200 AND 399 AND request_uri <> '' AND user_agent <> ''
        GROUP BY ALL""",
)
ORACLES["last_row_batches"] = _with(
    *LOG,
    "odd_lines AS (SELECT * FROM kept WHERE line_no % 2 = 1)",
    LAST.format(source="odd_lines"),
    select="SELECT * FROM last",
)
