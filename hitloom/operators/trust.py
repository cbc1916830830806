"""Which requests come from trusted address ranges.

Nothing here compares every address with every range. The caller chooses between two ways. Short lists become hash sets of
bit prefixes inside the filter itself: rows, of a stream too, are labelled where they are read, without a shuffle; a list that is
too long is refused. With a folder for tables, lists of any length become intervals, and the distinct addresses
of a batch are passed along them in order, so that a range with most of the addresses is spread like any other; labels are looked up in a way
that hot addresses cannot skew. Trust can also be asked as of the time of a request.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.addresses import IPV4, IPV6, family, interval_of, point_of, with_address_bits, with_cidr_parts
from hitloom.operators.intervals import points_inside
from hitloom.operators.lookups import skew_proof_lookup
from hitloom.operators.neighbors import with_neighbor

# Proxy networks publish tens to a few thousand ranges. A list beyond this size must be joined.
INLINE_LIMIT = 5_000


def prefixes(ranges: DataFrame) -> DataFrame:
    """Distinct valid ``family, len, net_bits`` of a table with a ``cidr`` column."""
    return (
        with_cidr_parts(ranges.select("cidr"))
        .filter(F.col("net_bits").isNotNull())
        .select("family", "len", "net_bits")
        .distinct()
    )


def _inline_sets(known: DataFrame) -> dict[tuple[int, int], list[str]]:
    """The prefixes by family and length. At most ``INLINE_LIMIT + 1`` short rows are fetched: this is the size check."""
    found = known.limit(INLINE_LIMIT + 1).collect()
    if len(found) > INLINE_LIMIT:
        raise ValueError(f"more than {INLINE_LIMIT} ranges: give a folder, so that they can be joined")
    sets: dict[tuple[int, int], list[str]] = defaultdict(list)
    for row in found:
        sets[row["family"], row["len"]].append(row["net_bits"])
    return dict(sets)


def _in_sets(bits: Column, sets: dict[tuple[int, int], list[str]]) -> Column:
    def in_family(size: int) -> Column:
        member = F.lit(False)
        for (of_family, length), values in sorted(sets.items()):
            if of_family == size:
                member = member | F.substring(bits, 1, length).isin(values)
        return member

    return (
        F.when(F.length(bits) == IPV4, in_family(IPV4))
        .when(F.length(bits) == IPV6, in_family(IPV6))
        .otherwise(F.lit(False))
    )


def label_addresses(addresses: DataFrame, known: DataFrame, path: str, address: str = "address") -> DataFrame:
    """Append ``trusted``, true or NULL, to ``addresses``, which has one row per address. ``path`` takes tables."""
    low, end = interval_of(F.col("net_bits"), F.col("family"))
    ranges = known.select("family", low.alias("low"), end.alias("end"))
    valid = with_address_bits(addresses.select(address), address).filter(F.col("bits").isNotNull())
    points = valid.select(address, F.length("bits").alias("family"), point_of(F.col("bits")).alias("_point"))
    inside = points_inside(points, ranges, ["family"], "_point", f"{path}/points").select(address)
    return addresses.join(inside.withColumn("trusted", F.lit(True)), address, "left")


def label_trusted(
    requests: DataFrame,
    ranges: DataFrame,
    address: str = "remote_ip",
    folder: str | None = None,
) -> DataFrame:
    """Append ``trusted BOOLEAN``. An invalid, empty or NULL address is untrusted; every row is kept.

    Without ``folder`` the list must be short. With one, which all executors share, ordered addresses and their labels are stored there.
    """
    known = prefixes(ranges)
    if folder is None:
        sets = _inline_sets(known)
        with_bits = with_address_bits(requests, address, "_address_bits")
        label = _in_sets(F.col("_address_bits"), sets)
        return with_bits.select(*requests.columns, label.alias("trusted"))

    # One pass over the requests counts each address; the labels are stored, so that nothing is
    # worked out again for the parts of the lookup. Hot addresses are known from their counts.
    counted = requests.groupBy(F.col(address).alias("address")).agg(F.count(F.lit(1)).alias("_n"))
    spark = requests.sparkSession
    label_addresses(counted, known, folder).write.parquet(f"{folder}/labels")
    labels = spark.read.parquet(f"{folder}/labels").filter(F.col("address").isNotNull())
    labelled = skew_proof_lookup(
        requests, address, labels, "address", "trusted", "_n", "trusted", requests.columns
    )
    return labelled.withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def trusted_requests(
    requests: DataFrame, ranges: DataFrame, address: str = "remote_ip", folder: str | None = None
) -> DataFrame:
    return label_trusted(requests, ranges, address, folder).filter("trusted").drop("trusted")


def untrusted_requests(
    requests: DataFrame, ranges: DataFrame, address: str = "remote_ip", folder: str | None = None
) -> DataFrame:
    return label_trusted(requests, ranges, address, folder).filter("not trusted").drop("trusted")


def block_counters(
    requests: DataFrame,
    ranges: DataFrame,
    address: str = "remote_ip",
    size: str = "bytes",
    folder: str | None = None,
) -> DataFrame:
    """``family, requests, bytes`` over untrusted rows, those without an address included.

    Only sums are wanted, so rows are summed per address first: the label is worked out once per
    address, and no row is shuffled for it. With ``folder``, as above, for lists of any length.
    """
    per_address = requests.groupBy(F.col(address).alias("address")).agg(
        F.count(F.lit(1)).alias("_requests"), F.sum(size).alias("_bytes")
    )
    known = prefixes(ranges)
    if folder is not None:
        labelled = label_addresses(per_address, known, folder)
    else:
        sets = _inline_sets(known)
        with_bits = with_address_bits(per_address, "address", "_address_bits")
        labelled = with_bits.withColumn("trusted", _in_sets(F.col("_address_bits"), sets))
    blocked = labelled.filter(~F.coalesce("trusted", F.lit(False)))
    return blocked.groupBy(family(F.col("address")).alias("family")).agg(
        F.sum("_requests").alias("requests"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes")
    )


def restore_addresses(
    proxied: DataFrame,
    ranges: DataFrame,
    peer: str = "peer_ip",
    header: str = "header_ip",
    folder: str | None = None,
) -> DataFrame:
    """Append ``remote_ip``: the header's address if the peer is trusted and sent one, else the peer."""
    labelled = label_trusted(proxied, ranges, peer, folder)
    restored = F.when(F.col("trusted") & (F.coalesce(header, F.lit("")) != ""), F.col(header))
    return labelled.select(*proxied.columns, F.coalesce(restored, F.col(peer)).alias("remote_ip"))


def label_trusted_then(
    requests: DataFrame,
    snapshots: DataFrame,
    path: str,
    address: str = "remote_ip",
    moment: str = "ts",
    source: str = "source",
) -> DataFrame:
    """Append ``trusted BOOLEAN``: was the address in the ranges that the request's source had published last at that time?

    A snapshot holds from its time until the next of its source; of one time, all count together, and one with empty lists trusts nobody.
    Snapshots without a time never hold. Requests before the first snapshot, without a time or a valid address are untrusted. A NULL source is a source like others.
    Each prefix gets the stretches of time in which it was listed; a request is looked up among those of its own prefixes, one for each
    length in use, in order of time, so that a hot source or prefix is spread. ``path``, shared by all executors, takes tables.
    """
    spark = requests.sparkSession
    timed = snapshots.filter(F.col("fetched_at").isNotNull())
    moments = timed.groupBy("source", "fetched_at").agg(
        F.array_distinct(F.flatten(F.collect_set(F.concat("ipv4_cidrs", "ipv6_cidrs")))).alias("_cidrs")
    )
    followed = with_neighbor(moments, "source", "fetched_at", "fetched_at", "_until", f"{path}/snapshots", following=True)
    kind = timed.schema["fetched_at"].dataType.simpleString()
    until = F.coalesce("_until", F.lit("9999-12-31 23:59:59").cast(kind))
    listed = followed.select("source", F.col("fetched_at").alias("low"), until.alias("end"), F.explode("_cidrs").alias("cidr"))
    known = with_cidr_parts(listed).filter("net_bits is not null").select("source", "family", "net_bits", "low", "end")
    known.write.parquet(f"{path}/listed")
    held = spark.read.parquet(f"{path}/listed")
    # At most 33 and 129 rows.
    lengths = held.select("family", F.length("net_bits").alias("_len")).distinct()

    asked = requests.select(F.col(f"`{source}`").alias("source"), F.col(f"`{address}`").alias("_address"), F.col(f"`{moment}`").cast(kind).alias("_at"))
    asked = asked.filter("_address is not null and _at is not null").distinct()
    valid = with_address_bits(asked, "_address").filter("bits is not null").withColumn("family", F.length("bits"))
    prefixed = valid.join(F.broadcast(lengths), "family").select(
        "source", "family", F.substring(F.col("bits"), F.lit(1), F.col("_len")).alias("net_bits"), "_address", "_at"
    )
    inside = points_inside(prefixed, held, ["source", "family", "net_bits"], "_at", f"{path}/requests")
    inside = inside.select(F.col("source").alias("_source"), F.col("_address").alias("_ip"), F.col("_at").alias("_then")).distinct()
    same = (
        F.col(f"`{source}`").eqNullSafe(F.col("_source"))
        & (F.col(f"`{address}`") == F.col("_ip"))
        & (F.col(f"`{moment}`").cast(kind) == F.col("_then"))
    )
    labelled = requests.join(inside.withColumn("_found", F.lit(True)), same, "left")
    return labelled.select(*[F.col(f"`{c}`") for c in requests.columns], F.coalesce("_found", F.lit(False)).alias("trusted"))
