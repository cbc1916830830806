"""Star schema: one long dimension table with counts, and a fact table of keys.

A key is a hash of its value. It needs no lookup and no global numbering, and it is the same in
every batch, backfill and retry. It has 128 bits of a hash that nobody can make collide at will, and reading
dimensions checks it all the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.numbers import unsuccessful
from hitloom.operators.lookups import skew_proof_lookup
from hitloom.operators.records import parsed_only
from hitloom.schema import FACT_FIELDS

# Dimensions whose values take up at most this many bytes, keys included, are broadcast whole when
# rows are read back.
SMALL_DIMENSION = 16 * 1024 * 1024
KEY_BYTES = 16

ROW_ORDER = ("commit", "position")


def value_key(value: Column) -> Column:
    """16 bytes."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * KEY_BYTES))


def key_text(key: Column) -> Column:
    return F.lower(F.hex(key))


def with_keys(counts: DataFrame) -> DataFrame:
    """Dimension rows: ``dim, id, value, count``."""
    return counts.select("dim", value_key(F.col("value")).alias("id"), "value", "count")


def _least_and_greatest() -> list[Column]:
    return [F.min("value").alias("value"), F.max("value").alias("_other")]


def checked_dimensions(counts: DataFrame) -> DataFrame:
    """One row per key of ``counts``, with their sum: ``dim, id, value, count``.

    ``counts`` may hold a value more than once, with or without its ``id``. It fails if one key of a dimension stands for
    two values: the one grouping compares the least and the greatest value of a key.
    """
    keyed = counts if "id" in counts.columns else with_keys(counts)
    found = keyed.groupBy("dim", "id").agg(*_least_and_greatest(), F.sum("count").alias("count"))
    clash = F.raise_error(F.concat(F.lit("two values share a key in "), F.col("dim"))).cast("bigint")
    count = F.when(F.col("value") == F.col("_other"), F.col("count")).otherwise(clash)
    return found.select("dim", "id", "value", count.alias("count"))


def _texts_by_key(dimensions: DataFrame) -> DataFrame:
    """``id, value`` of several dimensions, a key once; checked in the same way."""
    found = dimensions.groupBy("id").agg(*_least_and_greatest())
    clash = F.raise_error(F.lit("two values share a key in different dimensions")).cast("string")
    value = F.when(F.col("value") == F.col("_other"), F.col("value")).otherwise(clash)
    return found.select("id", value.alias("value"))


def fact_rows(records: DataFrame, order: Sequence[str] = ("line_no",)) -> DataFrame:
    """One row of keys per parsed record; an empty value has a NULL key. No join is needed."""
    keys = [
        F.when(F.col(name) != "", value_key(F.col(name))).alias(f"{name}_id") for name in FACT_FIELDS
    ]
    return parsed_only(records).select(*order, *keys)


def read_back(
    fact: DataFrame, dimensions: DataFrame, order: Sequence[str] = ROW_ORDER, small: int | None = None
) -> DataFrame:
    """Fact rows with their values again. Give a stored ``dimensions``: it is read per field.

    The sizes of the dimensions are checked first. The smallest ones, of at most ``small`` bytes together, by default
    ``SMALL_DIMENSION``, are one broadcast table that all their fields look into, as a key stands for the same value in each
    dimension; the others go through the lookup that splits off hot keys.
    """
    small = SMALL_DIMENSION if small is None else small
    value_bytes = F.octet_length("value") + KEY_BYTES
    sizes = dict(dimensions.groupBy("dim").agg(F.sum(value_bytes)).collect())
    together, held = [], 0
    for name in sorted(FACT_FIELDS, key=lambda n: (sizes.get(n, 0), n)):
        held += sizes.get(name, 0)
        if held > small:
            break
        together.append(name)
    texts = _texts_by_key(dimensions.filter(F.col("dim").isin(together)))
    rows = fact
    for name in FACT_FIELDS:
        if name in together:
            values = texts.select(F.col("id").alias(f"{name}_id"), F.col("value").alias(name))
            rows = rows.join(F.broadcast(values), f"{name}_id", "left")
        else:
            lookup = dimensions.filter(F.col("dim") == name).select("id", "value", "count")
            spread = [*order, f"{name}_id"]
            rows = skew_proof_lookup(rows, f"{name}_id", lookup, "id", "value", "count", name, spread)
    return rows.select(*order, *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in FACT_FIELDS])


# The fields that identify the last stored row.
LAST_ROW_FIELDS = ("date", "remote_ip", "http_method", "request_uri")


def last_row(fact: DataFrame, counts: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Date, address, method and URI of the last fact row that has all four; no row if none has.

    The row is picked first, so the dimension table meets four broadcast keys instead of the fact.
    ``counts`` may list a value more than once: stored counts do as they are, without a sum.
    """
    last = last_keys(fact, order).select(
        F.stack(
            F.lit(len(LAST_ROW_FIELDS)),
            *[c for n in LAST_ROW_FIELDS for c in (F.lit(n), F.col(f"{n}_id"))],
        ).alias("dim", "id")
    )
    return named_last_row(last, counts)


def last_keys(fact: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """The four keys of the last fact row that has all of them; no row if none has. One row a task is shuffled."""
    keys = [f"{name}_id" for name in LAST_ROW_FIELDS]
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return fact.filter(complete).orderBy(*[F.desc(column) for column in order]).limit(1).select(*keys)


def named_last_row(last: DataFrame, counts: DataFrame) -> DataFrame:
    """The texts of the keys of one row, given as ``dim, id``; ``counts`` may list a value more than once."""
    wanted = counts.filter(F.col("dim").isin(*LAST_ROW_FIELDS))
    found = wanted.join(F.broadcast(last), ["dim", "id"])
    picked = [F.max(F.when(F.col("dim") == n, F.col("value"))).alias(n) for n in LAST_ROW_FIELDS]
    return found.agg(*picked, F.count(F.lit(1)).alias("_n")).filter("_n > 0").drop("_n")


def _values_of(counts: DataFrame, name: str) -> DataFrame:
    """Different values of a dimension: ``{name}_id`` and ``name``. ``counts`` may repeat them."""
    values = counts.filter(F.col("dim") == name)
    return values.select(F.col("id").alias(f"{name}_id"), F.col("value").alias(name)).distinct()


def held_small(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """``df``, to be broadcast if its keys and texts take up at most ``SMALL_DIMENSION`` bytes."""
    size = sum((F.octet_length(t) for t in texts), F.lit(KEY_BYTES))
    held = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= SMALL_DIMENSION else df


def top_failures(fact: DataFrame, counts: DataFrame, since: Column, n: int, method: str = "GET") -> DataFrame:
    """The ``n`` most frequent unsuccessful requests by status and URI since a day, through the star.

    Days are folders of the fact, so older ones aren't read. The method's key is known without a
    lookup; keys of failed statuses are broadcast if they are small. All counting is on keys: groups
    that reach the n-th count are found first, and texts are fetched for those only.
    """
    statuses = held_small(_values_of(counts, "status_code").filter(unsuccessful(F.col("status_code"))), ["status_code"])
    failed = fact.filter(
        (F.col("day") >= since)
        & (F.col("http_method_id") == value_key(F.lit(method)))
        & F.col("request_uri_id").isNotNull()
        & F.col("user_agent_id").isNotNull()
    ).join(statuses, "status_code_id")
    counted = failed.groupBy("status_code_id", "status_code", "request_uri_id", "user_agent_id").agg(
        F.count(F.lit(1)).alias("_n")
    )
    totals = counted.groupBy("status_code", "request_uri_id").agg(F.sum("_n").alias("count"))
    least = totals.select("count").orderBy(F.desc("count")).limit(n).agg(F.min("count")).scalar()
    leading = totals.filter(F.col("count") >= least)
    agents = counted.join(leading.select("status_code", "request_uri_id"), ["status_code", "request_uri_id"], "left_semi")
    named = agents.join(_values_of(counts, "user_agent"), "user_agent_id")
    least_agents = named.groupBy("status_code", "request_uri_id").agg(F.min("user_agent").alias("user_agent"))
    whole = leading.join(least_agents, ["status_code", "request_uri_id"]).join(_values_of(counts, "request_uri"), "request_uri_id")
    return whole.select("status_code", "request_uri", "user_agent", "count")
