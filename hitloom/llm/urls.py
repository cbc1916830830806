"""URL rules found through their rarest literal token.

A rule names a host, which stands for itself and all its subdomains, and the start of a path. It compiles to one
regular expression and is filed under one token: of the literal tokens that each matching URL must contain, the one
that the fewest URLs of the corpus have. A URL is split into tokens, its tokens fetch candidate
rules, and only those run. Of the rules that fit, the longest decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.columns import back, own

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKENS = r"[^./]+"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"(?s)(?:^|[^/]*\.){re.escape(self.host)}\x00{re.escape(self.path)}"

    def tokens(self) -> list[str]:
        """Whole tokens of each URL that fits: host labels, and path parts closed by a slash."""
        labels = [f"h:{label}" for label in self.host.split(".") if label]
        parts = self.path.split("/")
        return labels + [f"p:{part}" for part in parts[1:-1] if part and self.path.startswith("/")]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: str, path: str) -> set[str]:
    return {f"h:{t}" for t in host.split(".")} | {f"p:{t}" for t in path.split("/")}


def token_counts(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many rows (``host``, ``path``) each token of the rules occurs. One row per token of
    the rules comes back, whatever the size of the corpus."""
    wanted = sorted({token for rule in rules for token in rule.tokens()})
    tokens = F.array_distinct(
        F.concat(
            F.transform(F.split("host", r"\."), lambda t: F.concat(F.lit("h:"), t)),
            F.transform(F.split("path", "/"), lambda t: F.concat(F.lit("p:"), t)),
        )
    )
    found = urls.select(F.explode(tokens).alias("token")).filter(F.col("token").isin(wanted))
    return {row["token"]: row["n"] for row in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


class RuleIndex:
    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[re.Pattern, Rule]]] = {}
        self.always: list[tuple[re.Pattern, Rule]] = []
        for rule in rules:
            entry = (re.compile(rule.pattern), rule)
            tokens = rule.tokens()
            if tokens:
                rarest = min(tokens, key=lambda token: (counts.get(token, 0), token))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def candidates(self, host: str, path: str) -> list[tuple[re.Pattern, Rule]]:
        found = list(self.always)
        for token in url_tokens(host, path):
            found += self.by_token.get(token, ())
        return found

    def best(self, host: str, path: str) -> Rule | None:
        subject = f"{host}\x00{path}"
        fitting = [rule for pattern, rule in self.candidates(host, path) if pattern.match(subject)]
        return max(fitting, key=lambda rule: (len(rule.name), rule.name), default=None)


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url_column: str = "url") -> DataFrame:
    """Append ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` to all rows.

    A null url, or one without ``://``, has an empty host and path, so no rule with a host fits and ``verdict`` is
    ``default``, as for every url without a rule. Columns that already have one of these names are replaced. Repeated rows
    stay; an empty table gives none. Two rules of the same length can't both fit unless they are
    equal; then the verdict is that of the one listed first.
    """
    names = ("host", "path", "rule", "verdict")
    url = F.col(f"`{url_column}`")
    split = pages.select(*own(pages, names), host_of(url).alias("host"), path_of(url).alias("path"))
    index = RuleIndex(rules, token_counts(split, rules))

    @F.pandas_udf("struct<rule string, verdict string>")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            best = [index.best(host, path) for host, path in zip(hosts, paths)]
            yield pd.DataFrame(
                {
                    "rule": pd.Series([rule.name if rule else None for rule in best], dtype=object),
                    "verdict": [rule.verdict if rule else default for rule in best],
                }
            )

    judged = split.withColumn("_found", decide("host", "path"))
    return judged.select(*back(pages, names), "host", "path", "_found.rule", "_found.verdict")
