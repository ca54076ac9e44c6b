"""Suppression rules: patterns over anomaly ids, expanded to an edge table.

A pattern's * stands for one or more characters, greedily, across slashes. Where a rule's two sides have the same number of stars (not
none), the target is the pattern with the suppressor's captures filled in; otherwise it is a pattern of its own. Nothing suppresses itself."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_regex(pattern: str) -> str:
    return "(.+)".join(map(re.escape, pattern.split("*")))


def filled(pattern: str, captures: Iterable[str]) -> str:
    """The pattern with its stars replaced from left to right. A star inside a capture counts as one that is still open."""
    head, out = pattern, ""
    for c in captures:
        before, star, rest = (out + head).partition("*")
        head, out = (before + c + rest, "") if star else (before, "")
    return head


def expand(rules: Mapping[str, Sequence[str]], ids: Iterable[str]) -> set[tuple[str, str]]:
    """All (suppressor, suppressed) among the ids."""
    known = set(ids)
    edges: set[tuple[str, str]] = set()
    for left, rights in (rules or {}).items():
        hits = {i: m for i in known if (m := re.fullmatch(to_regex(left), i, re.DOTALL))}
        for right in rights:
            linked = "*" in left and left.count("*") == right.count("*")
            free = set() if linked else {i for i in known if re.fullmatch(to_regex(right), i, re.DOTALL)}
            for sup, m in hits.items():
                targets = {filled(right, m.groups())} & known if linked else free
                edges |= {(sup, t) for t in targets if t != sup}
    return edges


def edge_table(spark: SparkSession, rules: Mapping[str, Sequence[str]], ids: DataFrame | Iterable[str]) -> DataFrame:
    """(sup, tgt). The ids are those of the calibrated signals: a few for each overlay element, not one for each reading."""
    names = [r[0] for r in ids.select("anomaly_id").distinct().collect()] if isinstance(ids, DataFrame) else list(ids)
    return spark.createDataFrame(sorted(expand(rules, names)), "sup string, tgt string")


def edges_of(ids: DataFrame, rules: DataFrame) -> DataFrame:
    """(sup, tgt) in DataFrame operations alone, for rules(left, right) over ids(anomaly_id)."""
    # a pattern's literal parts are quoted with a backslash before each special character
    regex = lambda c: F.concat(F.lit("^"), F.replace(F.regexp_replace(c, r"([.\\+?\[\]^$(){}|])", r"\\$1"), F.lit("*"), F.lit("(.+)")), F.lit("$"))
    stars = lambda c: F.length(c) - F.length(F.replace(c, F.lit("*"), F.lit("")))
    r = rules.select("left", "right", regex(F.col("left")).alias("lre"), regex(F.col("right")).alias("rre"), stars(F.col("left")).alias("ls"), stars(F.col("right")).alias("rs"))
    r = r.withColumn("linked", (F.col("ls") > 0) & (F.col("ls") == F.col("rs")))
    sup = ids.select(F.col("anomaly_id").alias("sup")).join(r, F.expr("sup rlike lre"))
    parts = F.expr("transform(sequence(1, greatest(ls, 1)), n -> if(ls = 0, '', regexp_extract(sup, lre, n)))")
    want = F.expr("array_join(transform(split(right, '[*]'), (p, i) -> concat(p, if(i < rs and linked, get(caps, i), ''))), '')")
    sup = sup.withColumn("caps", parts).withColumn("want", want)
    tgt = ids.select(F.col("anomaly_id").alias("tgt"))
    exact = sup.where("linked").join(tgt, F.expr("want = tgt"))
    loose = sup.where("not linked").join(tgt, F.expr("tgt rlike rre"))
    return exact.select("sup", "tgt").union(loose.select("sup", "tgt")).where("sup <> tgt").distinct()
