"""Keep-first deduplication.

exact: the first row of each priority key stays and gathers the sources of those that go.
fuzzy: rows of one address block whose names are nearly equal go too, in input order.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import ORDER
from .graph import group_labels


def priority_key() -> Column:
    """website, else email, else phone with name, else name with address; kinds never meet."""
    low_name, low_address = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("address", F.lit("")))
    none = F.lit("")

    def key(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    return (
        F.when(tx.present(F.col("website")), key("website", F.col("website"), none))
        .when(tx.present(F.col("email")), key("email", F.col("email"), none))
        .when(tx.present(F.col("phone")) & tx.present(F.col("name")), key("phone_name", F.col("phone"), low_name))
        .otherwise(key("name_address", low_name, low_address))
    )


def legacy_key() -> Column:
    """Name, address and phone, without case."""
    return F.struct(*[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("name", "address", "phone")])


STRATEGIES = {"identifier": priority_key, "exact_v1": legacy_key}


def _sources() -> Column:
    """A row's own sources in order: those it was discovered by, then its source; blanks and repeats left out."""
    return F.array_distinct(F.filter(F.concat(F.coalesce("discovery_sources", F.array().cast("array<string>")), F.array("source")), lambda s: F.coalesce(s != "", F.lit(False))))


def keep_first(df: DataFrame, strategy: str = "identifier") -> DataFrame:
    """The first row (by _ord) of each key, with the order-distinct sources of all its rows in discovery_sources.

    The rows of a key never meet in one task: the first row and the sources' first places are two
    aggregates that combine before the shuffle.  Sources of a key are few, so their list is short.
    """
    keyed = df.withColumn("__key", STRATEGIES[strategy]()).withColumn("__sources", _sources())
    # places of sources: by row, then by place within the row
    places = keyed.select("__key", ORDER, F.posexplode("__sources").alias("__pos", "__source")).groupBy("__key", "__source").agg(F.min(F.struct(ORDER, "__pos")).alias("__at"))
    merged = places.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__at", "__source"))).alias("__list")).select("__key", F.transform("__list", lambda x: x["__source"]).alias("__merged"))
    first = keyed.groupBy("__key").agg(F.min(ORDER).alias("__first"))
    kept = keyed.join(first, "__key").where(F.col(ORDER) == F.col("__first"))
    out = kept.join(merged, "__key", "left").withColumn("discovery_sources", F.coalesce("__merged", F.array().cast("array<string>")))
    return out.select(*[c if c != "discovery_sources" else F.col("discovery_sources") for c in dict.fromkeys([*df.columns, "discovery_sources"])])


def keep_first_window(df: DataFrame, strategy: str = "identifier") -> DataFrame:
    """The first row of each key without merging sources: one shuffle, for keys of bounded size."""
    w = Window.partitionBy(STRATEGIES[strategy]()).orderBy(ORDER)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def fuzzy_keep_first(df: DataFrame, threshold: float = 0.96) -> DataFrame:
    """keep_first, and without rows whose address equals a kept row's and whose name is at least `threshold` alike.

    Exact and fuzzy decisions meet: a row that went for its name is not remembered by its key, so the
    next row of that key may stay.  Rows that can decide about each other share a key or an address;
    the groups of that relation are independent and each is read in input order.  Groups are
    found by connected components of the key and address nodes, whose edges number one per row.
    """
    rows = df.withColumn("__k", F.to_json(priority_key())).withColumn("__sources", _sources())
    block = tx.strip(F.lower(F.coalesce("address", F.lit(""))))
    rows = rows.withColumn("__b", F.when(block != "", block)).withColumn("__n", tx.fuzzy_name(F.col("name")))
    nodes = rows.select(F.concat(F.lit("k"), "__k").alias("a"), F.concat(F.lit("b"), F.coalesce("__b", F.lit(""))).alias("b"), "__b")
    labels = group_labels(nodes.where("__b is not null").select("a", "b")).toDF("__node", "__label")
    grouped = rows.join(labels, F.concat(F.lit("k"), "__k") == F.col("__node"), "left").withColumn("__g", F.coalesce("__label", F.xxhash64(F.concat(F.lit("k"), "__k")))).drop("__node", "__label")
    names = ["__g", ORDER, "__k", "__b", "__n", "__sources"]

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ORDER)
        seen: dict[str, int] = {}
        kept_in_block: dict[str, list[str]] = {}
        keep, sources = {}, {}
        for o, k, b, n, s in zip(group[ORDER], group["__k"], group["__b"], group["__n"], group["__sources"], strict=True):
            if k in seen:
                sources[seen[k]] += [x for x in s if x not in sources[seen[k]]]
                keep[o] = "exact"
                continue
            twin = False
            if isinstance(b, str) and n:
                for other in kept_in_block.get(b, ()):
                    m = SequenceMatcher(None, n, other)
                    if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold:
                        twin = True
                        break
            if twin:
                keep[o] = "fuzzy"
                continue
            seen[k], keep[o], sources[o] = o, "kept", list(s)
            if isinstance(b, str) and n:
                kept_in_block.setdefault(b, []).append(n)
        return pd.DataFrame({ORDER: list(keep), "__decision": list(keep.values()), "__merged": [sources.get(o) for o in keep]})

    decided = grouped.select(*names).groupBy("__g").applyInPandas(decide, f"{ORDER} long, __decision string, __merged array<string>")
    out = df.join(decided, ORDER)
    return out.withColumn("discovery_sources", F.coalesce("__merged", "discovery_sources")).withColumnRenamed("__decision", "dedup_decision").drop("__merged")
