"""URL filters: listed rules first, then association rules that Spark's FP-growth mines from labelled URLs.

A URL's items are its scheme, the labels of its host and their hyphenated words, its path's segments with numbers masked, the names in its query
and whether it has a fragment.  FP-growth counts the item combinations of labelled URLs together with their verdict; a
rule is a combination with the share of one verdict (confidence) and their number (support).  Rules under the least
confidence or support go, and so does every rule that one with an item less makes needless (same verdict, at least its confidence: it fits whenever
the longer one does and wins).  A URL that no listed rule decides takes the verdict of the mined rule with the highest confidence that fits it, then
the highest support, then `block` before `allow`; without one it takes `default`.

Matching.  Rules stand in an inverted index under their rarest item.  Only the frequent items of a URL matter, and URLs share sets of these, so
each distinct set is looked up once and its verdict joined back; all of it is joins that Spark deals out, nothing is sent whole to workers.

Bounds.  Tokens that always come together in the labelled URLs are one item (any of them stands for it, as each alone makes the same rule), so copies of a long URL do not make exponentially many
combinations.  Nor is an item mined with others that has one verdict only (its rule has confidence 1, a longer one with it is needless) or that all labelled URLs hold
(with it a combination fits the same ones): their rules are counted by themselves.  All other frequent items of a URL are mined together, however many they are, so the number of
combinations is bounded by the support alone: labelled URLs that share k such items have 2**k, as many as there are rules to weigh.  `mine(items=k)` is the bounded
form, which mines the k most frequent items of a URL; no query uses it.  Tokens of at least the least support are at most (tokens of a URL) / `SUPPORT` many.

Defined results.  A null URL or one without `://` has an empty host and path, no items and takes `default`.  Rows that repeat a page_id are judged each.  An empty table gives no row; without labelled URLs there are
no mined rules.  Very long URLs are read whole.  Other columns are ignored by `judge`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Shelf, shared_dir

#: Listed rules: host and path, verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SUPPORT, CONFIDENCE = 0.01, 0.8
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _group(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))


def _low(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return _low(_group(url, 2))


def path_of(url: Column) -> Column:
    return _group(url, 3)


def _named(kind: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))


def tokens_of(url: Column) -> Column:
    """The sorted distinct tokens of a URL."""
    host, query, fragment = host_of(url), _low(_group(url, 4)), _group(url, 5)
    masked = F.regexp_replace(_low(path_of(url)), "[0-9]+", "#")
    names = F.transform(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda x: F.substring_index(x, "=", 1))
    found = F.concat(
        _named("scheme", F.array(_low(_group(url, 1)))), _named("host", F.split(host, r"\.")), _named("word", F.filter(F.split(host, "[.-]"), lambda x: F.instr(host, "-") > 0)),
        _named("path", F.split(masked, "/")), _named("query", names), F.when(fragment != "", F.array(F.lit("fragment:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_sort(F.array_distinct(found))


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=False):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def items_of(labelled: DataFrame, support: float = SUPPORT) -> tuple[DataFrame, int]:
    """(token, item, n) of the tokens of at least the least support in `labelled` (tokens, verdict), and the number of its rows.

    Tokens that stand in the same rows have the same sum of row hashes and share an item, the first of them.
    """
    total = labelled.count()
    marked = labelled.select("tokens", F.xxhash64("tokens").cast("decimal(20,0)").alias("h"))
    each = marked.select(F.explode("tokens").alias("token"), "h").groupBy("token").agg(F.count("*").alias("n"), F.sum("h").alias("rows")).where(F.col("n") >= math.ceil(support * total))
    same = each.groupBy("n", "rows").agg(F.collect_list("token").alias("all"))
    return same.select(F.explode("all").alias("token"), F.array_min("all").alias("item"), "n"), total


def with_items(sets: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct `tokens` with their frequent items, most frequent first."""
    found = sets.select("tokens").distinct()
    held = found.select("tokens", F.explode("tokens").alias("token")).join(vocabulary, "token")
    by_count = F.array_sort(F.collect_set(F.struct((-F.col("n")).alias("n"), "item")))
    return held.groupBy("tokens").agg(F.transform(by_count, lambda x: x["item"]).alias("items"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, items: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, vocabulary) of `labelled` (tokens, verdict); rules: antecedent (sorted items), anchor (its rarest item), verdict, confidence, support."""
    spark = labelled.sparkSession
    shared_dir(spark)
    shelf = Shelf(spark)
    vocabulary, total = items_of(labelled, support)
    vocabulary = shelf.put(vocabulary)
    schema = "antecedent array<string>, anchor string, verdict string, confidence double, support long"
    if not total:
        return spark.createDataFrame([], schema), vocabulary
    sets, need = with_items(labelled, vocabulary), math.ceil(support * total)
    says = F.concat(F.lit("verdict:"), F.col("verdict")).alias("says")
    held = shelf.put(labelled.join(sets, "tokens").select(F.slice("items", 1, items).alias("items") if items else "items", says))
    by_verdict = shelf.put(held.select(F.explode("items").alias("item"), "says").groupBy("item", "says").agg(F.count("*").alias("support")))
    by_item = by_verdict.groupBy("item").agg(F.sum("support").alias("n"), F.max("support").alias("most"))
    apart = (F.col("n") == F.col("most")) | (F.col("n") == held.count())
    single = by_verdict.where(F.col("support") >= need).join(by_item.where(apart), "item").select(F.array("item").alias("antecedent"), "says", (F.col("support") / F.col("n")).alias("confidence"), "support")
    mixed = held.select("items").distinct().select("items", F.explode("items").alias("item")).join(by_item.where(~apart), "item").groupBy("items").agg(F.collect_set("item").alias("mixed"))
    rows = shelf.put(held.join(mixed, "items").select(F.array_append("mixed", F.col("says")).alias("items")))
    kept = rows.count()
    if kept:
        # the fraction of these rows that is the least support in number
        share = (need - 0.5) / kept
        found = shelf.put(FPGrowth(itemsCol="items", minSupport=min(1.0, share)).fit(rows).freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")))
        told = F.filter("items", lambda x: x.startswith("verdict:"))
        with_verdict = found.select(F.filter("items", lambda x: ~x.startswith("verdict:")).alias("antecedent"), F.get(told, F.lit(0)).alias("says"), F.col("n").alias("support")).where("says is not null and size(antecedent) > 0")
        several = with_verdict.join(found.select(F.col("items").alias("antecedent"), "n"), "antecedent")
        single = single.unionByName(several.select("antecedent", "says", (F.col("support") / F.col("n")).alias("confidence"), "support"))
    rules = shelf.put(single.where(F.col("confidence") >= confidence))
    # one item less: the shorter rule fits whenever the longer one does
    place = F.explode(F.sequence(F.lit(0), F.size("antecedent") - 1))
    shorter = rules.where(F.size("antecedent") > 1).select("antecedent", "says", "confidence", place.alias("k")).select("antecedent", "says", "confidence", F.filter("antecedent", lambda x, k: k != F.col("k")).alias("part"))
    general = rules.select(F.col("antecedent").alias("part"), "says", F.col("confidence").alias("already"))
    needless = shorter.join(general, ["part", "says"]).where(F.col("already") >= F.col("confidence")).select("antecedent", "says").distinct()
    rules = rules.join(needless, ["antecedent", "says"], "left_anti")
    counts = vocabulary.groupBy("item").agg(F.max("n").alias("n"))
    rarest = rules.select("antecedent", "says", F.explode("antecedent").alias("item")).join(counts, "item").groupBy("antecedent", "says").agg(F.min_by("item", F.struct("n", "item")).alias("anchor"))
    rules = rules.join(rarest, ["antecedent", "says"]).select("antecedent", "anchor", F.substring_index("says", ":", -1).alias("verdict"), "confidence", "support")
    return shelf.put(rules), vocabulary


def match(sets: DataFrame, rules: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tokens, mined) of the distinct `tokens` that a rule fits."""
    known = with_items(sets, vocabulary).withColumn("items", F.array_sort("items"))
    distinct = known.select("items").distinct()
    tried = distinct.select("items", F.explode("items").alias("anchor")).join(rules, "anchor").where(F.size(F.array_except("antecedent", "items")) == 0)
    best = tried.groupBy("items").agg(F.max(F.struct("confidence", "support", "verdict"))["verdict"].alias("mined"))
    return known.join(best, "items").select("tokens", "mined")


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Mined rules come from `labelled` (url, verdict); where none is given, from the pages that the listed rules decide.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path}).withColumns({"rule": rule, "said": verdict, "tokens": tokens_of(F.col("url"))})
    taught = read.where("rule is not null").select("tokens", F.col("said").alias("verdict")) if labelled is None else labelled.select(tokens_of(F.col("url")).alias("tokens"), "verdict")
    mined, vocabulary = mine(taught, support, confidence)
    open_ = read.where("rule is null")
    found = open_.join(match(open_, mined, vocabulary), "tokens", "left").select("page_id", "host", "path", "rule", F.coalesce("mined", F.lit(default)).alias("verdict"))
    return read.where("rule is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict")).unionByName(found)


def op13_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
