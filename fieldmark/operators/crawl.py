"""Bounded first-party crawls over captured responses, level by level instead of page by page.

A crawl of a home page reads a queue: the page, then its likely links in the order in which they were met, at most `max_pages` pages that could be
read.  Queue order is order by level and, inside a level, by the place of the page that links and the place of the link on it.
So all homes advance together, one level a round: a level's pages are visited while fewer than `max_pages` were read
before them, which a running count tells.  No level beyond `max_pages` can be reached, since every level costs a page.

responses: one row for each address that was fetched: url, status (HTTP), final_url (after redirects), body, error (array of
'Kind: message' of a fetch that failed, the outermost first).  An address without a row could not be reached (network_error).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import evidence
from .graph import ensure_checkpoint_dir

# Outcomes, words of likely pages, the bound of pages, the name that robots rules are looked up by.
OUTCOMES = ("success", "timeout", "http_error", "tls_error", "dns_error", "connection_error", "network_error", "invalid_url", "redirect_blocked", "robots_denied", "robots_unavailable")
LIKELY_PAGE_WORDS = ("contact", "about", "team", "staff", "people")
MAX_PAGES = 4
AGENT = "fieldmark"


# ---- addresses ----
def homepage(c: Column) -> Column:
    """A site's address; https unless it names a scheme; '' where it is none of http and https."""
    t = tx.strip(F.coalesce(c, F.lit("")))
    fine = t.rlike(r"(?i)^https?://[^/?#]")
    return F.when(t == "", "").when(~t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(F.lit("https://"), t)).when(fine, t).otherwise("")


def _without_dots(path: Column) -> Column:
    """A path with its . and .. steps taken."""
    steps = F.split(path, "/")
    none = F.array().cast("array<string>")
    taken = F.aggregate(steps, none, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.array_append(acc, x)))
    ends_open = F.element_at(steps, -1).isin(".", "..")
    joined = F.array_join(F.when(ends_open, F.array_append(taken, F.lit(""))).otherwise(taken), "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve(base: Column, href: Column) -> Column:
    """The address that a link on the page `base` leads to, without its fragment; null for a link that leaves http."""
    link = F.regexp_replace(F.replace(tx.strip(href), F.lit("&amp;"), F.lit("&")), "#.*$", "")
    page = F.regexp_replace(base, "#.*$", "")
    site = F.regexp_extract(page, r"(?i)^(https?://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"(?i)^https?://[^/?#]*([^?]*)", 1)
    query = F.regexp_extract(link, r"(\?.+)$", 1)
    step = F.regexp_replace(link, r"\?.*$", "")
    folder = F.regexp_replace(path, "[^/]*$", "")
    # empty steps inside a joined path fall away
    joined = F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), step), "(?<!^)/{2,}", "/")
    absolute = F.regexp_extract(link, r"(?i)^((?:https?:)?//[^/?#]*)", 1)
    rest = F.regexp_extract(link, r"(?i)^(?:https?:)?//[^/?#]*([^?]*)", 1)
    scheme = F.regexp_extract(page, r"(?i)^(https?:)", 1)
    return (
        F.when(link == "", page)
        .when(absolute.rlike("(?i)^http"), F.concat(absolute, rest, query))
        .when(absolute != "", F.concat(scheme, absolute, rest, query))
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("?"), F.concat(site, path, query))
        .when(link.startswith("/"), F.concat(site, _without_dots(step), query))
        .otherwise(F.concat(site, _without_dots(joined), query))
    )


def likely_links(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, target, place): same-origin links whose label or path names a likely page, in page order."""
    links = pages.select(*keep, url, F.posexplode(evidence.anchors(F.col(html))).alias("place", "a"))
    found = links.select(*keep, url, "place", resolve(F.col(url), F.col("a.href")).alias("target"), F.lower("a.label").alias("label"))
    path = F.lower(F.regexp_extract("target", r"(?i)^https?://[^/?#]*([^?#;]*)", 1))
    likely = reduce(lambda a, b: a | b, [F.contains(F.concat_ws(" ", "label", path), F.lit(w)) for w in LIKELY_PAGE_WORDS])
    return found.where((tx.origin(F.col("target")) == tx.origin(F.col(url))) & likely).select(*keep, url, "target", "place")


# ---- outcomes of fetches ----
def failure(status: Column, error: Column) -> Column:
    """What kept a page from being read, or null; status and error as in responses."""
    kinds = F.transform(error, lambda e: F.lower(F.regexp_extract(e, r"^\s*([^:\s]*)", 1)))
    first = F.get(kinds, F.lit(0))
    cause = F.get(
        F.filter(
            F.transform(error, lambda e: F.when(F.lower(e).rlike(r"^\s*ssl\w*error|certificate verify failed"), "tls_error").when(F.lower(e).rlike(r"^\s*gaierror"), "dns_error")),
            lambda x: x.isNotNull(),
        ),
        F.lit(0),
    )
    raised = F.when(first.contains("timeout"), "timeout").when(first == "httpstatuserror", "http_error").otherwise(F.coalesce(cause, F.when(first == "connecterror", "connection_error").otherwise("network_error")))
    return F.when(F.size(F.coalesce(error, F.array().cast("array<string>"))) > 0, raised).when(status.isNull(), "network_error").when(~status.between(200, 299), "http_error")


# ---- robots ----
_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def robots_rules(files: DataFrame, agent: str = AGENT) -> DataFrame:
    """(origin, nth, path, allow): the rules of each robots file (origin, text) that speak to the agent, in file order.

    A group is one or more agent lines and the rules below them, up to a blank line.  The first group that names the agent
    counts, else the first for all agents.  Rules outside a group and groups without a rule line say nothing.
    """
    lines = files.select("origin", F.posexplode(F.split("text", _BREAKS)).alias("nth", "raw"))
    line = tx.strip(F.regexp_replace("raw", "#.*$", ""))
    key, value = F.lower(tx.strip(F.regexp_extract(line, "^([^:]*):", 1))), tx.strip(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
    kind = F.when(F.col("raw") == "", "blank").when(key == "user-agent", "agent").when(key.isin("allow", "disallow"), "rule").when(key.isin("crawl-delay", "request-rate"), "other")
    told = lines.select("origin", "nth", kind.alias("kind"), key.alias("key"), value.alias("value")).where("kind is not null")
    # a file is one task's work at most: it is one string already
    at = Window.partitionBy("origin").orderBy("nth")
    begins = (F.col("kind") == "blank") | ((F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(at), F.lit("blank")) != "agent"))
    grouped = told.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(at))
    agents = F.collect_set(F.when(F.col("kind") == "agent", F.lower("value")))
    rules = F.sort_array(F.collect_list(F.when(F.col("kind") == "rule", F.struct("nth", F.col("value").alias("path"), ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow")))))
    groups = grouped.groupBy("origin", "group").agg(agents.alias("agents"), rules.alias("rules"), F.count_if(F.col("kind").isin("rule", "other")).alias("said")).where("size(agents) > 0 and said > 0")
    name = agent.split("/")[0].lower()
    for_all = F.array_contains("agents", "*")
    for_us = F.exists("agents", lambda a: F.contains(F.lit(name), a))
    pick = groups.where(for_all | for_us).groupBy("origin").agg(F.min_by("rules", F.struct(for_all, "group")).alias("rules"))
    return pick.select("origin", F.explode("rules").alias("r")).select("origin", "r.nth", "r.path", "r.allow")


def robots_allow(homes: DataFrame, rules: DataFrame, precedence: str = "first") -> DataFrame:
    """(home, allowed) of homes (home, origin): by the first rule in the file that fits, or the longest (ties: allow), as `precedence` says."""
    path = F.regexp_extract("home", r"(?i)^https?://[^/?#]*([^#]*)", 1)
    asked = homes.select("home", "origin", F.when(path == "", "/").when(path.startswith("?"), F.concat(F.lit("/"), path)).otherwise(path).alias("asked"))
    plain = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    fits = asked.join(rules, "origin").where(plain(F.col("asked")).startswith(plain(F.col("path"))))
    rank = F.struct(F.col("nth")) if precedence == "first" else F.struct(-F.length("path"), ~F.col("allow"))
    best = fits.groupBy("home").agg(F.min_by("allow", rank).alias("allow"))
    return homes.join(best, "home", "left").select(homes["home"], F.coalesce("allow", F.lit(True)).alias("allowed"))


# ---- the crawl ----
@dataclass(frozen=True)
class Crawl:
    """outcomes: home, status, pages_read; visits: home, n, url, final_url, status ('success' or what failed), in queue order."""

    outcomes: DataFrame
    visits: DataFrame
    responses: DataFrame

    def pages(self) -> DataFrame:
        """(home, n, url, html) of the pages that were read; url is where the page was found."""
        read = self.visits.where("status = 'success'").select("home", "n", F.col("url").alias("asked"), "final_url")
        return read.join(self.responses.select(F.col("url").alias("asked"), F.col("body").alias("html")), "asked").select("home", "n", F.col("final_url").alias("url"), "html")


def crawl(sites: DataFrame, responses: DataFrame, max_pages: int = MAX_PAGES, robots: bool = True, precedence: str = "first") -> Crawl:
    """Crawls the distinct home pages of sites (website); every record with that home page shares the crawl."""
    ensure_checkpoint_dir(sites.sparkSession)
    got = responses.select("url", F.coalesce(F.nullif("final_url", F.lit("")), "url").alias("final_url"), failure(F.col("status"), F.col("error")).alias("failed"))
    homes = sites.select(homepage(F.col("website")).alias("home")).where("home <> ''").distinct().withColumn("origin", tx.origin(F.col("home")))
    barred = homes.select("home", F.lit(None).cast("string").alias("status")).where("false")
    if robots:
        files = homes.select("origin").distinct().withColumn("file", F.concat("origin", F.lit("/robots.txt")))
        told = files.join(got.withColumn("known", F.lit(True)), F.col("file") == F.col("url"), "left").select("origin", F.when(F.col("known"), F.col("failed")).otherwise("robots_unavailable").alias("failed"))
        read = told.where("failed is null").select("origin", F.concat("origin", F.lit("/robots.txt")).alias("url"))
        rules = robots_rules(read.join(responses.select("url", F.coalesce("body", F.lit("")).alias("text")), "url").select("origin", "text"))
        gate = robots_allow(homes.join(read.select("origin"), "origin"), rules, precedence).where("not allowed").select("home", F.lit("robots_denied").alias("status"))
        unread = homes.join(told.where("failed is not null"), "origin").select("home", F.col("failed").alias("status"))
        barred = gate.unionByName(unread).checkpoint()
    level = homes.join(barred, "home", "left_anti").select("home", "origin", F.col("home").alias("url"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("before"))
    seen, visits = level.select("home", "url"), []
    before_it = Window.partitionBy("home").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    for depth in range(max(1, max_pages)):
        tried = level.join(got.withColumnRenamed("url", "at"), F.col("url") == F.col("at"), "left").withColumn("final_url", F.coalesce("final_url", "url"))
        status = F.when(F.col("at").isNull(), "network_error").otherwise(F.coalesce("failed", F.when(tx.origin(F.col("final_url")) != F.col("origin"), "redirect_blocked").otherwise("success")))
        known = tried.select("home", "origin", "url", "final_url", "place", "before", status.alias("status"), (status == "success").cast("long").alias("ok"))
        counted = known.withColumn("read", F.col("before") + F.coalesce(F.sum("ok").over(before_it), F.lit(0)))
        # a written level cuts the lineage: each round builds on addresses only, not on the rounds before
        visited = counted.where(F.col("read") < max_pages).withColumn("depth", F.lit(depth)).checkpoint()
        visits.append(visited)
        if depth + 1 == max(1, max_pages):
            break
        total = visited.groupBy("home").agg((F.first("before") + F.sum("ok")).alias("before"))
        parents = visited.where("ok = 1").select("home", "origin", "url", F.col("place").alias("parent"))
        bodies = parents.join(responses.select(F.col("url").alias("at"), F.col("body").alias("html")), F.col("url") == F.col("at"))
        links = likely_links(bodies, keep=("home", "origin", "parent"))
        met = links.groupBy("home", "origin", F.col("target").alias("url")).agg(F.min(F.struct("parent", "place")).alias("met"))
        fresh = met.join(seen, ["home", "url"], "left_anti").join(total.where(F.col("before") < max_pages), "home")
        ranked = fresh.withColumn("place", F.row_number().over(Window.partitionBy("home").orderBy("met")))
        level = ranked.select("home", "origin", "url", "place", "before").checkpoint()
        seen = seen.unionByName(level.select("home", "url"))
    every = reduce(DataFrame.unionByName, visits)
    order = Window.partitionBy("home").orderBy("depth", "place")
    listed = every.select("home", F.row_number().over(order).alias("n"), "url", "final_url", "status")
    first = visits[0].select("home", F.col("status").alias("first"))
    counts = every.groupBy("home").agg(F.sum("ok").alias("pages_read"))
    done = first.join(counts, "home").select("home", F.col("first").alias("status"), "pages_read")
    outcomes = done.unionByName(barred.select("home", "status", F.lit(0).cast("long").alias("pages_read")))
    return Crawl(outcomes, listed, responses)


def audit(records: DataFrame, found: Crawl, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each record that asks for a crawl: its name, website, the crawl's status and the pages read."""
    asked = records.where(evidence.needs_crawl()).select(*keep, "name", "website", homepage(F.col("website")).alias("home"))
    out = asked.join(found.outcomes, "home", "left")
    return out.select(*keep, "name", "website", F.when(F.col("home") == "", "invalid_url").otherwise(F.col("status")).alias("status"), F.coalesce("pages_read", F.lit(0)).cast("long").alias("pages_read"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


def outcome_note(rows: DataFrame) -> str:
    """A sentence on how the crawls went, '' where there was none."""
    counts = outcome_counts(rows).collect()
    return " Crawl outcomes: " + ", ".join(f"{r['n']} {r['status']}" for r in counts) + "." if counts else ""
