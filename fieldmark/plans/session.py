"""Research sessions: records in Parquet with a log of refinements and compositions beside them."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import claims, crawl, evidence, linkage
from ..operators.graph import ensure_checkpoint_dir
from ..schema import ORDER, claim
from ..sources.folder import Folder


@dataclass(frozen=True)
class Refined:
    """What a refinement gives: all records, a note for people, and details where sites were crawled."""

    rows: DataFrame
    note: str = ""
    details: DataFrame | None = None


#: A refinement: records, instruction -> records with claims or contacts added, and what to say of it.
Plugin = Callable[[DataFrame, str], Refined]


@dataclass
class Session:
    """A folder with one version of the records for each change and a log that names the present one."""

    folder: Folder
    request: str = ""
    created_at: str = ""
    steps: list[dict] = field(default_factory=list)
    compositions: list[dict] = field(default_factory=list)
    version: int = 0

    @classmethod
    def create(cls, spark: SparkSession, path: str, request: str, records: DataFrame) -> Session:
        s = cls(Folder(spark, path), request, datetime.datetime.now(datetime.UTC).isoformat())
        s._save(records)
        return s

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Session:
        folder = Folder(spark, path)
        m = json.loads(folder.read("session.json"))
        if m.get("format") != 1:
            raise ValueError("A session of another format.")
        return cls(folder, m["request"], m["created_at"], m["steps"], m["compositions"], m["version"])

    @property
    def spark(self) -> SparkSession:
        return self.folder.spark

    @property
    def path(self) -> str:
        return self.folder.root

    @property
    def records(self) -> DataFrame:
        return self.spark.read.parquet(self.folder.at(f"records-{self.version}"))

    def _save(self, records: DataFrame) -> None:
        """A new version of the records, then the log that names it: a failed write leaves the old one."""
        records.write.mode("overwrite").parquet(self.folder.at(f"records-{self.version + 1}"))
        self.version += 1
        self._log()

    def _log(self) -> None:
        self.folder.write("session.json", json.dumps({"format": 1, "request": self.request, "created_at": self.created_at, "steps": self.steps, "compositions": self.compositions, "version": self.version}, indent=2))

    def refine(self, instruction: str, plugins: Plugins) -> list[dict]:
        """Applies the refinements the instruction calls for, in order; each leaves an audit step.

        A step tells the number of records before and after, a note and, where sites were crawled, how the crawls went; its details
        (a row for each record that asked for a crawl) are a table beside the records.
        """
        if not instruction.strip():
            raise ValueError("A refinement needs an instruction.")
        chosen = [name for name in claims.route(instruction) if name in plugins]
        if not chosen:
            raise ValueError("No plugin for this instruction: " + ", ".join(claims.route(instruction)))
        for name in chosen:
            before = self.records.count()
            result = plugins[name](self.records, instruction)
            step = {"plugin": name, "instruction": instruction, "before": before, "applied_at": datetime.datetime.now(datetime.UTC).isoformat()}
            self._save(result.rows)
            step |= {"after": self.records.count(), "note": result.note, "details": None}
            if result.details is not None:
                step["details"] = f"details-{self.version}"
                result.details.write.mode("overwrite").parquet(self.folder.at(step["details"]))
            self.steps.append(step)
            self._log()
        return self.steps

    def details(self, nth: int = 1) -> DataFrame:
        """The details of the latest step that has some, or of the nth latest such step."""
        found = [s["details"] for s in reversed(self.steps) if s.get("details")]
        if not 1 <= nth <= len(found):
            raise ValueError(f"{len(found)} steps of this session have details.")
        return self.spark.read.parquet(self.folder.at(found[nth - 1]))

    def matches(self) -> DataFrame:
        return claims.latest_matches(self.records, [(s["plugin"], s["instruction"]) for s in self.steps])

    def summary(self) -> DataFrame:
        return claims.session_summary(self.records, [(s["plugin"], s["instruction"]) for s in self.steps])

    def compose(self, supplemental: DataFrame) -> dict:
        """Links the records with one supplemental source and fills blanks from safe matches."""
        rows = self.records
        linkage.single_source(rows, "Primary")
        source = linkage.single_source(supplemental, "Supplemental", at_most=True)
        found = linkage.match(rows, supplemental)
        counts = linkage.decision_counts(found).first().asDict()
        self.compositions.append({"source": source, **counts})
        self._save(linkage.promote(rows, supplemental, found))
        return counts

    def export(self, matches_only: bool = False) -> DataFrame:
        return claims.research_export((self.matches() if matches_only else self.records).orderBy(ORDER))

    def write_export(self, destination: str, matches_only: bool = False) -> str:
        """The flat result as one .csv or .json file; an empty csv holds its header."""
        kind = destination.rsplit(".", 1)[-1].lower()
        if kind not in ("csv", "json"):
            raise ValueError("A research result is written to a .csv or .json file.")
        out = Folder(self.spark, destination.rsplit("/", 1)[0] if "/" in destination else ".")
        name = destination.rsplit("/", 1)[-1]
        out.publish([(out.make_table(name, self.export(matches_only), kind), name)])
        return out.at(name)


class Plugins(dict):
    """Refinements by name; a name is given once."""

    def register(self, name: str, plugin: Plugin) -> Plugins:
        if name in self:
            raise ValueError(f"There is a refinement {name} already.")
        self[name] = plugin
        return self


def _many(n: int, what: str) -> str:
    return f"{n} {what}" if n == 1 else f"{n} {what}s"


def page_plugins(pages: DataFrame, as_of_year: int, observed_at: Column, site: Callable[[Column], Column] = lambda website: website, audit: Callable[[DataFrame], DataFrame] | None = None) -> Plugins:
    """Refinements over a table of crawled pages (website, n, url, html), which are turned to text once.

    site: what of a record's website `pages.website` holds.  audit: the crawl's details of given records.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    text = pages.select("website", "n", "url", evidence.visible_text(F.col("html")).alias("text")).checkpoint()
    contacts = evidence.contacts_of_pages(pages, ["website"], "n").withColumnRenamed("website", "__site")

    def added(rows: DataFrame, found: DataFrame, key: str, kind: str, what: str) -> Refined:
        got = found.select(F.col("website").alias("__w"), F.col("value").alias("__v"), F.col("url").alias("__u"))
        made = claim(key, F.col("__v"), kind, "first_party_web", F.col("__u"), F.col("__u"), observed_at, "public_page_text")
        absent = ~F.exists("claims", lambda c: c["key"] == key)
        new = rows.where(absent & tx.present(F.col("website"))).join(got, site(F.col("website")) == F.col("__w")).count()
        out = rows.join(got, site(F.col("website")) == F.col("__w"), "left")
        return Refined(claims.append_claim(out, key, made, F.col("__v").isNotNull()).drop("__w", "__v", "__u"), f"{_many(new, 'record')} gained {what} from public pages." + _went(audit, rows), _details(audit, rows))

    def ownership(rows, instruction):
        return added(rows, evidence.ownership_of_pages(text, ["website"], "n"), claims.OWNERSHIP, "string", "an ownership assessment")

    def longevity(rows, instruction):
        per = text.select("website", "n", "url", evidence.longevity(F.col("text"), as_of_year).alias("l")).where("l is not null")
        best = per.groupBy("website").agg(F.max(F.struct(F.col("l.years").alias("value"), (-F.col("n")).alias("n"), F.col("url").alias("url"))).alias("b"))
        return added(rows, best.select("website", "b.value", "b.url"), claims.LONGEVITY, "number", "years of operation")

    def status(rows, instruction):
        gone = text.where(evidence.closed(F.col("text"))).groupBy("website").agg(F.min(F.struct("n", "url")).alias("b"))
        return added(rows, gone.select("website", F.lit("closed").alias("value"), "b.url"), claims.STATUS, "string", "a closure notice")

    def filled(names: tuple[str, ...], what: str):
        def plugin(rows: DataFrame, instruction: str) -> Refined:
            asked = reduce(lambda a, b: a | b, [tx.blank(F.col(c)) for c in names]) & tx.present(F.col("website"))
            keyed = rows.withColumn("__site", site(F.col("website")))
            out = evidence.fill_contacts(keyed, contacts, "__site", observed_at=observed_at, names=names).drop("__site")
            has = lambda df: df.agg(*[F.count_if(tx.present(F.col(c))).alias(c) for c in names], F.count_if(reduce(lambda a, b: a | b, [tx.present(F.col(c)) for c in names])).alias("any")).first()
            before, after = has(rows), has(out)
            new = sum(after[c] - before[c] for c in names)
            return Refined(out, f"{_many(new, what)} found on first-party pages; {_many(after['any'], 'record')} with one now." + _went(audit, rows.where(asked)), _details(audit, rows.where(asked)))

        return plugin

    made = Plugins()
    for name, plugin in (("ownership-evidence", ownership), ("longevity-evidence", longevity), ("operational-status-evidence", status), ("public-socials", filled(tuple(evidence.SOCIALS), "social link")), ("public-email", filled(("email",), "public email"))):
        made.register(name, plugin)
    return made


def _went(audit, rows: DataFrame) -> str:
    return crawl.outcome_note(audit(rows)) if audit else ""


def _details(audit, rows: DataFrame) -> DataFrame | None:
    return audit(rows) if audit else None


def web_plugins(records: DataFrame, responses: DataFrame, as_of_year: int, observed_at: Column, max_pages: int = crawl.MAX_PAGES, robots: bool = True) -> Plugins:
    """Refinements over captured responses: one bounded crawl of each home page, shared by all plugins and records."""
    found = crawl.crawl(records.where(tx.present(F.col("website"))), responses, max_pages, robots)
    pages = found.pages().withColumnRenamed("home", "website")
    return page_plugins(pages, as_of_year, observed_at, crawl.homepage, lambda rows: crawl.audit(rows.where(evidence.needs_crawl()), found))


# What the enrollment directory is called in evidence.
_ENROLLED = ("ca-dhcs-medi-cal-dental-ffs", "official_dataset_exact_npi_match", "official_program_directory")


def enrollment_plugin(listed: DataFrame, dataset_url: str, observed_at: Column, most: int = 100) -> Plugin:
    """The refinement that marks records whose ten-digit id is in a captured directory (npi); absence says nothing."""

    def plugin(rows: DataFrame, instruction: str) -> Refined:
        source, method, authority = _ENROLLED
        made = claim(claims.ENROLLED, F.lit(True), "boolean", source, F.col("source_ids")["npi"], F.lit(dataset_url), observed_at, method, authority)
        out = linkage.enroll_by_id(rows, listed, "npi", made, claims.ENROLLED, most)
        held = lambda df: df.where(F.exists("claims", lambda c: c["key"] == claims.ENROLLED)).count()
        return Refined(out, f"{_many(held(out) - held(rows), 'record')} found in the enrollment directory; it does not tell who takes new patients.")

    return plugin


def list_sessions(spark: SparkSession, root: str) -> list[str]:
    """Session folders, newest first; unreadable ones are left out."""
    found, folder = [], Folder(spark, root)
    for name, _ in folder.names():
        inside = dict(folder.names(name)) if not name.startswith(".") else {}
        if "session.json" not in inside:
            continue
        try:
            if json.loads(folder.read(f"{name}/session.json")).get("format") == 1:
                found.append((inside["session.json"], name))
        except ValueError:
            continue
    return [folder.at(name) for _, name in sorted(found, reverse=True)]


def nth_session(spark: SparkSession, root: str, nth: int = 1) -> Session:
    """The newest session, or the nth newest."""
    found = list_sessions(spark, root)
    if not 1 <= nth <= len(found):
        raise ValueError(f"There are {len(found)} sessions; number {nth} is not among them.")
    return Session.load(spark, found[nth - 1])
