"""Listing cards of saved directory pages, picked by class selectors while the page is read once."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import ORDER, as_records

# The classes of a card and of its parts, and the attribute that is read (None: text).
CARD = "result"
PARTS = (("name", "business-name", None), ("category", "categories", None), ("address", "street-address", None), ("phone", "phones", None), ("website", "track-visit-website", "href"), ("rating", "result-rating", None), ("review_count", "count", None))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end where the next of their kind begins.
_CLOSED_BY_NEXT = frozenset("li p td tr option dd dt".split())
_SCHEMA = "array<struct<" + ", ".join(f"{name}: string" for name, _, _ in PARTS) + ">>"


class CardReader(HTMLParser):
    """Collects, for every element of the card class, its parts: of all elements inside it (itself included) that have the
    part's class, the first text that stands directly in one, or the attribute of the first one.
    """

    def __init__(self, card: str = CARD, parts=PARTS):
        super().__init__(convert_charrefs=True)
        self.card, self.parts = card, parts
        self.open: list[tuple[str, list[int], dict | None]] = []
        self.cards: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSED_BY_NEXT and self.open and self.open[-1][0] == tag:
            self.open.pop()
        own = dict(reversed(attrs))
        classes = (own.get("class") or "").split()
        card = {} if self.card in classes else None
        if card is not None:
            self.cards.append(card)
        fits = [k for k, (_, cls, _) in enumerate(self.parts) if cls in classes]
        self.open.append((tag, fits, card))
        for k in fits:
            attribute = self.parts[k][2]
            if attribute is not None:
                self._put(k, own.get(attribute) or "")
        if tag in _VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            for k in self.open[-1][1]:
                if self.parts[k][2] is None:
                    self._put(k, data)

    def _put(self, k: int, value: str) -> None:
        for _, _, card in self.open:
            if card is not None:
                card.setdefault(self.parts[k][0], value.strip())


def read_cards(html: str | None) -> list[dict]:
    reader = CardReader()
    reader.feed(html or "")
    reader.close()
    return [{name: card.get(name, "") for name, _, _ in PARTS} for card in reader.cards]


def _cards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(name, pa.string()) for name, _, _ in PARTS]))
    for batch in batches:
        found = pa.array([read_cards(html) for html in batch.column("html").to_pylist()], kind)
        yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("url"), found], names=["at", "url", "cards"])


def card_records(pages: DataFrame, html: str = "html", url: str = "url", scraped_at: Column | None = None) -> DataFrame:
    """Records of the cards of pages, in page order and then in card order.  Cards say nothing about city, state and postal code."""
    address = F.col(url) if url in pages.columns else F.lit("")
    read = pages.select(F.col(ORDER).alias("at"), address.cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(_cards, f"at long, url string, cards {_SCHEMA}")
    rows = read.select("at", "url", F.posexplode("cards").alias("nth", "c")).withColumn(ORDER, F.struct("at", "nth"))
    fields = {name: F.col(f"c.{name}") for name in ("name", "category", "address", "phone", "website")}
    fields |= {"rating": tx.to_float(F.col("c.rating")), "review_count": tx.to_int(F.col("c.review_count")), "country": F.lit("USA"), "source": F.lit("yellowpages"), "source_url": F.col("url"), "scraped_at": scraped_at if scraped_at is not None else F.lit(None).cast("timestamp")}
    # a page's cards follow one another: the page's place takes the high bits
    return as_records(rows.drop(ORDER), fields, order=F.shiftleft(F.col("at"), 20) + F.col("nth"))
