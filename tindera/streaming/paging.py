"""What a collection comes to, page by page: how many reviews, how many pages, and why it ended.

The same rules hold for a table of pages that were seen, as joins and windows of bounded size, and for a stream of pages, with
a product's state machine and the identities that it knows as map state, so that a batch writes only what its pages change.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.qualification import STOP_REASONS, completed_pages, missing_reviews_reason
from ..scratch import free

KEYS = ["product", "context"]
CHECKPOINT = "product string, context string, completed_pages long, collected_reviews long, stop_reason string"


@dataclass(frozen=True)
class Reasons:
    """The reasons for which a page ends a collection, in the order in which they are looked for."""

    container: str = "review_container_missing"
    empty: str = "empty_review_page"
    target: str = "target_reached"
    signature: str = "missing_page_signature"
    unchanged: str = "page_signature_timeout"
    cap: str = "max_review_pages_reached"

    def __post_init__(self) -> None:
        if unknown := {*vars(self).values()} - {*STOP_REASONS}:
            raise ValueError(f"not a stop reason: {sorted(unknown)}")


#: By pages with a button, and by batches that a view loads.
PAGES = Reasons()
BATCHES = Reasons(empty="empty_review_batch", signature="missing_review_signature", unchanged="no_additional_reviews", cap="max_review_batches_reached")


def _looked_at(pages: DataFrame, reviews: DataFrame, stored: DataFrame, plan: DataFrame, most: int, reasons: Reasons) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages with running counts and reasons, first occurrences of new reviews, and what each collection begins with."""
    known = stored.select(*KEYS, "identity").distinct()
    start = plan.join(known.groupBy(*KEYS).agg(F.count("*").alias("have")), KEYS, "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    shown = reviews.where(F.col("page") <= most)
    firsts = shown.groupBy(*KEYS, "identity").agg(F.min(F.struct("page", "pos")).alias("first")).select(*KEYS, "identity", "first.page", "first.pos")
    firsts = firsts.join(known, [*KEYS, "identity"], "left_anti")
    counts = shown.groupBy(*KEYS, "page").agg(F.count("*").alias("shown")).join(firsts.groupBy(*KEYS, "page").agg(F.count("*").alias("new")), [*KEYS, "page"], "left")
    rows = pages.where(F.col("page") <= most).join(counts, [*KEYS, "page"], "left").join(start, KEYS).fillna(0, ["shown", "new"])
    # At most ``most`` pages of a product: the cap bounds the window.
    order = Window.partitionBy(*KEYS).orderBy("page")
    rows = rows.withColumns({"before": F.col("have") + F.sum("new").over(order) - F.col("new"), "following": F.lead("signature").over(order)})
    total = F.least("limit", F.col("before") + F.col("new"))
    signature = F.coalesce("signature", F.lit(""))
    reason = (
        F.when(~F.col("found"), reasons.container).when(F.col("shown") == 0, reasons.empty).when(total >= F.col("limit"), reasons.target).when(signature == "", reasons.signature)
        .when(F.col("outcome").isNotNull(), F.col("outcome")).when(F.col("following") == signature, reasons.unchanged).when(F.col("page") == most, reasons.cap)
    )
    return rows.withColumns({"total": F.when(F.col("found") & (F.col("shown") > 0), total).otherwise(F.col("before")), "reason": reason}), firsts, start


def fold_pages(pages: DataFrame, reviews: DataFrame, stored: DataFrame, plan: DataFrame, most: int, reasons: Reasons = PAGES) -> DataFrame:
    """A checkpoint for each row of ``plan``: ``product``, ``context``, ``completed_pages``, ``collected_reviews``, ``stop_reason``.

    ``pages``: ``product``, ``context``, ``page`` (from 1, without gaps), ``found`` (was there a container?), ``signature`` and ``outcome`` (why one could not
    go on from it, or null).  ``reviews``: their ``product``, ``context``, ``page``, ``pos``, ``identity``.  ``stored``: the reviews had before.
    ``plan``: ``product``, ``context`` (``all`` or a star), ``limit`` of that scope, ``reported`` reviews and ``done_pages`` of an earlier checkpoint.

    The first page that gives a reason ends a collection; with none it is still going on and has a null reason.  At its limit from the start
    it looks at no page.  Without a container on the first page there are no reviews, or the widget is missing.  A checkpoint never goes back.
    """
    rows, _, start = _looked_at(pages, reviews, stored, plan, most, reasons)
    ends = rows.groupBy(*KEYS).agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("page", "reason", "total"))).alias("stop"), F.max(F.struct("page", "total")).alias("last"))
    at = lambda c, other: F.when(F.col("stop").isNotNull(), F.col(f"stop.{c}")).otherwise(other)
    full = F.col("have") >= F.col("limit")
    absent = (F.col("stop.page") == 1) & (F.col("stop.reason") == reasons.container)
    page = F.when(full | absent, 0).otherwise(F.coalesce(at("page", F.col("last.page")), F.lit(0)))
    return start.join(ends, KEYS, "left").select(
        *KEYS, completed_pages(F.col("done_pages"), page).cast("long").alias("completed_pages"),
        F.when(full | absent, F.col("have")).otherwise(F.coalesce(at("total", F.col("last.total")), "have")).alias("collected_reviews"),
        F.when(full, reasons.target).when(absent, missing_reviews_reason(F.col("reported"))).otherwise(F.col("stop.reason")).alias("stop_reason"),
    )


def kept_reviews(pages: DataFrame, reviews: DataFrame, stored: DataFrame, plan: DataFrame, most: int, reasons: Reasons = PAGES) -> DataFrame:
    """The reviews that such a collection adds: ``product``, ``context``, ``identity``, ``page``, ``pos``, ``rank`` (after the stored ones, from 1)."""
    rows, firsts, _ = _looked_at(pages, reviews, stored, plan, most, reasons)
    ends = rows.groupBy(*KEYS).agg(F.coalesce(F.min(F.when(F.col("reason").isNotNull(), F.col("page"))), F.max("page")).alias("end"))
    open_pages = rows.where("found and have < limit").select(*KEYS, "page", "before", "limit").join(ends, KEYS).where("page <= end")
    place = F.row_number().over(Window.partitionBy(*KEYS, "page").orderBy("pos"))
    return firsts.join(open_pages, [*KEYS, "page"]).withColumn("rank", F.col("before") + place).where("rank <= limit").select(*KEYS, "identity", "page", "pos", "rank")


class _Collections(StatefulProcessor):
    """The collections of a bucket: where each stands, and the identities that it knows while it goes on."""

    def __init__(self, most: int, reasons: Reasons) -> None:
        self.most, self.reasons = most, reasons

    def init(self, handle) -> None:
        value = "page long, collected long, reason string, signature string, target long, reported long, done_pages long, seen string"
        self.at = handle.getMapState("at", "product string, context string", value)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        for row in initialState.itertuples():
            known = set(row.identities)
            reason = self.reasons.target if len(known) >= row.limit else None
            self._keep((row.product, row.context), 0, len(known), reason, None, int(row.limit), int(row.reported), int(row.done_pages), known)

    def _keep(self, key: tuple, page, collected, reason, signature, target, reported, done, known: set) -> None:
        """What has ended looks at no identity any more."""
        seen = json.dumps(sorted(known, key=str)) if reason is None else "[]"
        self.at.updateValue(key, (page, collected, reason, signature, target, reported, done, seen))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("page")
        pages: dict[tuple, list] = {}
        for row in frame.itertuples():
            pages.setdefault((row.product, row.context), []).append(row)
        out = [(*name, *found) for name, looked in pages.items() if (found := self._fold(name, looked))]
        yield pd.DataFrame(out, columns=["product", "context", "completed_pages", "collected_reviews", "stop_reason"])

    def _fold(self, name: tuple, looked: list) -> tuple | None:
        """The checkpoint of a collection after some pages; null if it has no plan."""
        state = self.at.getValue(name)
        if state is None:
            return None
        page, collected, reason, signature, target, reported, done, seen = state
        if reason is not None:
            return max(page, done), collected, reason
        known = set(json.loads(seen))
        for row in looked:
            if reason is not None or row.page > self.most:
                break
            if page and row.found and row.signature and row.signature == signature:
                reason = self.reasons.unchanged
                break
            if not row.found and row.page == 1:
                reason = "review_widget_missing" if reported > 0 else "no_reviews"
                break
            page, signature = int(row.page), row.signature or ""
            for review in sorted(row.reviews, key=lambda r: r["pos"]) if row.found else ():
                if collected < target and review["identity"] not in known:
                    known.add(review["identity"])
                    collected += 1
            reason = self._reason(row, page, collected, target, signature)
        self._keep(name, page, collected, reason, signature, target, reported, done, known)
        return max(page, done), collected, reason

    def _reason(self, row, page: int, collected: int, target: int, signature: str) -> str | None:
        checks = (
            (not row.found, self.reasons.container), (row.found and not len(row.reviews), self.reasons.empty), (collected >= target, self.reasons.target),
            (not signature, self.reasons.signature), (row.outcome is not None, row.outcome), (page == self.most, self.reasons.cap),
        )
        return next((why for so, why in checks if so), None)

    def close(self) -> None:
        pass


def pages_stream(pages: DataFrame, plan: DataFrame, most: int, reasons: Reasons = PAGES, buckets: int = 1024) -> DataFrame:
    """The same on a stream: a checkpoint for each product and scope that a batch has pages of.

    ``pages`` has each page's ``reviews`` (``pos``, ``identity``) as an array, and comes in page order over batches; ``plan`` has the stored ``identities`` as one.
    State needs the RocksDB provider.  Python is called once for each of ``buckets`` (a checkpoint stays with their number), and state is kept by product and
    scope, so a batch reads and writes the collections of its own pages only; one that has ended is not written again.
    A page with the signature of the one before shows that the page before could not be left, so that reason comes with the next page.
    """
    bucket = free("bucket", pages.columns, plan.columns)
    keyed = lambda rows: rows.withColumn(bucket, F.pmod(F.xxhash64(*KEYS), F.lit(buckets))).groupBy(bucket)
    return keyed(pages).transformWithStateInPandas(_Collections(most, reasons), outputStructType=CHECKPOINT, outputMode="Update", timeMode="None", initialState=keyed(plan))


def signature_of(reviews: Column, first: int = 2) -> Column:
    """A page's first identities in order of place; empty without reviews."""
    return F.array_join(F.transform(F.slice(F.array_sort(reviews), 1, first), lambda r: r["identity"]), "|")
