"""Where products stand in the discovery queue: a log of events replayed by a table of transitions.

An event maps states to states, and so do events one after the other.  So any stretch of a product's log folds into one map before
it is known in which state it begins; stretches of a log of any length are folded in parallel, and then joined in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states of the queue.
STATES = ("discovered", "checking", "scraping", "complete", "rejected", "retryable_error")

#: From each state, the events that are allowed and where they lead; others leave the state as it is and are reported.
TRANSITIONS: dict[str, dict[str, str]] = {
    "discovered": {"check": "checking", "scrape": "scraping", "fail": "retryable_error", "reject": "rejected"},
    "checking": {"qualify": "discovered", "reject": "rejected", "scrape": "scraping", "fail": "retryable_error"},
    "scraping": {"finish": "complete", "fail": "retryable_error", "check": "checking"},
    "complete": {"check": "checking"},
    "rejected": {"check": "checking"},
    "retryable_error": {"check": "checking", "scrape": "scraping", "fail": "retryable_error"},
}

#: Events of a product that are folded in one row at most.
STRETCH = 1024


def _moves(transitions: dict[str, dict[str, str]]) -> tuple[list[str], Column]:
    """Events by number, and for each the list of (state after, is it forbidden) by the number of the state before."""
    events = sorted({e for moves in transitions.values() for e in moves})
    at = {s: k for k, s in enumerate(STATES)}
    cell = lambda s, e: F.struct(F.lit(at[transitions[s][e]] if e in transitions.get(s, {}) else at[s]).alias("to"), F.lit(0 if e in transitions.get(s, {}) else 1).alias("bad"))
    return events, F.array(*[F.array(*[cell(s, e) for s in STATES]) for e in events])


def replay(log: DataFrame, snapshot: DataFrame | None = None, transitions: dict[str, dict[str, str]] = TRANSITIONS, stretch: int = STRETCH) -> DataFrame:
    """The state of every product after its log: ``product``, ``state``, ``upto`` (the last ``seq``), ``forbidden`` (events that weren't allowed).

    ``log``: ``product``, ``seq`` (unique within a product), ``event``; unknown events are forbidden in every state.  ``snapshot``: ``product``, ``state`` and ``upto``
    (events up to there are not replayed again); products of either side come out, and one without a snapshot begins ``discovered``.
    Events are cut into stretches by ``seq``: a log may have gaps, so a stretch has ``stretch`` events or fewer.
    """
    events, table = _moves(transitions)
    number = F.create_map(*[x for k, e in enumerate(events) for x in (F.lit(e), F.lit(k))])
    names = F.array(*[F.lit(s) for s in STATES])
    stay = F.array(*[F.struct(F.lit(k).alias("to"), F.lit(1).alias("bad")) for k in range(len(STATES))])
    begin = F.array(*[F.struct(F.lit(k).alias("to"), F.lit(0).cast("long").alias("bad")) for k in range(len(STATES))])
    if snapshot is not None:
        held = snapshot.select("product", F.array_position(names, F.col("state")).cast("int").alias("k"), F.col("upto").alias("held"))
        log = log.join(held.select("product", "held"), "product", "left").where(F.col("held").isNull() | (F.col("seq") > F.col("held"))).drop("held")
    cut = log.withColumns({"part": F.floor(F.col("seq") / stretch), "move": F.try_element_at(number, F.col("event"))})
    one = lambda acc, move: F.transform(acc, lambda s: F.struct(
        F.get(F.coalesce(F.get(table, move), stay), s["to"])["to"].alias("to"), (s["bad"] + F.get(F.coalesce(F.get(table, move), stay), s["to"])["bad"]).alias("bad")))
    listed = F.array_sort(F.collect_list(F.struct("seq", "move")))
    folded = cut.groupBy("product", "part").agg(listed.alias("moves")).select("product", "part", F.get("moves", F.size("moves") - 1)["seq"].alias("n"), F.aggregate("moves", begin, lambda acc, x: one(acc, x["move"])).alias("map"))
    # Stretches of a product join in the same way; a log of a million stretches would be joined in two steps.
    group = folded.groupBy("product", F.floor(F.col("part") / stretch).alias("part"))
    group = group.agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "map"))).alias("maps"))
    then = lambda acc, x: F.transform(acc, lambda s: F.struct(F.get(x["map"], s["to"])["to"].alias("to"), (s["bad"] + F.get(x["map"], s["to"])["bad"]).alias("bad")))
    joined = group.select("product", "part", "n", F.aggregate("maps", begin, then).alias("map"))
    whole = joined.groupBy("product").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "map"))).alias("maps")).select("product", "n", F.aggregate("maps", begin, then).alias("map"))
    if snapshot is None:
        whole = whole.withColumns({"k": F.lit(1), "held": F.lit(None).cast("long")})
    else:
        whole = whole.join(held, "product", "full_outer").withColumns({"k": F.coalesce("k", F.lit(1)), "map": F.coalesce("map", begin)})
    end = F.get("map", F.col("k") - 1)
    return whole.select("product", F.get(names, end["to"]).alias("state"), F.greatest("n", "held").alias("upto"), end["bad"].alias("forbidden"))


def forbidden_events(log: DataFrame, transitions: dict[str, dict[str, str]] = TRANSITIONS) -> DataFrame:
    """Events that are allowed in no state at all: they need no replay to be found."""
    known = {e for moves in transitions.values() for e in moves}
    return log.where(~F.col("event").isin(*known) | F.col("event").isNull())


def last_events(log: DataFrame, n: int) -> DataFrame:
    """The last events of each product, for a look at how it got where it is; a report, so it has a limit."""
    return log.withColumn("__k", F.row_number().over(Window.partitionBy("product").orderBy(F.desc("seq")))).where(F.col("__k") <= n).drop("__k")
