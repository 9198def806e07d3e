"""A cap per feed whose overflow goes to later feeds, round by round over what the last round turned away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.operators.ranking import top_n
from gleaner.operators.running import running_before
from gleaner.session import drop_table, write_table

#: Feeds that a key carries along at a time; a key that is listed by more fetches the next ones when it has asked these.
OPTIONS = 16
#: Rounds whose rows are read side by side before they are merged.
PARTS = 12


def _options(candidates: DataFrame, feed_order: list[str], key: str, position: str) -> DataFrame:
    """``key, page, options``: the feeds that list a key, in feed order, in pages of a bounded number; written."""
    feed, place = F.struct(*feed_order), F.struct(F.col(position).alias("pos"), F.col(key).alias("key"))
    listed = candidates.filter(F.col(key) != "").groupBy(feed.alias("feed"), F.col(key).alias("key")).agg(F.min(place).alias("place"))
    listed = write_table(listed)
    most = listed.groupBy("key").agg(F.count(F.lit(1)).alias("feeds")).agg(F.max("feeds")).first()[0] or 0
    # Places are only needed where a key has more than one page.
    numbered = listed.withColumn("at", F.lit(0)) if most <= OPTIONS else running_before(listed, "key", [F.col("feed")], {"at": ("count", "key", 0)})
    paged = numbered.groupBy("key", F.floor(F.col("at") / OPTIONS).alias("page"))
    options = write_table(paged.agg(F.sort_array(F.collect_list(F.struct("feed", "place"))).alias("options")))
    drop_table(listed)
    return options


def _asking(frontier: DataFrame) -> DataFrame:
    """Each key asks its first option and keeps the rest."""
    first = F.get("options", F.lit(0))
    rest = F.slice("options", F.lit(2), F.greatest(F.size("options") - 1, F.lit(0)))
    return frontier.select(first["feed"].alias("feed"), first["place"].alias("place"), "key", "page", rest.alias("options"))


def _refilled(turned_away: DataFrame, further: DataFrame | None) -> DataFrame:
    """Keys that go on: with options left, or with the next page of them. The others are out."""
    ready = turned_away.filter(F.size("options") > 0).select("key", "page", "options")
    if further is None:
        return ready
    empty = turned_away.filter(F.size("options") == 0).select("key", (F.col("page") + 1).alias("page"))
    return ready.unionByName(empty.join(further, ["key", "page"]))


def cap_with_spillover(
    candidates: DataFrame, feed_order: list[str], key: str, position: str, n: int = K.FEED_CAP, rounds: list[tuple[int, int]] | None = None
) -> DataFrame:
    """Feeds in order each save their first ``n`` candidates that no earlier feed saved.

    Every key asks its first feed. A feed keeps the first ``n`` of all that ever asked it and turns the others away; they ask their
    next feed in the next round, until nobody is turned away. A feed's list only gets better, so no key has to ask twice.

    A round reads and writes the keys that the last round turned away, and what the feeds they ask hold, nothing else: who was let in is
    written once, in the round of asking, and a feed that nobody asks any more stays untouched. Keys ask in feed order, so feeds
    before the first one asked are settled and their rows are not read again. Keys carry their next feeds along, ``OPTIONS`` at a time. Blank
    and null keys are no candidates; a key listed twice by a feed counts at its first place. ``rounds`` receives, for each round, how many
    keys asked and how many rows were written.
    """
    options = _options(candidates, feed_order, key, position)
    further = options.filter("page > 0")
    further = None if further.isEmpty() else further
    frontier, let_in, done = options.filter("page = 0"), [], [options]
    lead = F.col(f"feed.{feed_order[0]}")
    number, first = _asking(frontier).agg(F.count(F.lit(1)), F.min(lead)).first()
    while number:
        asks = _asking(frontier)
        pool = asks.withColumn("asked", F.lit(True))
        if let_in:
            # Feeds before the first one asked are settled. Of all that were ever let in, those behind the cut had to go in an earlier round.
            still_open = _stacked(let_in) if first is None else _stacked(let_in).filter(lead.isNull() | (lead >= F.lit(first)))
            feeds = asks.select(F.col("feed").alias("_feed")).distinct()
            held = top_n(still_open.join(feeds, F.col("feed").eqNullSafe(F.col("_feed")), "left_semi"), "feed", "place", n)
            pool = pool.unionByName(held.withColumn("asked", F.lit(False)))
        cuts = top_n(pool, "feed", "place", n, "rank").filter(F.col("rank") == n).select(F.col("feed").alias("_feed"), F.col("place").alias("cut"))
        judged = pool.join(cuts, F.col("feed").eqNullSafe(F.col("_feed")), "left").withColumn("stays", F.col("cut").isNull() | (F.col("place") <= F.col("cut")))
        # Rows that were let in before and stay are written already.
        # How many ask next, and which feed first, is counted while the rows are written.
        watch, goes_on = Observation(), ~F.col("stays") & (F.size("options") > 0)
        judged = judged.filter("asked or not stays").drop("_feed", "cut")
        next_lead = F.get("options", F.lit(0))["feed"][feed_order[0]]
        judged = write_table(judged.observe(watch, F.count(F.lit(1)).alias("rows"), F.count_if(goes_on).alias("asking"), F.min(F.when(goes_on, next_lead)).alias("lead")))
        if rounds is not None:
            rounds.append((number, watch.get["rows"]))
        frontier = _refilled(judged.filter("not stays"), further)
        number, first = watch.get["asking"], watch.get["lead"]
        if further is not None:
            number, first = _asking(frontier).agg(F.count(F.lit(1)), F.min(lead)).first()
        let_in.append(judged.filter("stays").drop("stays", "asked"))
        done.append(judged)
        if len(let_in) > PARTS:
            let_in = [write_table(top_n(_stacked(let_in), "feed", "place", n))]
            # What is merged is not read again, but for the last round's rows, which the frontier comes from.
            for table in done[1:-1]:
                drop_table(table)
            done = [options, judged, let_in[0]]
    if not let_in:
        return options.limit(0).select(F.get("options", F.lit(0)).alias("_o")).select("_o.feed.*", F.col("_o.place.key").alias(key), F.col("_o.place.pos").alias(position))
    saved = top_n(_stacked(let_in), "feed", "place", n).select(F.col("feed.*"), F.col("place.key").alias(key), F.col("place.pos").alias(position))
    saved = write_table(saved)
    for table in done:
        drop_table(table)
    return saved


def _stacked(parts: list[DataFrame]) -> DataFrame:
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked
