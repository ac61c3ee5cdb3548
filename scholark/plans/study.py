"""Analytics of session logs and feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholark.functions.scores import overlap_ratio
from scholark.sources.tables import table

FEEDBACK = "array<struct<cardId:string,feedback:array<struct<feedbackItemType:string,feedbackItemId:string,other:string,checked:array<string>,flag:boolean>>>>"


def click_segments(events: DataFrame, session: str, order: Sequence[str], is_click: Column, node: Column) -> DataFrame:
    """``events`` with ``segment`` (from 1) and ``node_id``: a new segment at each click, its node carried on; events before a
    session's first click go. A session is one person's log, so its rows fit one task."""
    window = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("segment", F.sum(is_click.cast("int")).over(window)).withColumn("node_id", F.last(F.when(is_click, node), ignorenulls=True).over(window))
    return marked.where("segment > 0")


def segment_durations(segments: DataFrame, session: str, order: Sequence[str], ts_ms: Column) -> DataFrame:
    """Per segment ``started``, ``duration_ms`` (to the last event with a timestamp), and whether it is its node's last and longest."""
    place = F.struct(*order)
    timed = segments.withColumn("__t", ts_ms)
    sums = timed.groupBy(session, "node_id", "segment").agg(F.min_by("__t", place).alias("started"), F.max_by("__t", F.when(F.col("__t").isNotNull(), place)).alias("ended"))
    sums = sums.withColumn("duration_ms", F.col("ended") - F.col("started"))
    node = Window.partitionBy(session, "node_id")
    longest = F.row_number().over(node.orderBy(F.desc_nulls_last("duration_ms"), "segment")) == 1
    return sums.withColumn("is_last", F.col("segment") == F.max("segment").over(node)).withColumn("is_longest", longest)


def think_aloud_flags(durations: DataFrame, session: str) -> DataFrame:
    """``is_first`` and ``is_last_card`` of each node by the start of its longest segment."""
    main = durations.where("is_longest").select(session, "node_id", "started", "segment")
    window = Window.partitionBy(session)
    first = F.row_number().over(window.orderBy("started", "segment")) == 1
    last = F.row_number().over(window.orderBy(F.desc("started"), F.desc("segment"))) == 1
    return main.withColumn("is_first", first).withColumn("is_last_card", last)


def flatten_feedback(logs: DataFrame, session: str, feedback: str = "feedbackList") -> DataFrame:
    """One row per checked thing: for ``card`` items each checked string (``other...`` replaced by its text), else items flagged."""
    items = logs.select(session, F.explode(feedback).alias("c")).select(session, F.col("c.cardId").alias("card_id"), F.explode("c.feedback").alias("f"))
    text = lambda s: F.when(F.startswith(s, F.lit("other")), F.col("f.other")).otherwise(s)
    cards = items.where("f.feedbackItemType = 'card'").select(session, "card_id", F.lit("card").alias("item_type"), F.explode(F.transform("f.checked", text)).alias("item"))
    others = items.where("f.feedbackItemType <> 'card' and f.flag").select(session, "card_id", F.col("f.feedbackItemType").alias("item_type"), F.col("f.feedbackItemId").alias("item"))
    return cards.unionByName(others)


def condition_rows(logs: DataFrame, session: str, conditions: str = "conditions") -> DataFrame:
    """``card_id``, ``condition``, ``hide_terms``, ``profile`` from the map of conditions by card."""
    rows = logs.select(session, F.explode(conditions).alias("card_id", "raw"))
    profile = F.when(F.contains("card_id", F.lit("A")), "persona A").when(F.contains("card_id", F.lit("B")), "persona B").otherwise("overall")
    return rows.select(session, "card_id", F.regexp_replace("raw", "_hideTerms", "").alias("condition"), F.contains("raw", F.lit("_hideTerms")).alias("hide_terms"), profile.alias("profile"))


def novelty_wins(rows: DataFrame, keys: Sequence[str], condition: str, value: str, far: str, near: str) -> DataFrame:
    """``win`` per ``keys``: 1 where the mean under ``far`` beats that under ``near``, null on a tie, 0 otherwise - also where
    either side has no rows."""
    means = rows.groupBy(*keys).agg(F.avg(F.when(F.col(condition) == far, F.col(value))).alias("a"), F.avg(F.when(F.col(condition) == near, F.col(value))).alias("b"))
    return means.select(*keys, F.when(F.col("a") == F.col("b"), F.lit(None).cast("int")).otherwise(F.coalesce((F.col("a") > F.col("b")).cast("int"), F.lit(0))).alias("win"))


def preference_delta(rows: DataFrame, keys: Sequence[str], condition: str, value: str, a: str, b: str) -> DataFrame:
    means = rows.groupBy(*keys).agg(F.avg(F.when(F.col(condition) == b, F.col(value))).alias("b"), F.avg(F.when(F.col(condition) == a, F.col(value))).alias("a"))
    return means.select(*keys, (F.col("b") - F.col("a")).alias("delta"))


#: Item types of a card; the last three are hidden with its terms. What of a type is on show: a bound, but for papers.
ITEM_TYPES, SHOWN, SHOWN_OF_CARD = ("card", "paper", "topic", "Task", "Method", "Material"), 10, 5


def result_rows(cards: DataFrame, checked: DataFrame, observed_papers: DataFrame) -> DataFrame:
    """One row per card and item type on show: ``cards`` with ``item_type``, ``num_checked``, ``num_observed``.

    ``cards`` has ``user_id``, ``card_id``, ``hide_terms``; ``checked`` a row per checked thing (``user_id``, ``card_id``,
    ``item_type``); ``observed_papers`` the papers on show (``user_id``, ``card_id``, ``n_observed``; none is 0).
    """
    counts = checked.groupBy("user_id", "card_id", "item_type").agg(F.count(F.lit(1)).alias("num_checked"))
    types = F.when(F.col("hide_terms"), F.array(*[F.lit(t) for t in ITEM_TYPES[:3]])).otherwise(F.array(*[F.lit(t) for t in ITEM_TYPES]))
    rows = cards.withColumn("item_type", F.explode(types)).join(counts, ["user_id", "card_id", "item_type"], "left").join(observed_papers, ["user_id", "card_id"], "left")
    shown = F.when(F.col("item_type") == "paper", F.coalesce("n_observed", F.lit(0))).when(F.col("item_type") == "card", F.lit(SHOWN_OF_CARD)).otherwise(F.lit(SHOWN))
    return rows.withColumn("num_checked", F.coalesce("num_checked", F.lit(0))).withColumn("num_observed", shown.cast("bigint")).drop("n_observed")


def overlap_features(cards: DataFrame, focal: DataFrame, names: Sequence[str]) -> DataFrame:
    """``cards`` with ``<name>_overlap``: Jaccard index of each array of a card with that of its focal (``user_id`` and the arrays)."""
    renamed = focal.withColumnsRenamed({n: f"__{n}" for n in names})
    joined = cards.join(renamed, "user_id", "left")
    for n in names:
        joined = joined.withColumn(f"{n}_overlap", overlap_ratio(F.col(n), F.col(f"__{n}"))).drop(f"__{n}")
    return joined


def mean_novelty(rows: DataFrame, subject: str, condition: str, value: str, far: Sequence[str], near: Sequence[str], without: Sequence[str] = ()) -> DataFrame:
    """``subject``, ``novelty``: mean over item types (but those ``without``) of whether ``far`` conditions beat ``near`` ones; ties
    and nothing else are left out, a side without rows counts as lost."""
    kept = rows.where(~F.col("item_type").isin(list(without))) if without else rows
    side = F.when(F.col(condition).isin(list(far)), "far").when(F.col(condition).isin(list(near)), "near")
    wins = novelty_wins(kept.withColumn("__side", side), [subject, "item_type"], "__side", value, "far", "near")
    return wins.where("win is not null").groupBy(subject).agg(F.avg("win").alias("novelty"))


def post_hoc_duplicates(ranked: DataFrame, cards: DataFrame, n: int = 10) -> DataFrame:
    """Cards that another condition would have shown among its ``n`` best: ``user_id``, ``condition``, ``card_id``.

    ``ranked`` has ``user_id``, ``condition``, ``card_id``, ``rank`` of all candidates, ``cards`` (``user_id``, ``condition``, ``card_id``,
    ``hide_terms``) those shown. A card is shared only where the condition that shows it shows its terms.
    """
    best = ranked.where(F.col("rank") <= n).select("user_id", "condition", "card_id").distinct()
    missing = best.join(cards.select("user_id", "condition", "card_id").distinct(), ["user_id", "condition", "card_id"], "left_anti")
    visible = cards.where(~F.col("hide_terms")).select("user_id", "card_id").distinct()
    return missing.join(visible, ["user_id", "card_id"], "left_semi")


#: Short names of conditions.
SHORT_CONDITIONS = {"simTask": "sT", "simTask_distMethod": "sTdM", "simspecter": "ss", "simspecter_hideTerms": "ss"}


def distance_measures(rows: DataFrame, condition: str, overlaps: Sequence[str]) -> DataFrame:
    """``rows`` with overlaps turned into distances and ``condition_short``; unknown conditions keep their name."""
    pairs = F.create_map(*[x for k, v in SHORT_CONDITIONS.items() for x in (F.lit(k), F.lit(v))])
    turned = rows.withColumns({c: F.lit(1) - F.col(c) for c in overlaps})
    return turned.withColumn("condition_short", F.coalesce(pairs[F.col(condition)], F.col(condition)))


def raw_feedback(rows: DataFrame, text: str, fixes: dict[str, str]) -> DataFrame:
    """``rows`` with literal text replacements in ``text``, applied in their order."""
    fixed = F.col(text)
    for old, new in fixes.items():
        fixed = F.replace(fixed, F.lit(old), F.lit(new))
    return rows.withColumn(text, fixed)


def quantile_bins(rows: DataFrame, column: str, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``rows`` with ``bin`` (from 0): right-closed intervals between exact quantiles, the lowest value included."""
    edges = rows.agg(F.expr(f"percentile(`{column}`, array({', '.join(map(str, shares))}))").alias("__e"))
    joined = rows.crossJoin(F.broadcast(edges))
    return joined.withColumn("bin", F.size(F.filter("__e", lambda e: e < F.col(column)))).drop("__e")


def top_union_count(rows: DataFrame, key: str, item: str, first: Sequence[Column], second: Sequence[Column], n: int = 5) -> DataFrame:
    """``n_observed``: different items among the first ``n`` of two orders."""
    window = Window.partitionBy(key)
    ranked = rows.withColumn("__a", F.row_number().over(window.orderBy(*first))).withColumn("__b", F.row_number().over(window.orderBy(*second)))
    return ranked.where((F.col("__a") <= n) | (F.col("__b") <= n)).groupBy(key).agg(F.countDistinct(item).alias("n_observed"))


def participant_percent(rows: DataFrame, variables: Sequence[str], tie: float = 0.5) -> DataFrame:
    """Melted ``variable``, ``outcome``, ``percent``: shares of outcomes within a variable, ties and nulls aside."""
    melted = rows.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("outcome")) for v in variables]))).where(F.col("outcome").isNotNull() & (F.col("outcome") != tie))
    counts = melted.groupBy("variable", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("variable", "outcome", (F.col("n") / F.sum("n").over(Window.partitionBy("variable")) * 100).alias("percent"))


def _events(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def _segments(spark, d):
    return click_segments(_events(spark, d), "user_id", ["us", "event_id"], F.col("event_type") == "click", F.col("k"))


def q_click_segments(spark, d):
    return _segments(spark, d).select("user_id", "event_id", F.col("segment").cast("bigint").alias("segment"), "node_id")


def q_segment_durations(spark, d):
    found = segment_durations(_segments(spark, d), "user_id", ["us", "event_id"], F.col("us"))
    return found.select("user_id", "node_id", F.col("segment").cast("bigint").alias("segment"), F.col("duration_ms").alias("duration_us"), "is_last", "is_longest")


def q_think_aloud_flags(spark, d):
    found = segment_durations(_segments(spark, d), "user_id", ["us", "event_id"], F.col("us"))
    return think_aloud_flags(found, "user_id").select("user_id", "node_id", "is_first", "is_last_card")


def q_feedback_flatten(spark, d):
    """Sessions rebuilt as nested logs from events, and flattened: errors are card feedback, purchases flagged items."""
    rows = _events(spark, d).where("event_type in ('error', 'purchase', 'view')")
    kind = F.when(F.col("event_type") == "error", "card").otherwise("term")
    item = F.struct(kind.alias("feedbackItemType"), F.col("event_id").cast("string").alias("feedbackItemId"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("other"), F.when(F.col("k") % 2 == 0, F.array(F.lit("known"), F.lit("other:"))).otherwise(F.array(F.lit("known"))).alias("checked"), (F.col("event_type") == "purchase").alias("flag"))
    cards = rows.groupBy("user_id", F.col("k").cast("string").alias("cardId")).agg(F.collect_list(item).alias("feedback"))
    logs = cards.groupBy("user_id").agg(F.collect_list(F.struct("cardId", "feedback")).alias("feedbackList"))
    return flatten_feedback(logs, "user_id")


def q_novelty_wins(spark, d):
    rows = _events(spark, d).withColumn("item_type", F.col("k") % 3)
    return novelty_wins(rows, ["user_id", "item_type"], "event_type", "value", "purchase", "view")


def q_preference_delta(spark, d):
    return preference_delta(_events(spark, d), ["user_id"], "event_type", "value", "view", "purchase").select("user_id", F.round("delta", 6).alias("delta"))


def q_percent_within(spark, d):
    wide = novelty_wins(_events(spark, d).withColumn("item_type", F.col("k") % 3), ["user_id", "item_type"], "event_type", "value", "purchase", "view")
    wide = wide.groupBy("user_id").pivot("item_type", [0, 1, 2]).agg(F.first("win")).toDF("user_id", "papers", "terms", "topics")
    return participant_percent(wide, ["papers", "terms", "topics"]).select("variable", "outcome", F.round("percent", 6).alias("percent"))


def q_quantile_bins(spark, d):
    return quantile_bins(_events(spark, d).select("event_id", "value"), "value").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"))


def q_top5_union_count(spark, d):
    rows = table(spark, d, "orders")
    first = [F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey")]
    second = [F.year("o_orderdate").desc_nulls_last(), F.lower(F.col("o_orderpriority")), F.col("o_orderkey")]
    return top_union_count(rows, "o_custkey", "o_orderkey", first, second)


def q_venue_diversity(spark, d):
    from scholark.plans import standin as st

    rows = st.authorship(spark, d).join(st.papers(spark, d), "PaperId")
    return rows.groupBy("AuthorId").agg(F.round(F.countDistinct("VenueId") / F.count(F.lit(1)), 6).alias("diversity"))


QUERIES = {f.__name__[2:]: f for f in (q_click_segments, q_segment_durations, q_think_aloud_flags, q_feedback_flatten, q_novelty_wins, q_preference_delta, q_percent_within, q_quantile_bins, q_top5_union_count, q_venue_diversity)}

_EV = "ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events)"
_SEG = f"{_EV}, m AS (SELECT *, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS segment FROM ev), s AS (SELECT *, first_value(k) OVER (PARTITION BY user_id, segment ORDER BY us, event_id) AS node_id FROM m WHERE segment > 0)"
_DUR = f"{_SEG}, du AS (SELECT user_id, node_id, segment, min(us) AS started, max(us) - min(us) AS dur FROM s GROUP BY ALL), dd AS (SELECT *, segment = max(segment) OVER (PARTITION BY user_id, node_id) AS is_last, row_number() OVER (PARTITION BY user_id, node_id ORDER BY dur DESC, segment) = 1 AS is_longest FROM du)"
_WIN = f"{_EV}, w0 AS (SELECT user_id, k % 3 AS item_type, avg(value) FILTER (event_type = 'purchase') AS a, avg(value) FILTER (event_type = 'view') AS b FROM ev GROUP BY ALL), w AS (SELECT user_id, item_type, CASE WHEN a = b THEN NULL ELSE coalesce(CAST(a > b AS INT), 0) END AS win FROM w0)"

ORACLES = {
    "click_segments": f"WITH {_SEG} SELECT user_id, event_id, segment, node_id FROM s",
    "segment_durations": f"WITH {_DUR} SELECT user_id, node_id, segment, dur AS duration_us, is_last, is_longest FROM dd",
    "think_aloud_flags": f"WITH {_DUR} SELECT user_id, node_id, row_number() OVER (PARTITION BY user_id ORDER BY started, segment) = 1 AS is_first, row_number() OVER (PARTITION BY user_id ORDER BY started DESC, segment DESC) = 1 AS is_last_card FROM dd WHERE is_longest",
    "feedback_flatten": f"WITH {_EV} SELECT user_id, CAST(k AS VARCHAR) AS card_id, 'card' AS item_type, unnest(CASE WHEN k % 2 = 0 THEN ['known', 'text ' || event_id] ELSE ['known'] END) AS item FROM ev WHERE event_type = 'error' UNION ALL SELECT user_id, CAST(k AS VARCHAR), 'term', CAST(event_id AS VARCHAR) FROM ev WHERE event_type = 'purchase'",
    "novelty_wins": f"WITH {_WIN} SELECT * FROM w",
    "preference_delta": f"WITH {_EV} SELECT user_id, round(avg(value) FILTER (event_type = 'purchase') - avg(value) FILTER (event_type = 'view'), 6) AS delta FROM ev GROUP BY 1",
    "percent_within": f"WITH {_WIN}, c AS (SELECT CASE item_type WHEN 0 THEN 'papers' WHEN 1 THEN 'terms' ELSE 'topics' END AS variable, CAST(win AS DOUBLE) AS outcome, count(*) AS n FROM w WHERE win IS NOT NULL GROUP BY ALL) SELECT variable, outcome, round(n / sum(n) OVER (PARTITION BY variable) * 100, 6) AS percent FROM c",
    "quantile_bins": f"WITH {_EV}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM ev) SELECT CAST((value > a) AS INT) + CAST((value > b) AS INT) + CAST((value > c) AS INT) AS bin, count(*) AS n, max(value) AS highest FROM ev, q GROUP BY 1",
    "top5_union_count": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, lower(o_orderpriority), o_orderkey) AS b FROM orders) SELECT o_custkey, count(DISTINCT o_orderkey) AS n_observed FROM r WHERE a <= 5 OR b <= 5 GROUP BY 1",
    "venue_diversity": "WITH paa AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT l_suppkey AS AuthorId, round(count(DISTINCT o_custkey) / count(*), 6) AS diversity FROM paa JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
}
