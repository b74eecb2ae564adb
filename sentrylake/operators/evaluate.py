"""Evaluation of scores, windows and incidents against labels.

Labels enter only here. Curves work on one row per distinct score.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import group_quantiles, running_totals
from sentrylake.functions.text import present


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """Adds the derived metrics to columns tp, fp, fn, tn; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.withColumns(
        {
            "precision": p,
            "recall": r,
            "specificity": _ratio(tn, tn + fp),
            "fpr": _ratio(fp, tn + fp),
            "f1": _ratio(2 * p * r, p + r),
            "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        }
    )


def confusion_metrics(rows: DataFrame, truth="y", predicted="pred", by=()) -> DataFrame:
    y, p = F.col(truth) == 1, F.coalesce(F.col(predicted), F.lit(0)) == 1
    counts = rows.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    return metrics_from_counts(counts)


def cumulative_counts(rows: DataFrame, truth="y", score="score") -> DataFrame:
    """Per distinct score: rows and positives at or above it, and the totals."""
    per = (
        rows.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("bigint")).alias("pos"))
    )
    cum = running_totals(per, [F.col("score").desc()], ["n", "pos"])
    totals = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"), F.coalesce(F.sum("pos"), F.lit(0)).alias("pos_all")
    )
    return cum.crossJoin(F.broadcast(totals))


def roc_auc(rows: DataFrame, truth="y", score="score") -> DataFrame:
    """Mann-Whitney area: ties count half. Null when a class is empty."""
    neg = F.col("n") - F.col("pos")
    neg_below = (F.col("n_all") - F.col("pos_all")) - (F.col("cum_n") - F.col("cum_pos"))
    u = F.sum(F.col("pos") * (neg_below + neg / 2))
    pairs = F.max(F.col("pos_all") * (F.col("n_all") - F.col("pos_all")))
    return cumulative_counts(rows, truth, score).agg(
        u.alias("u_statistic"), F.try_divide(u, pairs).alias("roc_auc")
    )


def average_precision(rows: DataFrame, truth="y", score="score") -> DataFrame:
    step = _ratio(F.col("pos"), F.col("pos_all")) * (F.col("cum_pos") / F.col("cum_n"))
    return cumulative_counts(rows, truth, score).agg(F.sum(step).alias("average_precision"))


def pr_curve(rows: DataFrame, truth="y", score="score") -> DataFrame:
    return cumulative_counts(rows, truth, score).select(
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        _ratio(F.col("cum_pos"), F.col("pos_all")).alias("recall"),
        "cum_n", "cum_pos", "n", "pos",
    )


def roc_curve(rows: DataFrame, truth="y", score="score") -> DataFrame:
    neg_all = F.col("n_all") - F.col("pos_all")
    return cumulative_counts(rows, truth, score).select(
        F.col("score").alias("threshold"),
        _ratio(F.col("cum_pos"), F.col("pos_all")).alias("tpr"),
        _ratio(F.col("cum_n") - F.col("cum_pos"), neg_all).alias("fpr"),
    )


def pr_auc_trapezoid(rows: DataFrame, truth="y", score="score") -> DataFrame:
    """Trapezoid area under (recall, precision), starting at (0, 1).

    The previous point of each distinct score follows from its own counts, so
    no second ordered pass is needed.
    """
    before_n, before_pos = F.col("cum_n") - F.col("n"), F.col("cum_pos") - F.col("pos")
    precision = F.col("cum_pos") / F.col("cum_n")
    before = F.when(before_n == 0, 1.0).otherwise(F.try_divide(before_pos, before_n))
    area = _ratio(F.col("pos"), F.col("pos_all")) * (precision + before) / 2
    return cumulative_counts(rows, truth, score).agg(F.sum(area).alias("pr_auc"))


def threshold_sweep(rows: DataFrame, thresholds, truth="y", score="score") -> DataFrame:
    """Confusion metrics per threshold (score >= threshold predicts 1).

    Scores are first dropped to the highest grid value they reach, so the grid
    is joined to at most one row per grid value.
    """
    grid = sorted(float(t) for t in thresholds)
    literal = F.array(*[F.lit(t) for t in grid])
    reached = F.size(F.filter(literal, lambda t: t <= F.col(score)))
    per = rows.groupBy(reached.alias("reached")).agg(
        F.count("*").alias("n"), F.sum(F.col(truth).cast("bigint")).alias("pos")
    )
    spark = rows.sparkSession
    steps = spark.range(len(grid)).select(
        F.element_at(literal, (F.col("id") + 1).cast("int")).alias("threshold"),
        (F.col("id") + 1).alias("position"),
    )
    side = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    hit = F.col("reached") >= F.col("position")
    counts = per.crossJoin(F.broadcast(steps)).groupBy("threshold").agg(
        side(hit, "pos").alias("tp"),
        side(hit, "n").alias("_flagged"),
        side(~hit, "pos").alias("fn"),
        side(~hit, "n").alias("_rest"),
    )
    return metrics_from_counts(
        counts.select(
            "threshold", "tp", (F.col("_flagged") - F.col("tp")).alias("fp"), "fn",
            (F.col("_rest") - F.col("fn")).alias("tn"),
        )
    )


def best_f1_threshold(rows: DataFrame, truth="y", score="score") -> DataFrame:
    """The PR-curve point with the best F1; the highest threshold on ties."""
    f1 = F.col("cum_pos") * 2.0 / (F.col("cum_n") + F.col("pos_all"))
    best = cumulative_counts(rows, truth, score).agg(
        F.max(F.struct(f1.alias("f1"), "score", "cum_pos", "cum_n", "pos_all")).alias("b")
    )
    return best.select(
        F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"),
        (F.col("b.cum_pos") / F.col("b.cum_n")).alias("precision"),
        _ratio(F.col("b.cum_pos"), F.col("b.pos_all")).alias("recall"),
    )


def alert_burden(sweep: DataFrame, hours: float) -> DataFrame:
    alerts = F.col("tp") + F.col("fp")
    return sweep.select(
        "threshold", alerts.alias("alerts"), (alerts / F.lit(float(hours))).alias("alerts_per_hour"),
        _ratio(F.col("fp"), alerts).alias("false_discovery_rate"), "precision", "recall", "f1",
    )


def constrained_threshold(burden: DataFrame, max_per_hour=2.0, min_precision=0.10) -> DataFrame:
    """The best-F1 grid threshold within the alert budget; no row when none fits."""
    fits = burden.filter(
        (F.col("alerts_per_hour") <= max_per_hour) & (F.col("precision") >= min_precision)
    )
    return fits.orderBy(F.col("f1").desc(), F.col("threshold").desc()).limit(1)


def score_distribution(rows: DataFrame, truth="y", score="score") -> DataFrame:
    """Count, mean, population std and quartiles of the scores of each class."""
    per = rows.groupBy(F.col(truth).alias("y"), F.col(score).cast("double").alias("score")).agg(
        F.count("*").alias("w")
    )
    n = F.sum("w")
    mean = F.sum(F.col("score") * F.col("w")) / n
    square = F.sum(F.col("score") * F.col("score") * F.col("w")) / n
    moments = per.groupBy("y").agg(
        n.alias("n"), mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("std"),
        F.min("score").alias("minimum"), F.max("score").alias("maximum"),
    )
    cuts = group_quantiles(per, ["y"], "score", "w", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(cuts, "y")


def event_level_eval(events: DataFrame, flagged, in_incident, in_severe, truth="is_redteam") -> DataFrame:
    """Confusion metrics of three nested scopes; each scope is a table of event ids."""
    rows = events.select("event_id", F.col(truth).alias("y"))
    scopes = [("specialists", flagged), ("incidents", in_incident), ("escalated", in_severe)]
    for name, ids in scopes:
        rows = rows.join(ids.select("event_id", F.lit(1).alias(name)).distinct(), "event_id", "left")
    long = rows.select("y", *[F.coalesce(name, F.lit(0)).alias(name) for name, _ in scopes]).unpivot(
        ["y"], [name for name, _ in scopes], "scope", "pred"
    )
    return confusion_metrics(long, by=("scope",))


def match_labels(labels: DataFrame, members: DataFrame, bridge: DataFrame, tolerances=V.MATCH_TOLERANCES,
                 block=3600) -> DataFrame:
    """Distinct (tolerance, event_id of the label, component) that match.

    A label matches an incident when its time lies within the incident's span
    widened by the tolerance and its user or one of its hosts is in it. Equi
    join on (type, entity, level, time block): each span takes the block size
    of its own length (doubling per level), so it covers at most two blocks
    however long it is, and an entity in many incidents is spread over time.
    """
    reach = max(tolerances)
    spans = members.groupBy("component").agg(
        F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1")
    )
    low, high = F.floor((F.col("t0") - reach) / block), F.floor((F.col("t1") + reach) / block)
    level = F.when(high > low, F.ceil(F.log2((high - low).cast("double")))).otherwise(0).cast("int")
    at_level = lambda b, l: F.floor(b / F.pow(F.lit(2.0), l)).cast("bigint")
    spans = spans.withColumn("_level", level).select(
        "component", "t0", "t1", "_level",
        F.explode(F.array_distinct(F.array(at_level(low, F.col("_level")), at_level(high, F.col("_level"))))).alias("_block"),
    )
    # the levels in use: at most the logarithm of the covered time
    levels = spans.select("_level").distinct().agg(F.collect_set("_level").alias("_levels"))
    sides = bridge.filter(F.col("entity_type").isin("user", "host")).join(spans, "component")
    entry = lambda kind, c: F.struct(F.lit(kind).alias("entity_type"), present(c).alias("entity"))
    wanted = (
        labels.select(
            "event_id", "timestamp",
            F.explode(F.array_distinct(F.array(
                entry("user", "user"), entry("host", "source_host"), entry("host", "destination_host")
            ))).alias("e"),
        )
        .select("event_id", "timestamp", "e.entity_type", "e.entity")
        .filter(F.col("entity").isNotNull())
        .crossJoin(F.broadcast(levels))
        .withColumn("_level", F.explode("_levels"))
        .withColumn("_block", at_level(F.floor(F.col("timestamp") / block), F.col("_level")))
        .drop("_levels")
    )
    t = F.col("timestamp")
    distance = F.greatest(F.lit(0), F.col("t0") - t, t - F.col("t1"))
    nearest = (
        wanted.join(sides, ["entity_type", "entity", "_level", "_block"])
        .filter(distance <= reach)
        .groupBy("event_id", "component")
        .agg(F.min(distance).alias("distance"))
    )
    return nearest.withColumn(
        "tolerance", F.explode(F.array(*[F.lit(x) for x in tolerances]))
    ).filter(F.col("distance") <= F.col("tolerance")).select("tolerance", "event_id", "component")


def incident_attack_match(labels, members, bridge, tolerances=V.MATCH_TOLERANCES) -> DataFrame:
    """Captured and missed labels, and matched incidents, per tolerance."""
    matched = match_labels(labels, members, bridge, tolerances).groupBy("tolerance").agg(
        F.countDistinct("event_id").alias("captured"), F.countDistinct("component").alias("tp_incidents")
    )
    spark = labels.sparkSession
    grid = spark.createDataFrame([(t,) for t in tolerances], "tolerance int")
    attacks = labels.agg(F.countDistinct("event_id").alias("attacks"))
    incidents = members.agg(F.countDistinct("component").alias("incidents"))
    got, hit = F.coalesce("captured", F.lit(0)), F.coalesce("tp_incidents", F.lit(0))
    return (
        grid.join(matched, "tolerance", "left")
        .crossJoin(F.broadcast(attacks))
        .crossJoin(F.broadcast(incidents))
        .select(
            "tolerance", "attacks", got.alias("captured"), (F.col("attacks") - got).alias("missed"),
            F.round(_ratio(got * 100, F.col("attacks")), 2).alias("attack_recall"),
            "incidents", hit.alias("tp_incidents"), (F.col("incidents") - hit).alias("fp_incidents"),
            F.round(_ratio(hit * 100, F.col("incidents")), 2).alias("incident_precision"),
        )
    )


def unmatched_attacks(labels, members, bridge, tolerance=60) -> DataFrame:
    return labels.join(match_labels(labels, members, bridge, [tolerance]), "event_id", "left_anti")


def windows_with_events(windows: DataFrame, flagged: DataFrame, size=V.WINDOW_SECONDS) -> DataFrame:
    """Window ids with a flagged event in [t_start, t_end], both ends included.

    Flagged seconds and windows meet on a time bin of the window size.
    """
    binned = windows.select(
        "window_id", "t_start", "t_end",
        F.explode(F.sequence(F.floor(F.col("t_start") / size), F.floor(F.col("t_end") / size))).alias("_bin"),
    )
    seconds = flagged.select("timestamp").distinct().withColumn("_bin", F.floor(F.col("timestamp") / size))
    return (
        binned.join(seconds, "_bin")
        .filter(F.col("timestamp").between(F.col("t_start"), F.col("t_end")))
        .select("window_id").distinct()
    )


def windows_with_spans(windows: DataFrame, spans: DataFrame, block=3600) -> DataFrame:
    """Window ids overlapped by a span (time_start, time_end), closed intervals.

    A window is overlapped iff the latest end among the spans that start by the
    window's end reaches the window's start: a running maximum over time. Spans
    are first reduced to one latest end per start second, so neither their
    number nor their length matters; the maximum runs inside time blocks and
    then over one row per block.
    """
    starts = spans.groupBy(F.col("time_start").alias("t")).agg(F.max("time_end").alias("reach"))
    none = F.lit(None).cast("bigint")
    points = starts.select("t", F.lit(0).alias("kind"), "reach", none.alias("window_id"), none.alias("t_start")).unionByName(
        windows.select(
            F.col("t_end").alias("t"), F.lit(1).alias("kind"), none.alias("reach"),
            F.col("window_id").cast("bigint").alias("window_id"), F.col("t_start").cast("bigint").alias("t_start"),
        )
    ).withColumn("_block", F.floor(F.col("t") / block))
    inside = W.partitionBy("_block").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    # one row per block of the covered time
    blocks = points.groupBy("_block").agg(F.max("reach").alias("_top"))
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select("_block", F.max("_top").over(earlier).alias("_carry"))
    return (
        points.withColumn("_here", F.max("reach").over(inside))
        .filter(F.col("kind") == 1)
        .join(carried, "_block")
        .filter(F.greatest("_here", "_carry") >= F.col("t_start"))
        .select("window_id").distinct()
    )


def window_alert_overlap(windows, flagged, spans, size=V.WINDOW_SECONDS) -> DataFrame:
    """Adds 0/1 event_alert and incident_alert to each window."""
    mark = lambda ids, c: ids.select("window_id", F.lit(1).alias(c))
    return (
        windows.join(mark(windows_with_events(windows, flagged, size), "event_alert"), "window_id", "left")
        .join(mark(windows_with_spans(windows, spans), "incident_alert"), "window_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("event_alert", "incident_alert")})
    )


def four_system_comparison(windows, triage_flagged, graph_clusters, scored, incidents,
                           thresholds=(0.8459, 0.93)) -> DataFrame:
    """Rules, graph clusters, model thresholds and incidents on the same windows.

    `windows` has window_id, t_start, t_end, y; `scored` has window_id, score.
    """
    mark = lambda ids, c: ids.select("window_id", F.lit(1).alias(c))
    rows = (
        windows.join(mark(windows_with_events(windows, triage_flagged), "rule_triage"), "window_id", "left")
        .join(mark(windows_with_spans(windows, graph_clusters), "graph_clusters"), "window_id", "left")
        .join(mark(windows_with_spans(windows, incidents), "incidents"), "window_id", "left")
        .join(scored.select("window_id", "score"), "window_id", "left")
    )
    models = {f"model_{t}": (F.col("score") >= t).cast("int") for t in thresholds}
    rows = rows.withColumns(models)
    names = ["rule_triage", "graph_clusters", "incidents", *models]
    long = rows.select("y", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names]).unpivot(
        ["y"], [F.col(f"`{n}`") for n in names], "system", "pred"
    )
    return confusion_metrics(long, by=("system",))


def specialist_ablation(events: DataFrame, findings: DataFrame, order=None, truth="is_redteam") -> DataFrame:
    """Metrics as specialists are added one by one."""
    order = order or V.AGENT_ORDER
    position = F.array_position(F.array(*[F.lit(a) for a in order]), F.col("agent"))
    first = findings.groupBy("event_id").agg(F.min(position).alias("first_at"))
    rows = events.select("event_id", F.col(truth).alias("y")).join(first, "event_id", "left")
    # counted before the expansion by stage
    packed = rows.groupBy("y", "first_at").agg(F.count("*").alias("n"))
    stages = packed.withColumn("stage", F.explode(F.array(*[F.lit(i + 1) for i in range(len(order))])))
    hit = F.coalesce(F.col("first_at") <= F.col("stage"), F.lit(False))
    y = F.col("y") == 1
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    counts = stages.groupBy("stage").agg(
        side(y & hit).alias("tp"), side(~y & hit).alias("fp"), side(y & ~hit).alias("fn"), side(~y & ~hit).alias("tn")
    )
    return metrics_from_counts(counts)


def period_comparison(events: DataFrame, predictions: DataFrame, periods, bucket, truth="is_redteam") -> DataFrame:
    """Metrics per named inclusive range of `bucket` (a day); missing predictions are 0."""
    rows = events.select("event_id", bucket.alias("_day"), F.col(truth).alias("y")).join(
        predictions.select("event_id", "pred"), "event_id", "left"
    )
    packed = rows.groupBy("_day", "y", F.coalesce("pred", F.lit(0)).alias("pred")).agg(F.count("*").alias("n"))
    inside = F.filter(
        F.array(*[F.when(F.col("_day").between(a, b), F.lit(name)) for name, a, b in periods]),
        lambda x: x.isNotNull(),
    )
    y, p = F.col("y") == 1, F.col("pred") == 1
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    counts = packed.withColumn("period", F.explode(inside)).groupBy("period").agg(
        side(y & p).alias("tp"), side(~y & p).alias("fp"), side(y & ~p).alias("fn"), side(~y & ~p).alias("tn")
    )
    return metrics_from_counts(counts)


def label_match_audit(labels: DataFrame, events: DataFrame, size=V.WINDOW_SECONDS, origin=V.STUDY_ORIGIN):
    """How many labels have a matching event under each criterion."""
    window = F.floor((F.col("timestamp") - origin) / size).alias("w")
    l, e = labels.withColumn("w", window), events.withColumn("w", window)
    criteria = {
        "exact": ["timestamp", "user", "source_host", "destination_host"],
        "time_user": ["timestamp", "user"],
        "time_source": ["timestamp", "source_host"],
        "time_destination": ["timestamp", "destination_host"],
        "window_user": ["w", "user"],
        "window_source": ["w", "source_host"],
        "window_destination": ["w", "destination_host"],
    }
    parts = []
    for name, keys in criteria.items():
        seen = e.select(*keys).distinct()
        parts.append(
            l.join(seen, keys, "left_semi").agg(F.lit(name).alias("criterion"), F.count("*").alias("matched"))
        )
    total = labels.agg(F.count("*").alias("labels"))
    return reduce(DataFrame.unionByName, parts).crossJoin(F.broadcast(total))


def label_invariance_check(run, events: DataFrame, label="is_redteam") -> DataFrame:
    """Rows that `run` produces only with, or only without, altered labels; empty is right."""
    plain = run(events)
    flipped = run(events.withColumn(label, F.lit(1) - F.col(label)))
    zeroed = run(events.withColumn(label, F.lit(0)))
    differences = [
        plain.exceptAll(flipped), flipped.exceptAll(plain), plain.exceptAll(zeroed), zeroed.exceptAll(plain),
    ]
    return reduce(DataFrame.unionByName, differences)


def coverage_metrics(events: DataFrame, members: DataFrame, truth="is_redteam") -> DataFrame:
    labels = events.filter(F.col(truth) == 1).select("event_id")
    inside = members.join(labels, "event_id", "left_semi").agg(
        F.count("*").alias("captured"), F.countDistinct("component").alias("label_incidents")
    )
    totals = events.agg(F.count("*").alias("events"), F.sum(F.col(truth).cast("bigint")).alias("labels"))
    incidents = members.agg(F.countDistinct("component").alias("incidents"))
    return totals.crossJoin(F.broadcast(inside)).crossJoin(F.broadcast(incidents)).withColumns(
        {
            "label_coverage": _ratio(F.col("captured") * 100, F.col("labels")),
            "alert_reduction": _ratio((F.col("events") - F.col("incidents")) * 100, F.col("events")),
        }
    )


def model_select(metrics: DataFrame, first="f1", then="average_precision") -> DataFrame:
    return metrics.orderBy(F.col(first).desc(), F.col(then).desc(), "model").limit(1)
