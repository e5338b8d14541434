"""Consensus of several annotators: iteratively reweighted voting.

Two steps alternate until no annotator's accuracy moves: a consensus by votes that count the
log-odds of their annotator being right, and the annotators' accuracy against the consensus that
the *others* would reach without them (leave one out, smoothed towards the mean).  An annotator
is as careful in one field as in another, so accuracy is pooled over fields.

Besides its votes a value has a prior from the labels themselves, the same in every round:
values with unreadable marks and values that another label of the cell continues (cut short) are
less credible, frequent dates and names without rare characters more.  Consensus is always one
of the labels given.  Agreement is reported per field as Krippendorff's nominal alpha, which is
corrected for chance and holds with missing ratings, and per cell as the share of its pairs of
labels that are equal.

Null labels are no votes; a cell without any has a null consensus; a label delivered twice
counts once; ties go to the larger value.  Readers without a user_id are unknown: each of their
labels (by label_id) is a vote of its own, with the accuracy that unknown readers have together.  The rounds end when no accuracy moves; where two answers would take turns, steps
are halved, and if nothing helps, the end is an error.
No group is gathered: every step is an aggregation
with map-side combine or a join on keys, hot annotators meet only their own small row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.session import cut_lineage

FIELDS = ("name_raw", "seniority_no", "commissioning_date")
UNREADABLE = "[〓□?？]"
#: Log-odds: of a particular wrong value among errors; of unreadable and of cut values.
PARTICULAR_ERROR, MARKED, CUT = 1.6, -4.0, -1.5
#: How much frequent dates and the rarest character of a name count.
DATE_PRIOR, CHAR_PRIOR = 0.7, 0.5
SMOOTHING, ROUNDS, STILL = 4.0, 200, 1e-3


def votes_of(labels: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Distinct ``(cell_id, field_name, user_id, value)``, of unknown readers one for each label;
    null values are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]))
    label = F.when(F.col("user_id").isNull(), F.col("label_id") if "label_id" in labels.columns else F.lit(None))
    rows = labels.select("cell_id", "user_id", label.alias("unknown"), pairs.alias("v")).select("cell_id", "user_id", "unknown", "v.*")
    return rows.where("value IS NOT NULL AND cell_id IS NOT NULL").distinct().drop("unknown")


def _rarest(candidates: DataFrame) -> DataFrame:
    """Log-frequency of the rarest character of each name, by place (first, second, later)."""
    size = F.length("value")
    chars = candidates.where("field_name = 'name_raw' AND value <> ''").select("value", "n_cells", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    chars = chars.select("value", "n_cells", F.least("i", F.lit(3)).alias("place"), F.expr("substring(value, i, 1)").alias("char"))
    counted = chars.groupBy("place", "char").agg(F.sum("n_cells").alias("n"))
    return chars.join(counted, ["place", "char"]).groupBy("value").agg(F.min(F.log1p("n")).alias("rarest"))


def priors(votes: DataFrame) -> DataFrame:
    """``(cell_id, field_name, value, prior)`` of every candidate."""
    own = votes.select("cell_id", "field_name", "value").distinct()
    frequent = own.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n_cells"))
    rarest = _rarest(frequent)
    worth = frequent.join(rarest, "value", "left").select(
        "field_name",
        "value",
        (
            F.when(F.col("value").rlike(UNREADABLE), MARKED).otherwise(0.0)
            + F.when(F.col("field_name") == "commissioning_date", DATE_PRIOR * F.log1p("n_cells")).otherwise(0.0)
            + F.when(F.col("field_name") == "name_raw", CHAR_PRIOR * F.coalesce("rarest", F.lit(0.0))).otherwise(0.0)
        ).alias("worth"),
    )
    size = F.length("value")
    heads = own.where((size > 1) & (F.col("field_name") != "commissioning_date")).select("cell_id", "field_name", F.explode(F.sequence(F.lit(1), size - 1)).alias("i"), "value")
    heads = heads.select("cell_id", "field_name", F.expr("substring(value, 1, i)").alias("value")).distinct().withColumn("cut", F.lit(CUT))
    out = own.join(worth, ["field_name", "value"]).join(heads, ["cell_id", "field_name", "value"], "left")
    return out.select("cell_id", "field_name", "value", (F.col("worth") + F.coalesce("cut", F.lit(0.0))).alias("prior"))


def _weight(accuracy: Column) -> Column:
    a = F.least(F.greatest(accuracy, F.lit(0.05)), F.lit(0.995))
    return F.log(a / (1 - a)) + PARTICULAR_ERROR


def weighed(votes: DataFrame, accuracy: DataFrame | None) -> DataFrame:
    """Votes with their annotator's accuracy so far and the weight it gives."""
    if accuracy is None:
        return votes.withColumn("accuracy", F.lit(None).cast("double")).withColumn("w", F.lit(1.0 + PARTICULAR_ERROR))
    known = accuracy.select(F.col("user_id").alias("reader"), "accuracy")
    return votes.join(known, F.col("user_id").eqNullSafe(F.col("reader"))).drop("reader").withColumn("w", _weight(F.col("accuracy")))


def scores(votes: DataFrame) -> DataFrame:
    """Score of every candidate: prior and weighed votes."""
    return votes.groupBy("cell_id", "field_name", "value").agg((F.sum("w") + F.max("prior")).alias("score"), F.count(F.lit(1)).alias("n"))


def best_two(scored: DataFrame) -> DataFrame:
    """The two best candidates of every cell and field."""
    order = Window.partitionBy("cell_id", "field_name").orderBy(F.desc("score"), F.desc("value"))
    top = scored.withColumn("at", F.row_number().over(order)).where("at <= 2")
    return top.groupBy("cell_id", "field_name").agg(F.max(F.when(F.col("at") == 1, F.col("value"))).alias("best"), F.max(F.when(F.col("at") == 1, F.col("score"))).alias("best_score"), F.max(F.when(F.col("at") == 2, F.col("score"))).alias("second_score"))


def leave_one_out(votes: DataFrame) -> DataFrame:
    """Every annotator's agreement with what the others say: user_id, ok, n_judged, and the
    accuracy that the votes were weighed with.

    Votes without another in their cell and field are not judged, but keep their annotator.
    """
    top = best_two(scores(votes))
    right = (F.col("value") == F.col("best")) & (F.col("best_score") - F.col("w") >= F.col("second_score"))
    unopposed = (F.col("value") == F.col("best")) & F.col("second_score").isNull()
    judged = votes.join(top, ["cell_id", "field_name"]).select("user_id", "accuracy", (F.col("voters") > 1).alias("counts"), (right | unopposed).alias("ok"))
    ok = F.sum(F.when(F.col("counts") & F.coalesce("ok", F.lit(False)), 1.0).otherwise(0.0))
    return judged.groupBy("user_id").agg(ok.alias("ok"), F.count_if("counts").alias("n_judged"), F.max("accuracy").alias("was"))


def settle(labels: DataFrame, fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """The checkpointed votes (with prior and voters) and the annotators' settled accuracy."""
    votes = votes_of(labels, fields)
    voters = votes.groupBy("cell_id", "field_name").agg(F.count(F.lit(1)).alias("voters"))
    votes = cut_lineage(votes.join(priors(votes), ["cell_id", "field_name", "value"]).join(voters, ["cell_id", "field_name"]))
    accuracy, moved, pace = None, None, 1.0
    for _ in range(ROUNDS):
        tally = cut_lineage(leave_one_out(weighed(votes, accuracy)))
        mean = tally.agg(F.sum("ok") / F.sum("n_judged")).first()[0]
        smoothed = (F.col("ok") + SMOOTHING * (0.8 if mean is None else mean)) / (F.col("n_judged") + SMOOTHING)
        stepped = F.coalesce(F.col("was") + pace * (smoothed - F.col("was")), smoothed)
        accuracy = tally.select("user_id", stepped.alias("accuracy"), "n_judged", "was")
        readers, known, farthest = accuracy.agg(F.count(F.lit(1)), F.count("was"), F.max(F.abs(F.col("accuracy") - F.col("was")))).first()
        if readers == 0 or known and farthest < STILL:
            return votes, accuracy.drop("was")
        if moved is not None and known and farthest >= moved:
            pace /= 2  # two answers in turn: go half the way
        moved = farthest if known else None
    raise ArithmeticError(f"the annotators' accuracies have not settled in {ROUNDS} rounds")


def consensus(labels: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(cell_id, field_name, consensus, n_labels, agreement, margin)`` of every cell and field."""
    votes, accuracy = settle(labels, fields)
    scored = cut_lineage(scores(weighed(votes, accuracy)))
    top = best_two(scored)
    n = F.sum("n")
    pairs = scored.groupBy("cell_id", "field_name").agg(n.alias("n_labels"), F.when(n > 1, F.sum(F.col("n") * (F.col("n") - 1)) / (n * (n - 1))).alias("agreement"))
    every = labels.select("cell_id").where("cell_id IS NOT NULL").distinct().select("cell_id", F.explode(F.array(*map(F.lit, fields))).alias("field_name"))
    out = every.join(top, ["cell_id", "field_name"], "left").join(pairs, ["cell_id", "field_name"], "left")
    return out.select("cell_id", "field_name", F.col("best").alias("consensus"), F.coalesce("n_labels", F.lit(0)).alias("n_labels"), "agreement", (F.col("best_score") - F.col("second_score")).alias("margin"))


def annotators(labels: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(user_id, accuracy, n_judged)`` once the rounds have settled."""
    return settle(labels, fields)[1]


def krippendorff(labels: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(field_name, n_labels, alpha)``: nominal alpha over units with two labels or more."""
    counts = votes_of(labels, fields).groupBy("field_name", "cell_id", "value").agg(F.count(F.lit(1)).alias("n"))
    units = counts.groupBy("field_name", "cell_id").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).where("m > 1")
    observed = units.groupBy("field_name").agg(F.sum("m").alias("n_labels"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("apart"))
    totals = counts.join(units.select("field_name", "cell_id"), ["field_name", "cell_id"], "left_semi").groupBy("field_name", "value").agg(F.sum("n").alias("n")).groupBy("field_name").agg(F.sum(F.col("n") * F.col("n")).alias("sq"))
    total = F.col("n_labels")
    expected = (total * total - F.col("sq")) / (total - 1)
    return observed.join(totals, "field_name").select("field_name", "n_labels", F.when(expected > 0, 1 - F.col("apart") / expected).otherwise(1.0).alias("alpha"))
