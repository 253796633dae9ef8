"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate, the words that the mix takes of it over its size. Of all rates between 0
and 3 that meet the token constraint of each source, the least change from "every document once" in
relative entropy is wanted. The solution is an exponential tilt, rate = min(3, exp(lambda * size /
mean size)) with one multiplier for each source, and the multipliers solve the convex dual. Newton
steps, guarded by a bracket, find them for all sources at once; each step is one aggregate over the
counted sizes. The rates are then rounded into whole copies: a hash draws between the two neighbours
of a rate, and a common shift of the draws within each source, found in two histograms, brings the
source's taken words next to its target.

Defined results: null text has size 0, takes 0 and has rate 1; a null source is a source of its own and
comes last; equal rows are treated alike; sources whose size is 0 have target 0; an empty table gives
an empty table; reruns agree, since draws are hashes of identifier and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Saved, pick

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size): shares by weight, no target above
    `most` times its source, what is over shared again by weight.

    Such targets are min(most * size, c * weight) for one c. In the order of most * size / weight the
    capped sources come first, so c follows from running sums. One row a source: a plain window.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(named) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double")
    rows = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_first())
    everything = Window.partitionBy(F.lit(1))
    rows = rows.withColumns({
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open_w": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(everything),
    })
    rows = rows.withColumn("c", (F.col("total") - F.col("before")) / F.col("open_w"))
    # the first source that isn't capped at its own c fixes the level
    fits = F.col("c") * F.col("w") <= F.col("cap")
    rows = rows.withColumn("level", F.min(F.when(fits, F.struct(F.col("cap") / F.col("w"), "c"))).over(everything)["c"])
    share = F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap"))
    return rows.select("source", "source_size", share.alias("target"))


def _rate(multiplier: str, x: str, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.col(multiplier) * F.col(x), F.lit(50.0))))


def solve(spark: SparkSession, counted: DataFrame, goal: DataFrame, saved: Saved, most: int = MOST, most_steps: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """(source, target, mean, lam) from the counted sizes (source, size, n) and the targets.

    Sizes of 0 don't bear on the constraint. At the cap no finite multiplier exists; 1e4 stands for it.
    """
    sized = saved(counted.filter("size > 0").repartition("source", "size"))
    means = sized.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = saved(
        goal.filter("source_size > 0").alias("g").join(means.alias("m"), F.expr("g.source <=> m.source"))
        .select(
            "g.source", "g.source_size", "g.target", "m.mean",
            F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(1.0).alias("err"),
        )
    )
    for _ in range(most_steps):
        x = F.col("size") / F.col("mean")
        rate = _rate("lam", "x", most)
        words = F.col("size") * F.col("n")
        now = (
            sized.alias("s").join(state.alias("t"), F.expr("s.source <=> t.source"))
            .select("t.*", "s.size", "s.n").withColumn("x", x)
            .groupBy("source", "source_size", "target", "mean", "lam", "lo", "hi")
            .agg(F.sum(words * rate).alias("got"), F.sum(F.when(rate < most, words * F.col("x") * rate).otherwise(0.0)).alias("slope"))
        )
        off = F.col("got") - F.col("target")
        lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - off / F.col("slope")
        # outside the bracket, or with no slope, halve; far ends by magnitude
        middle = F.when(lo < -50, F.least(F.lit(-1.0), F.col("lam") * 4)).when(hi > 50, F.greatest(F.lit(1.0), F.col("lam") * 4)).otherwise((lo + hi) / 2)
        inside = (F.col("slope") > 0) & (step > lo) & (step < hi) & (F.abs(step - F.col("lam")) <= 2.0)
        closed = F.col("target") >= most * F.col("source_size")
        after = saved(now.select(
            "source", "source_size", "target", "mean",
            F.when(closed, 1e4).when(off == 0, F.col("lam")).when(inside, step).otherwise(middle).alias("lam"),
            lo.alias("lo"), hi.alias("hi"),
            F.when(closed, 0.0).otherwise(F.abs(off) / F.greatest(F.col("target"), F.lit(1.0))).alias("err"),
        ))
        worst = after.agg(F.max("err")).first()[0]
        saved.drop(state)
        state = after
        if worst is None or worst < tolerance:
            break
    saved.drop(sized)
    return state.select("source", "target", "mean", "lam")


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """rows (size, draw, mean, lam) with rate, low and key: one copy more than low where key lies below
    the source's shift; a shift of 0 leaves the draws as they are. first: the key's bin of -1 to 1."""
    rows = rows.withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(
        F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))))))
    rows = rows.withColumn("low", F.floor("rate").cast("int"))
    open_ = (F.col("low") < most) & (F.col("size") > 0)
    rows = rows.withColumn("key", F.when(open_, F.col("draw") - (F.col("rate") - F.col("low"))))
    return rows.withColumn("first", F.least(F.floor((F.col("key") + 1) / 2 * BINS), F.lit(BINS - 1)))


def _within() -> Column:
    """The bin of a key inside the first bin that the source's shift falls into."""
    return F.least(F.floor(((F.col("key") + 1) / 2 * BINS - F.col("bin1")) * BINS), F.lit(BINS - 1))


def parameters(rows: DataFrame, solved: DataFrame, goal: DataFrame, saved: Saved, most: int = MOST) -> DataFrame:
    """All that decides a document's copies, a row for each source: multiplier, and the shift as two bins."""
    drawn = _drawn(rows.alias("d").join(solved.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "t.target", "t.mean", "t.lam"), most)
    sure = drawn.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("low")).alias("sure"))
    b1 = saved(_find(drawn.withColumn("bin", F.col("first")), sure, "sure"))
    deep = drawn.alias("d").join(b1.alias("b"), F.expr("d.source <=> b.source")).select("d.*", F.col("b.bin").alias("bin1"))
    inner = deep.filter(F.col("first") == F.col("bin1")).withColumn("bin", _within())
    b2 = _find(inner, b1.select("source", "target", F.col("before").alias("sure")), "sure", nearest=True)
    return saved(
        goal.alias("g").join(solved.alias("t"), F.expr("g.source <=> t.source"), "left")
        .join(b1.alias("b"), F.expr("g.source <=> b.source"), "left").join(b2.alias("c"), F.expr("g.source <=> c.source"), "left")
        .select("g.source", "g.source_size", "g.target", "t.mean", "t.lam", F.col("b.bin").alias("bin1"), F.coalesce("c.bin", F.lit(0)).alias("bin2"))
    )


def copies(rows: DataFrame, parameters: DataFrame, most: int = MOST) -> DataFrame:
    """rows (source, size, draw, …) with source_size, target, rate and the whole number of copies."""
    with_them = rows.alias("d").join(parameters.alias("p"), F.expr("d.source <=> p.source")).select(
        "d.*", *(f"p.{c}" for c in parameters.columns if c != "source")
    )
    drawn = _drawn(with_them, most)
    up = (F.col("first") < F.col("bin1")) | ((F.col("first") == F.col("bin1")) & (_within() < F.col("bin2")))
    number = F.when(F.col("size") == 0, 1).otherwise(F.col("low") + F.coalesce(up, F.lit(False)).cast("int"))
    return drawn.withColumn("copies", number).drop("low", "key", "first", "mean", "lam", "bin1", "bin2")


def _find(rows: DataFrame, sure: DataFrame, start: str, nearest: bool = False) -> DataFrame:
    """(source, target, bin, before): the first bin whose words would pass the target, or, if nearest
    and the words with it lie nearer, the bin after it; before: the words taken without that bin."""
    counted = rows.filter("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("bin")
    run = counted.withColumn("upto", F.sum("words").over(order))
    run = run.alias("r").join(sure.alias("s"), F.expr("r.source <=> s.source")).select("r.*", "s.target", F.col(f"s.{start}").alias("start"))
    over = F.col("start") + F.col("upto") > F.col("target")
    found = run.groupBy("source", "target", "start").agg(
        F.min(F.when(over, F.struct("bin", (F.col("start") + F.col("upto") - F.col("words")).alias("before"), "words"))).alias("f"),
        F.max("bin").alias("last"), F.max("upto").alias("all"),
    )
    nearer = F.col("f.before") + F.col("f.words") - F.col("target") < F.col("target") - F.col("f.before")
    crossed = F.col("f.bin") + F.when(nearer, 1).otherwise(0) if nearest else F.col("f.bin")
    return found.select(
        "source", "target",
        F.coalesce(crossed, F.col("last") + 1).alias("bin"),
        F.coalesce(F.col("f.before"), F.col("start") + F.col("all")).alias("before"),
    )


def _sized(text: str, doc_id: str) -> dict[str, Column]:
    return {
        "size": word_count(F.col(text)),
        "draw": F.pmod(F.xxhash64(doc_id, text, F.lit(11)), F.lit(1 << 40)) / float(1 << 40),
    }


def _prepared(spark: SparkSession, docs: DataFrame, saved: Saved, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """The documents without their texts, and the sources' parameters."""
    rows = saved(pick(docs, "doc_id", "text", "source").withColumns(_sized("text", "doc_id")).drop("text"))
    counted = saved(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = saved(targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most))
    return rows, parameters(rows, solve(spark, counted, goal, saved, most), goal, saved, most)


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), a row for each row of docs."""
    rows, decided = _prepared(spark, docs, Saved(spark), weights, most)
    return copies(rows, decided, most).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def take(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: every row of docs as often as its copies, with the columns of docs.

    Only the sources' few parameters meet the texts, which need no shuffle.
    """
    _, decided = _prepared(spark, docs, Saved(spark), weights, most)
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text, doc_id, source = (f"c{names.index(x)}" for x in ("text", "doc_id", "source"))
    chosen = copies(plain.withColumns({**_sized(text, doc_id), "source": F.col(source)}), decided, most).filter("copies > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(f"c{i}" for i in range(len(names)))).toDF(*names)
