"""Evaluation metrics, class weights, splits, samples, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import draw, rank_by_parts

#: Bits of a 32-bit draw below those that say which rows are put in order together.
LOW_BITS = 20


def _hashed_order(items: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Adds h_, k_ and n_: a row's draw, its place in its label by (draw, key), and the label's rows."""
    drawn = items.withColumn("h_", draw(F.lit(str(seed)), F.col(key).cast("string")))
    return rank_by_parts(drawn, [label], F.shiftright("h_", LOW_BITS), ["h_", key])


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """(y_true, y_pred, n, share) over the union of labels; share is of the true label's row (0 where it has none)."""
    labels = pred.select(F.explode(F.array("y_true", "y_pred")).alias("y")).distinct()
    held = labels.agg(F.collect_set("y").alias("all"))  # classes, of which there are few
    cells = held.select(F.explode("all").alias("y_true"), "all").select("y_true", F.explode("all").alias("y_pred"))
    n = pred.groupBy("y_true", "y_pred").count()
    out = cells.join(n, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("count", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("y_true"))
    return out.withColumn("share", F.col("n") / F.greatest(total, F.lit(1)))


def classification_report(pred: DataFrame) -> DataFrame:
    """Per label: support, n_pred, precision, recall, f1; divisions by zero give 0."""
    per = pred.groupBy("y_true", "y_pred").count()
    side = F.array(F.struct(F.col("y_true").alias("label"), F.col("count").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("count").alias("p")))
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("count")).otherwise(0)
    flat = per.select(F.explode(side).alias("s"), hit.alias("hit"))
    out = flat.groupBy(F.col("s.label").alias("label")).agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("n_pred"), (F.sum("hit") / 2).alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumn("precision", ratio(F.col("hit"), F.col("n_pred"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("label", "support", "n_pred", "precision", "recall", f1.alias("f1"))


def report_averages(pred: DataFrame) -> DataFrame:
    """The average rows of the report: (average, precision, recall, f1, support), over classes alike (macro) and by support (weighted)."""
    per = classification_report(pred)
    names = ("precision", "recall", "f1")
    plain = per.agg(F.lit("macro").alias("average"), *(F.avg(c).alias(c) for c in names), F.sum("support").alias("support"))
    weighed = per.agg(F.lit("weighted").alias("average"), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names), F.sum("support").alias("support"))
    return plain.unionByName(weighed)


def eval_metrics(pred: DataFrame) -> DataFrame:
    """One row: n, accuracy, f1_weighted, f1_macro, balanced_accuracy (mean recall of the classes that y_true has)."""
    per = classification_report(pred)
    return per.agg(
        F.sum("support").alias("n"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"), F.avg("f1").alias("f1_macro"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def class_weights(spark: SparkSession, labelled: DataFrame, n_classes: int, mode: str = "sqrt") -> DataFrame:
    """(label_id, n, weight) of each class: total / (classes * n), its root unless mode is balanced; absent classes 0."""
    n = labelled.groupBy("label_id").count()
    weight = F.coalesce(F.try_divide(F.sum("n").over(Window.partitionBy()), F.lit(n_classes) * F.col("n")), F.lit(0.0))  # a row for each class
    out = spark.range(n_classes).select(F.col("id").cast("int").alias("label_id")).join(n, "label_id", "left")
    out = out.select("label_id", F.coalesce("count", F.lit(0)).alias("n"))
    return out.withColumn("weight", weight if mode == "balanced" else F.sqrt(weight))


def filter_remap(labelled: DataFrame, excluded_ids: list[int]) -> DataFrame:
    """Rows of other labels, with new_id: their ids made dense from 0."""
    kept = labelled.filter(~F.col("label_id").isin(excluded_ids))
    ids = kept.select("label_id").distinct().withColumn("new_id", F.row_number().over(Window.orderBy("label_id")) - 1)  # a row for each class
    return kept.join(F.broadcast(ids), "label_id")


def slide_split(slides: DataFrame, seed: int = config.SEED) -> DataFrame:
    """(wsi_id, split): a sixth of the slides (one at least) are test, as many val, the rest train, in hashed order."""
    w = Window.orderBy(draw(F.lit(str(seed)), F.col("wsi_id").cast("string")), "wsi_id")
    ranked = slides.select("wsi_id", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
    part = F.greatest(F.lit(1), F.expr("n div 6"))
    return ranked.select("wsi_id", F.when(F.col("k") <= part, "test").when(F.col("k") <= 2 * part, "val").otherwise("train").alias("split"))


def stratified_split(items: DataFrame, key: str, label: str, train: float = 0.70, val: float = 0.15, seed: int = config.SEED) -> DataFrame:
    """Adds split: of each label the first items by hash are test, the next val; shares are rounded half to even."""
    out = _hashed_order(items, key, label, seed)
    test, upto = F.bround(F.col("n_") * F.lit(1 - train - val)), F.bround(F.col("n_") * F.lit(1 - train))
    return out.withColumn("split", F.when(F.col("k_") <= test, "test").when(F.col("k_") <= upto, "val").otherwise("train")).drop("h_", "k_", "n_")


def stratified_sample(items: DataFrame, key: str, label: str, most: int, seed: int = config.SEED) -> DataFrame:
    """At most so many rows of each label, in hashed order."""
    return _hashed_order(items, key, label, seed).filter(F.col("k_") <= most).drop("h_", "k_", "n_")


def overfit_subset(items: DataFrame, key: str, label: str, size: int, seed: int = config.SEED) -> DataFrame:
    """So many rows: an equal share of each label first, then others, in hashed order."""
    share = max(1, size // max(1, items.select(label).distinct().count()))
    ranked = _hashed_order(items, key, label, seed).withColumn("more_", F.col("k_") > share)
    return ranked.orderBy("more_", "h_", key).limit(size).drop("h_", "k_", "n_", "more_")


def early_stopping(history: DataFrame, patience: int = 5, runs: tuple[str, ...] = ()) -> DataFrame:
    """Adds best, improved and bad (epochs since) to (epoch, va_f1m) of each run, up to the epoch that stops it."""
    run = Window.partitionBy(*runs)  # a row for each epoch
    order = run.orderBy("epoch")
    best = F.coalesce(F.max("va_f1m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0))
    h = history.withColumn("improved", F.col("va_f1m") > best)
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    h = h.withColumn("bad", F.col("epoch") - F.coalesce(last, F.lit(0)))
    stop = F.min(F.when(F.col("bad") >= patience, F.col("epoch"))).over(run)
    return h.withColumn("stop_", stop).filter(F.col("stop_").isNull() | (F.col("epoch") <= F.col("stop_"))).drop("stop_")


def cosine_schedule(spark: SparkSession, epochs: int, lr: float = 2e-4, least: float = 1e-6, period: int | None = None, growth: int = 1) -> DataFrame:
    """(epoch, lr) of a cosine fall from lr to least; with a period it starts anew after so many epochs, and each next
    period is `growth` times as long."""
    place, width = F.col("epoch") - 1, F.lit(epochs)
    if period is not None:
        starts, n = [0], period
        while starts[-1] + n < epochs:
            starts.append(starts[-1] + n)
            n *= growth
        begun = [(a, b) for a, b in zip(starts, [*starts[1:], starts[-1] + n], strict=True)]
        width = F.coalesce(*(F.when(place < b, F.lit(b - a)) for a, b in begun))
        place = place - F.coalesce(*(F.when(place < b, F.lit(a)) for a, b in begun))
    fall = (1 + F.cos(F.lit(3.141592653589793) * (place / width))) / 2
    return spark.range(1, epochs + 1).select(F.col("id").alias("epoch")).withColumn("lr", F.lit(least) + (F.lit(lr) - F.lit(least)) * fall)


def cosine_rates(history: DataFrame, lr: float = 2e-4, least: float = 1e-6, period: int | None = None, growth: int = 1, runs: tuple[str, ...] = ()) -> DataFrame:
    """Adds lr to (epoch, ...) of each run, as cosine_schedule gives it for as many epochs as the run has."""
    place = F.col("epoch") - 1
    if period is None:
        width = F.count("*").over(Window.partitionBy(*runs))  # a row for each epoch
    else:
        begins, widths = [0], [period]
        while begins[-1] < 1 << 31 and len(begins) < (1 << 10 if growth > 1 else 1):
            begins.append(begins[-1] + widths[-1])
            widths.append(widths[-1] * growth)
        if growth > 1:
            k = F.size(F.filter(F.array(*map(F.lit, begins)), lambda b: b <= place)) - 1
            width = F.get(F.array(*map(F.lit, widths)), k)
            place = place - F.get(F.array(*map(F.lit, begins)), k)
        else:
            width, place = F.lit(period), place % period
    fall = (1 + F.cos(F.lit(3.141592653589793) * (place / width))) / 2
    return history.withColumn("lr", F.lit(least) + (F.lit(lr) - F.lit(least)) * fall)


#: What counts as better for the plateau schedule: a loss below this share of the best one.
PLATEAU_SHARE = 1 - 1e-4


def plateau_schedule(history: DataFrame, lr: float = 2e-4, patience: int = 3, factor: float = 0.5, runs: tuple[str, ...] = ()) -> DataFrame:
    """Adds lr to (epoch, loss) of each run: the rate in an epoch falls by factor once more than `patience` epochs before
    it did not better the least loss; the count then starts anew."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(float(lr)).alias("lr"), F.array().cast("array<struct<epoch: bigint, loss: double, lr: double>>").alias("out"))

    def step(acc, e):
        better = e["loss"] < acc["best"] * PLATEAU_SHARE
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        down = bad > patience
        row = F.struct(e["epoch"].alias("epoch"), e["loss"].alias("loss"), acc["lr"].alias("lr"))
        return F.struct(F.when(better, e["loss"]).otherwise(acc["best"]).alias("best"), F.when(down, 0).otherwise(bad).alias("bad"), F.when(down, acc["lr"] * factor).otherwise(acc["lr"]).alias("lr"), F.concat(acc["out"], F.array(row)).alias("out"))

    epochs = history.groupBy(*runs).agg(F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("long").alias("epoch"), F.col("loss").cast("double").alias("loss")))).alias("es"))  # epochs of one run
    out = epochs.select(*runs, F.explode(F.aggregate("es", start, step)["out"]).alias("e"))
    return out.select(*runs, "e.epoch", "e.loss", "e.lr")


def schedule(spark: SparkSession, name: str | None, epochs: int, lr: float = 2e-4, least: float = 1e-6, history: DataFrame | None = None, **more: object) -> DataFrame:
    """(epoch, lr) by the name of a schedule: cosine, plateau (needs a history with losses), cosine_restart, or none."""
    if not name or name == "none":
        return spark.range(1, epochs + 1).select(F.col("id").alias("epoch"), F.lit(float(lr)).alias("lr"))
    if name == "cosine":
        return cosine_schedule(spark, epochs, lr, least)
    if name == "cosine_restart":
        return cosine_schedule(spark, epochs, lr, least, period=more.get("period", 10), growth=more.get("growth", 1))
    if name == "plateau" and history is not None:
        return plateau_schedule(history, lr, **more).select("epoch", "lr")
    raise ValueError(f"unknown schedule {name!r}, or plateau without a history")


def two_phases(rates: DataFrame, frozen: int, factor: float = 0.1) -> DataFrame:
    """Adds phase to (epoch, lr): 1 while the encoder is frozen, then 2, where rates are so many times as high."""
    second = (F.lit(frozen) > 0) & (F.col("epoch") > frozen)
    return rates.withColumn("phase", F.when(second | (F.lit(frozen) == 0), 2).otherwise(1)).withColumn("lr", F.when(second, F.col("lr") * factor).otherwise(F.col("lr")))


def softmax(x: Column) -> Column:
    e = _let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
    return _let(e, lambda y: _let(F.aggregate(y, F.lit(0.0), lambda a, v: a + v), lambda t: F.transform(y, lambda v: v / t)))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


def norm_statistics(vectors: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, least, most and (population) deviation of the L2 norms, and the share of vectors of zeros alone."""
    each = vectors.select(norm(F.col(column)).alias("x"), (~F.exists(column, lambda v: v != 0)).alias("zero"))
    return each.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"), F.stddev_pop("x").alias("deviation"), F.avg(F.col("zero").cast("double")).alias("zero_share"))


def require_known(spark: SparkSession, wanted: list[str], known: DataFrame, column: str) -> list[str]:
    """The wanted values, each once and in order; one that the column does not have is an error."""
    asked = spark.createDataFrame([(w,) for w in wanted], f"{column} string")
    missing = [r[0] for r in asked.join(known.select(column).distinct(), column, "left_anti").collect()]  # of the wanted ones
    if missing:
        raise ValueError(f"no such {column}: {sorted(missing)}")
    return list(dict.fromkeys(wanted))


def resolve_classes(spark: SparkSession, labelled: DataFrame, wanted: list[str] | int = 3, excluded: tuple[str, ...] = config.EXCLUDED) -> list[str]:
    """The wanted classes if all are there, else an error; for a number, so many of the most frequent ones."""
    if not isinstance(wanted, int):
        return require_known(spark, wanted, labelled, "label")
    n = labelled.filter(~F.col("label").isin(*excluded)).groupBy("label").agg(F.count("*").alias("n"))
    return [r.label for r in n.orderBy(F.col("n").desc(), "label").limit(wanted).collect()]


def _let(value: Column, f) -> Column:
    """f(value), with value worked out once a row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + eps)."""
    total = lambda y: F.aggregate(y, F.lit(0.0), lambda a, v: a + v)
    centred = lambda y: _let(total(y) / F.size(y), lambda m: F.transform(y, lambda v: v - m))
    scaled = lambda z: _let(F.sqrt(total(F.transform(z, lambda v: v * v)) / F.size(z) + eps), lambda s: F.transform(z, lambda v: v / s))
    return _let(F.transform(x, lambda v: v.cast("double")), lambda y: _let(centred(y), scaled))


def probe_verdict(bacc: Column, n_classes: Column) -> Column:
    return F.when(bacc < 1.5 / n_classes, "fail").when(bacc > 0.45, "separable").otherwise("intermediate")
