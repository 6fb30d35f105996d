"""Pixel metrics, losses and summary statistics."""

from pyspark.sql import functions as F

from arborlake.functions import scores as S
from arborlake.functions.bands import activate
from arborlake.operators import metrics
from catalog.fixtures import fx, scores
from catalog.registry import query

_T = 4  # percent above which a pixel of the sparse table is foreground

_COUNT = f"""
    c as (select image_id, count(*) filter (pred_pct > {_T} and truth_pct > {_T}) as tp,
                 count(*) filter (pred_pct > {_T} and truth_pct <= {_T}) as fp,
                 count(*) filter (pred_pct <= {_T} and truth_pct > {_T}) as fn,
                 count(*) filter (pred_pct <= {_T} and truth_pct <= {_T}) as tn from fx_pixels group by 1),
    m as (select image_id, count(*) filter (pred_pct > {_T} and truth_pct > {_T} and buffer_mask = 1) as tp,
                 count(*) filter (pred_pct > {_T} and truth_pct <= {_T} and buffer_mask = 1) as fp,
                 count(*) filter (pred_pct <= {_T} and truth_pct > {_T} and buffer_mask = 1) as fn from fx_pixels group by 1)"""


def _counts(spark, sf, masked=False):
    px = fx(spark, sf, "fx_pixels")
    buffer = F.col("buffer_mask") == 1 if masked else None
    return metrics.confusion(px, F.col("pred_pct") > _T, F.col("truth_pct") > _T, ["image_id"], buffer)


@query("confusion", f"with {_COUNT} select image_id, tp, fp, fn, tn from c")
def confusion(spark, sf):
    return _counts(spark, sf)


def _score(name, sql, column, masked=False):
    source = "m" if masked else "c"

    @query(name, f"with {_COUNT} select image_id, round({sql}, 6) as score from {source}")
    def run(spark, sf):
        return _counts(spark, sf, masked).select("image_id", F.round(column(), 6).alias("score"))

    return run


_score("iou_score", "case when tp + fp + fn = 0 then 0 else (tp + 1e-6) / (tp + fp + fn + 1e-6) end", S.iou_score)
_score("f_score_1", "(2 * tp + 1e-6) / (2 * tp + fn + fp + 1e-6)", S.f_score)
_score("f_score_2", "(5 * tp + 1e-6) / (5 * tp + 4 * fn + fp + 1e-6)", lambda: S.f_score(2.0))
_score("masked_iou", "case when tp + fp + fn < 1e-8 then 0 else tp / (tp + fp + fn) end", S.masked_iou, True)
_score("masked_f1", "2 * (tp / (tp + fp + 1e-8) * (tp / (tp + fn + 1e-8))) / (tp / (tp + fp + 1e-8) + tp / (tp + fn + 1e-8) + 1e-8)", S.masked_f1, True)
_score("mean_iou", "(case when tp + fp + fn = 0 then 1 else tp / (tp + fp + fn) end + case when tn + fp + fn = 0 then 1 else tn / (tn + fp + fn) end) / 2", S.mean_iou)
_score("balanced_iou", """(tp + fn) / (tp + fp + fn + tn) * (tp / (tp + fp + fn + 1e-10))
       + (1 - (tp + fn) / (tp + fp + fn + tn)) * (tn / (tn + fp + fn + 1e-10))""", S.balanced_iou)
_score("dice", "case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end", S.dice)
_score("adjusted_dice", "case when 2 * tp + fp + fn = 0 then 1 else 2 * tp / (2 * tp + fp + fn) end", S.adjusted_dice)
_score("mcc", "(tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn) + 1e-10)", S.mcc)


@query("masked_mse", """
    select image_id, round(sum(power(1 / (1 + exp(-logit)) - truth, 2) * buffer) / (sum(buffer) + 1e-8), 6) as masked_mse,
           round(avg(power(1 / (1 + exp(-logit)) - truth, 2)), 6) as mse from fx_scores group by 1""")
def masked_mse(spark, sf):
    pred = activate(F.col("logit"))
    return scores(spark, sf).groupBy("image_id").agg(
        F.round(S.masked_mse(pred, F.col("truth"), F.col("buffer")), 6).alias("masked_mse"),
        F.round(S.mse(F.col("logit"), F.col("truth")), 6).alias("mse"),
    )


_SIG = "(1 / (1 + exp(-z)))"
_BCE = "(greatest(z, 0) - z * t + ln(1 + exp(-abs(z))))"


def _loss(name, sql, column):
    @query(name, f"""
        select image_id, round({sql}, 6) as loss
        from (select image_id, logit as z, truth as t, logit * buffer as zb, truth * buffer as tb, buffer as b from fx_scores) group by 1""")
    def run(spark, sf):
        z, t, b = F.col("logit"), F.col("truth"), F.col("buffer")
        return scores(spark, sf).groupBy("image_id").agg(F.round(column(z, t, b), 6).alias("loss"))

    return run


_BZ = "(1 / (1 + exp(-zb)))"
_BB = "(greatest(zb, 0) - zb * tb + ln(1 + exp(-abs(zb))))"
_loss("dice_loss", f"1 - (2 * sum({_SIG} * t) + 1) / (sum({_SIG}) + sum(t) + 1)", lambda z, t, b: S.dice_loss(z, t))
_loss("weighted_dice_loss",
      f"1 - (2 * sum({_BZ} * tb * (tb * 3 + (1 - tb))) + 1e-8) / (sum({_BZ} * (tb * 3 + (1 - tb))) + sum(tb * (tb * 3 + (1 - tb))) + 1e-8)",
      lambda z, t, b: S.weighted_dice_loss(z, t, b, [1.0, 3.0]))
_loss("bce_loss", f"avg({_BCE} * (case when t > 0.5 then 2 else 0.5 end))", lambda z, t, b: S.bce_loss(z, t, S.class_weight(t, [0.5, 2.0])))
_loss("focal_loss", f"avg(0.25 * power(1 - exp(-{_BCE}), 2) * {_BCE})", lambda z, t, b: S.focal_loss(z, t))
_loss("focal_loss_valid", f"sum(0.25 * power(1 - exp(-{_BCE}), 2) * {_BCE} * b) / (sum(b) + 1e-8)",
      lambda z, t, b: S.focal_loss(z, t, buffer=b))
_loss("hybrid_loss", f"""
      0.5 * (1 - (2 * sum({_BZ} * tb * b) + 1e-8) / (sum({_BZ} * b) + sum(tb * b) + 1e-8))
      + 0.5 * sum(0.25 * power(1 - exp(-{_BB}), 2) * {_BB} * b * b) / (sum(b) + 1e-8) + avg({_BB} * b)""",
      lambda z, t, b: S.hybrid_loss(z, t, b))


@query("loss_by_name", f"""
    select image_id, round(1 - (2 * sum({_BZ} * tb) + 1e-8) / (sum({_BZ}) + sum(tb) + 1e-8), 6) as loss,
           count(*) filter (z > 0 and t = 1 and b = 1) as tp, count(*) filter (z > 0 and t = 0 and b = 1) as fp,
           count(*) filter (z <= 0 and t = 1 and b = 1) as fn, count(*) filter (b = 0 or (z <= 0 and t = 0)) as tn
    from (select image_id, logit as z, truth as t, logit * buffer as zb, truth * buffer as tb, buffer as b from fx_scores) group by 1""")
def loss_by_name(spark, sf):
    built = S.loss_by_name("weighted_dice_loss", F.col("logit"), F.col("truth"), F.col("buffer"))
    return scores(spark, sf).groupBy("image_id").agg(*built).withColumn("loss", F.round("loss", 6))


@query("batch_mean", f"""
    with m as (select image_id, 1 - (2 * sum((1 / (1 + exp(-logit))) * truth) + 1) / (sum(1 / (1 + exp(-logit))) + sum(truth) + 1) as loss
               from fx_scores group by 1),
    r as (select loss, row_number() over (order by md5(concat(image_id, '|batch')), image_id) - 1 as rank from m),
    b as (select floor(rank / 8) as batch, avg(loss) as loss, count(*) as n from r group by 1)
    select round(avg(loss), 6) as loss, count(*) as batches from b where n = 8""")
def batch_mean(spark, sf):
    rows = scores(spark, sf).groupBy("image_id").agg(S.dice_loss(F.col("logit"), F.col("truth")).alias("loss"))
    return metrics.batch_mean(rows, "image_id", ["loss"]).withColumn("loss", F.round("loss", 6))


@query("precision_recall_f1", f"""
    with {_COUNT} select image_id, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision,
      round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall,
      round(case when 2 * tp + fp + fn = 0 or tp = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1 from c""")
def precision_recall_f1(spark, sf):
    p, r, f = S.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return _counts(spark, sf).select("image_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


_EVAL = """
    e as (select image_id, avg(logit) as mean_logit,
                 case when image_id % 9 = 0 then null when image_id % 9 = 1 then 'nan'::double else max(logit) end as top
          from fx_scores group by 1),
    u as (select 'mean_logit' as metric, mean_logit as v from e union all select 'top', top from e where top is not null and not isnan(top))"""


def _eval(spark, sf):
    top = F.when(F.col("image_id") % 9 == 0, F.lit(None)).when(F.col("image_id") % 9 == 1, F.lit(float("nan"))).otherwise(F.col("top"))
    return scores(spark, sf).groupBy("image_id").agg(F.avg("logit").alias("mean_logit"), F.max("logit").alias("top")).withColumn("top", top)


@query("describe", f"""
    with {_EVAL} select metric, count(*) as count, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(min(v), 6) as min,
      round(quantile_cont(v, 0.25), 6) as q25, round(quantile_cont(v, 0.5), 6) as q50, round(quantile_cont(v, 0.75), 6) as q75,
      round(max(v), 6) as max from u group by 1""")
def describe(spark, sf):
    rows = metrics.describe(_eval(spark, sf), ["mean_logit", "top"])
    return rows.select("metric", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("confidence_interval", f"""
    with {_EVAL} select metric, round(avg(v) - 1.959963984540054 * stddev_samp(v) / sqrt(count(*)), 6) as low,
      round(avg(v) + 1.959963984540054 * stddev_samp(v) / sqrt(count(*)), 6) as high from u group by 1""")
def confidence_interval(spark, sf):
    rows = metrics.confidence_interval(_eval(spark, sf), ["mean_logit", "top"])
    return rows.select("metric", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("totals", f"with {_COUNT} select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from c")
def totals(spark, sf):
    return metrics.totals(_counts(spark, sf))


@query("count_weighted_iou", f"""
    with {_COUNT} select round(sum(tp / (tp + fp + fn) * (tp + fp)) / sum(tp + fp), 6) as pixel_iou,
      round(sum(tp / (tp + fn) * (tp + fn)) / sum(tp + fn), 6) as tree_iou from c""")
def count_weighted_iou(spark, sf):
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = _counts(spark, sf).select(
        (tp / (tp + fp + fn)).alias("pixel_iou"), (tp + fp).alias("n_pred"), (tp / (tp + fn)).alias("tree_iou"), (tp + fn).alias("n_truth"))
    out = metrics.count_weighted_iou(rows)
    return out.select(F.round("pixel_iou", 6).alias("pixel_iou"), F.round("tree_iou", 6).alias("tree_iou"))
