"""Aggregate and score builders for pixel metrics and losses.

``confusion`` and the loss builders are aggregate expressions for one ``agg``; the score
functions turn the four counts into one number, so a whole metric set costs one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlake.functions.bands import activate

# Smoothing terms of the scores.
SMOOTH = 1e-6
TINY = 1e-8
ROOT = 1e-10


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def confusion(pred: Column, truth: Column, buffer: Column | None = None) -> list[Column]:
    """tp, fp, fn, tn over boolean columns; pixels outside the buffer become false in both."""
    if buffer is not None:
        pred, truth = pred & buffer, truth & buffer
    return [
        F.sum(_flag(pred & truth)).alias("tp"),
        F.sum(_flag(pred & ~truth)).alias("fp"),
        F.sum(_flag(~pred & truth)).alias("fn"),
        F.sum(_flag(~pred & ~truth)).alias("tn"),
    ]


def _cols() -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))


def iou_score() -> Column:
    tp, fp, fn, _ = _cols()
    union = tp + fp + fn
    return F.when(union == 0, F.lit(0.0)).otherwise((tp + SMOOTH) / (union + SMOOTH))


def f_score(beta: float = 1.0) -> Column:
    tp, fp, fn, _ = _cols()
    b2 = float(beta) ** 2
    return ((1 + b2) * tp + SMOOTH) / ((1 + b2) * tp + b2 * fn + fp + SMOOTH)


def masked_iou() -> Column:
    tp, fp, fn, _ = _cols()
    union = tp + fp + fn
    return F.when(union < TINY, F.lit(0.0)).otherwise(tp / union)


def masked_f1() -> Column:
    tp, fp, fn, _ = _cols()
    precision, recall = tp / (tp + fp + TINY), tp / (tp + fn + TINY)
    return 2 * (precision * recall) / (precision + recall + TINY)


def _ratio(top: Column, bottom: Column, empty: float) -> Column:
    return F.when(bottom == 0, F.lit(empty)).otherwise(top / bottom)


def mean_iou() -> Column:
    tp, fp, fn, tn = _cols()
    return (_ratio(tp, tp + fp + fn, 1.0) + _ratio(tn, tn + fp + fn, 1.0)) / 2.0


def balanced_iou() -> Column:
    tp, fp, fn, tn = _cols()
    share = (tp + fn) / (tp + fp + fn + tn)
    return share * (tp / (tp + fp + fn + ROOT)) + (1.0 - share) * (tn / (tn + fp + fn + ROOT))


def dice() -> Column:
    tp, fp, fn, _ = _cols()
    return _ratio(2 * tp, 2 * tp + fp + fn, 0.0)


def adjusted_dice() -> Column:
    tp, fp, fn, _ = _cols()
    return _ratio(2 * tp, 2 * tp + fp + fn, 1.0)


def mcc() -> Column:
    tp, fp, fn, tn = _cols()
    return (tp * tn - fp * fn) / F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) + ROOT)


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Zero where a denominator is zero."""
    tp, fp, fn = tp.cast("double"), fp.cast("double"), fn.cast("double")
    precision, recall = _ratio(tp, tp + fp, 0.0), _ratio(tp, tp + fn, 0.0)
    return precision, recall, _ratio(2 * precision * recall, precision + recall, 0.0)


def masked_mse(pred: Column, truth: Column, mask: Column) -> Column:
    return F.sum((pred - truth) * (pred - truth) * mask) / (F.sum(mask) + TINY)


def mse(logit: Column, truth: Column, activation: str = "sigmoid") -> Column:
    pred = activate(logit, activation)
    return F.avg((pred - truth) * (pred - truth))


def bce(logit: Column, truth: Column) -> Column:
    """Stable log-loss of one pixel."""
    return F.greatest(logit, F.lit(0.0)) - logit * truth + F.log1p(F.exp(-F.abs(logit)))


def bce_loss(logit: Column, truth: Column, weight: Column | None = None) -> Column:
    return F.avg((F.lit(1.0) if weight is None else weight) * bce(logit, truth))


def class_weight(truth: Column, weights: Sequence[float] | None) -> Column:
    """Weights are [background, foreground]; truth above one half is foreground."""
    if weights is None:
        return F.lit(1.0)
    if len(weights) != 2:
        raise ValueError("class weights are [background, foreground]")
    return F.when(truth > 0.5, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))


def dice_loss(logit: Column, truth: Column, smooth: float = 1.0, activation: str = "sigmoid", weight: Column | None = None) -> Column:
    pred = activate(logit, activation)
    w = F.lit(1.0) if weight is None else weight
    top = 2.0 * F.sum(pred * truth * w) + smooth
    return 1.0 - top / (F.sum(pred * w) + F.sum(truth * w) + smooth)


def weighted_dice_loss(logit: Column, truth: Column, buffer: Column | None = None, weights: Sequence[float] | None = None,
                       smooth: float = TINY, activation: str = "sigmoid") -> Column:
    if buffer is not None:
        logit, truth = logit * buffer, truth * buffer
    w = None if weights is None else truth * float(weights[1]) + (1 - truth) * float(weights[0])
    return dice_loss(logit, truth, smooth, activation, w)


def focal_loss(logit: Column, truth: Column, alpha: float = 0.25, gamma: float = 2.0, weight: Column | None = None,
               buffer: Column | None = None, smooth: float = TINY) -> Column:
    """Mean over pixels, or over valid pixels when a buffer is given."""
    loss = bce(logit, truth)
    value = alpha * F.pow(1 - F.exp(-loss), F.lit(gamma)) * loss * (F.lit(1.0) if weight is None else weight)
    return F.avg(value) if buffer is None else F.sum(value * buffer) / (F.sum(buffer) + smooth)


def hybrid_loss(logit: Column, truth: Column, buffer: Column | None = None, weights: Sequence[float] | None = None,
                dice_weight: float = 0.5, alpha: float = 0.25, gamma: float = 2.0, activation: str = "sigmoid") -> Column:
    """Dice, focal and log-loss together; logits and truth are masked first, the log-loss mean keeps masked pixels."""
    if buffer is not None:
        logit, truth = logit * buffer, truth * buffer
    w = class_weight(truth, weights)
    if buffer is not None:
        w = w * buffer
    return (
        dice_weight * dice_loss(logit, truth, TINY, activation, w)
        + (1 - dice_weight) * focal_loss(logit, truth, alpha, gamma, w, buffer)
        + bce_loss(logit, truth, w)
    )


def loss_by_name(name: str, logit: Column, truth: Column, buffer: Column, weights: Sequence[float] | None = None,
                 threshold: float = 0.5) -> list[Column]:
    """Loss and the metric counts that go with it, for one ``agg``."""
    losses = {
        "hybrid": lambda: hybrid_loss(logit, truth, buffer, weights),
        "mse": lambda: masked_mse(activate(logit), truth, buffer),
        "weighted_dice_loss": lambda: weighted_dice_loss(logit, truth, buffer, weights),
    }
    if name not in losses:
        raise ValueError(f"unknown loss {name!r}")
    counts = confusion(activate(logit) > threshold, truth > threshold, buffer > 0)
    return [losses[name]().alias("loss"), *counts]


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution as Acklam's published rational form for the central and upper region."""
    # Coefficients of the rational approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def horner(coeffs, x):
        acc = F.lit(coeffs[0])
        for k in coeffs[1:]:
            acc = acc * x + F.lit(k)
        return acc

    q = p - 0.5
    r = q * q
    central = horner(a, r) * q / (horner(b, r) * r + 1.0)
    lower_q, upper_q = F.sqrt(-2.0 * F.log(p)), F.sqrt(-2.0 * F.log(1.0 - p))
    lower = horner(c, lower_q) / (horner(d, lower_q) * lower_q + 1.0)
    upper = -horner(c, upper_q) / (horner(d, upper_q) * upper_q + 1.0)
    return F.when(p < 0.02425, lower).when(p > 1 - 0.02425, upper).otherwise(central)
