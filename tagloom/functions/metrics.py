"""Ratios and the quality figures that follow from confusion counts.  A ratio with nothing below is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    return F.coalesce(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(tp * 2, tp * 2 + fp + fn)


def from_counts(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> dict[str, Column]:
    """Name -> Column of everything that four counts determine."""
    a, b, c, d = F.col(tp), F.col(fp), F.col(fn), F.col(tn)
    return {
        "known_cells": a + b + c + d,
        "known_positive": a + c,
        "known_negative": d + b,
        "precision": ratio(a, a + b),
        "recall": ratio(a, a + c),
        "f1": f1(a, b, c),
        "specificity": ratio(d, d + b),
        "fpr": ratio(b, b + d),
        "accuracy": ratio(a + d, a + b + c + d),
    }
