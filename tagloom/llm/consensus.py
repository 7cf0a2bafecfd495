"""Consensus from several annotators' labels, assisted by item features.

Per item and label that somebody raised, the truth is hidden.  A regularised
logistic classifier over features of the item and the label gives the prior, the
annotators' confusion matrices (truth x answer, by label mode) the likelihood;
both are fitted in turns by expectation-maximisation over all items.  A round is
one pass over a table with a row per item that returns sums per annotator and
per feature; nothing that grows with the items reaches the driver.

Of labels that only presence is stated of, a cell exists only if somebody named
it.  Likelihoods are conditioned on that, and the fit counts the cells that the
model expects beside them, or honest people would seem to err too often.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import Scratch

#: Annotators and label x feature columns whose parameters the driver holds.
MAX_ANNOTATORS = 200_000
#: Labels, each of which has weights that the driver holds.
MAX_LABELS = 4096
#: Hash space of item features.
FEATURES = 512
#: Classes of the number of labels raised, two per octave: enough for any vocabulary.
COUNTS = 64
PRESENT, ABSENT, OPEN = 0, 1, 2


class Model(NamedTuple):
    annotators: list[str]
    #: [annotator, mode, truth, answer]
    confusion: np.ndarray
    weights: np.ndarray


class Consensus(NamedTuple):
    labels: DataFrame
    items: DataFrame
    annotators: DataFrame


def pack_answers(answers: DataFrame, item: str, annotator: str, lists: dict[str, tuple[Column, int]], features: list[Column], names: DataFrame) -> DataFrame:
    """One row per item: who answered it, what was stated, and its features.

    ``lists`` maps a list to its labels and its statement (1 present, 2 absent).
    Statements of one annotator about a label are united over all answers to the
    item, so redelivered and repeated answers count once; a label that the same
    annotator calls both present and absent is left open.
    """
    stated = lambda s: lambda i: F.struct(i.alias("label"), F.lit(s).alias("s"))
    parts = F.flatten(F.array(*[F.transform(F.coalesce(c, F.array().cast("array<int>")), stated(s)) for c, s in lists.values()]))
    seen = F.array(F.struct(F.lit(-1).alias("label"), F.lit(0).alias("s")))
    # numbers in columns of their own, so that a hash aggregation takes them
    feats = {f"f{i}": F.pmod(F.xxhash64(F.lit(i), F.coalesce(c.cast("string"), F.lit(""))), F.lit(FEATURES)).cast("int") for i, c in enumerate(features)}
    long = answers.where(F.col(item).isNotNull() & F.col(annotator).isNotNull()).select(F.col(item).alias("item"), F.col(annotator).alias("a"), *[c.alias(n) for n, c in feats.items()], F.explode(F.concat(seen, parts)).alias("x"))
    long = long.join(F.broadcast(names), long["a"] == names["name"]).select("item", "who", *feats, F.col("x.label").alias("label"), F.col("x.s").alias("s"))  # at most MAX_ANNOTATORS rows
    one = long.groupBy("item", "who", "label").agg(F.bit_or("s").alias("s"), *[F.min(n).alias(n) for n in feats])
    # per item at most annotators x labels entries, however often it was answered
    packed = one.groupBy("item").agg(*[F.min(n).alias(n) for n in feats], F.sort_array(F.collect_list(F.struct("who", "label", "s"))).alias("x"))
    f = F.array_sort(F.array(*feats)) if feats else F.array().cast("array<int>")
    return packed.select("item", f.alias("f"), F.col("x.who").alias("who"), F.col("x.label").alias("label"), F.col("x.s").alias("s"))


def _arrays(batch: pa.RecordBatch):
    """Flat arrays of a batch of packed items: cells (item, label) and answers (cell, annotator, answer)."""
    who, label, s = (batch.column(i) for i in (2, 3, 4))
    off = who.offsets.to_numpy().astype(np.int64)
    lo, hi = off[0], off[-1]
    w = who.values.to_numpy(zero_copy_only=False)[lo:hi].astype(np.int64)
    lab = label.values.to_numpy(zero_copy_only=False)[label.offsets[0].as_py() : label.offsets[len(label)].as_py()].astype(np.int64)
    st = s.values.to_numpy(zero_copy_only=False)[s.offsets[0].as_py() : s.offsets[len(s)].as_py()].astype(np.int64)
    row = np.repeat(np.arange(len(who)), np.diff(off))
    said = lab >= 0
    big = int(lab.max(initial=0)) + 1
    cell_code = np.unique(row[said] * big + lab[said])
    c_row, c_lab = cell_code // big, cell_code % big
    n_cells = np.bincount(c_row, minlength=len(who))
    # every annotator of an item faces every cell of it
    p_row, p_who = row[~said], w[~said]
    first = np.concatenate(([0], np.cumsum(n_cells)))[:-1]
    times = n_cells[p_row]
    a_who = np.repeat(p_who, times)
    a_cell = np.repeat(first[p_row], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    answer = np.full(len(a_cell), OPEN)
    # find the answer of each stated (row, annotator, label)
    top = max(int(w.max(initial=0)), 0) + 1
    code = a_cell * top + a_who
    order = np.argsort(code)
    stated_cell = np.searchsorted(cell_code, row[said] * big + lab[said])
    at = order[np.searchsorted(code, stated_cell * top + w[said], sorter=order)]
    answer[at] = np.choose(st[said], [OPEN, PRESENT, ABSENT, OPEN])
    named = np.bincount(stated_cell, st[said] & 1, minlength=len(cell_code)) > 0
    return c_row, c_lab, a_cell, a_who, answer, n_cells, named


def _design(batch: pa.RecordBatch, c_row: np.ndarray, c_lab: np.ndarray, n_cells: np.ndarray, n_labels: int) -> np.ndarray:
    """Active features of each cell, one column each: the label, each item feature, the number of labels raised."""
    f = batch.column(1)
    width = len(f[0].as_py()) if len(f) else 0
    cols = [c_lab]
    if width:
        off = f.offsets.to_numpy().astype(np.int64)
        vals = f.values.to_numpy(zero_copy_only=False).astype(np.int64)
        per = vals[off[:-1, None] + np.arange(width)]
        cols += [n_labels + per[c_row, i] for i in range(width)]
    cols.append(n_labels + FEATURES + np.minimum(np.floor(2 * np.log2(n_cells[c_row])).astype(np.int64), COUNTS - 1))
    return np.stack(cols, 1)


def _posterior(batch: pa.RecordBatch, modes: np.ndarray, confusion: np.ndarray, weights: np.ndarray):
    c_row, c_lab, a_cell, a_who, answer, n_cells, named = _arrays(batch)
    x = _design(batch, c_row, c_lab, n_cells, len(modes))
    z = weights[x].sum(1)
    m = modes[c_lab[a_cell]] if len(a_cell) else np.zeros(0, int)
    llr = np.log(confusion[a_who, m, 1, answer]) - np.log(confusion[a_who, m, 0, answer])
    total = z + np.bincount(a_cell, llr, minlength=len(c_row))
    # a label that only presence is stated of shows up only if somebody named it: condition on that
    seen = modes[c_lab] == 1
    silent = np.zeros((2, len(c_row)))
    for t in (0, 1):
        silent[t] = np.where(seen, np.exp(np.bincount(a_cell, np.log(confusion[a_who, m, t, OPEN]), minlength=len(c_row))), 0.0)
    silent = np.minimum(silent, 0.98)
    total += np.log1p(-silent[0]) - np.log1p(-silent[1])
    q = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
    return c_row, c_lab, a_cell, a_who, answer, m, x, z, q, silent, named


def _round(batches, modes, confusion, weights, n_ann: int):
    """Sums of one pass: confusion counts, then gradient and curvature of the classifier."""
    n_feat = len(weights)
    conf = np.zeros(n_ann * 2 * 2 * 3)
    grad, hess = np.zeros(n_feat), np.zeros((n_feat, n_feat))
    for batch in batches:
        if not batch.num_rows:
            continue
        c_row, c_lab, a_cell, a_who, answer, m, x, z, q, silent, _ = _posterior(batch, modes, confusion, weights)
        if not len(c_row):
            continue
        at = ((a_who * 2 + m) * 2) * 3 + answer
        conf += np.bincount(at, 1 - q[a_cell], minlength=len(conf)) + np.bincount(at + 3, q[a_cell], minlength=len(conf))
        # the cells of that kind that nobody named, as many as the model expects: all their answers are open
        unseen = np.stack([(1 - q) * silent[0] / (1 - silent[0]), q * silent[1] / (1 - silent[1])])
        for t in (0, 1):
            conf += np.bincount(((a_who * 2 + m) * 2 + t) * 3 + OPEN, unseen[t][a_cell], minlength=len(conf))
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        v = p * (1 - p)
        # over the features that occur, each pair of columns once
        used, at = np.unique(x, return_inverse=True)
        at, k, width = at.reshape(x.shape), len(used), x.shape[1]
        grad[used] += np.bincount(at.ravel(), np.repeat(q - p, width), minlength=k)
        i, j = np.triu_indices(width)
        half = np.bincount((at[:, i] * k + at[:, j]).ravel(), np.repeat(v, len(i)) * np.tile(np.where(i == j, 0.5, 1.0), len(v)), minlength=k * k).reshape(k, k)
        hess[np.ix_(used, used)] += half + half.T
    flat = np.concatenate([conf, grad, hess.ravel()])
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], ["i", "x"])


def fit(packed: DataFrame, annotators: list[str], modes: np.ndarray, rounds: int = 12, l2: float = 4.0) -> Model:
    """Expectation-maximisation from an even prior and honest annotators.

    Each annotator's matrix is smoothed towards the pooled one (weight 6), so
    people with few answers are judged with caution.
    """
    n_ann, n_feat = len(annotators), len(modes) + FEATURES + COUNTS
    conf = np.zeros((n_ann, 2, 2, 3))
    conf[:, 0] = [[0.2, 0.6, 0.2], [0.7, 0.15, 0.15]]
    conf[:, 1] = [[0.2, 0.2, 0.6], [0.7, 0.05, 0.25]]
    w = np.zeros(n_feat)
    for _ in range(rounds):
        now = (conf, w)
        sums = packed.mapInArrow(lambda it, m=now: _round(it, modes, m[0], m[1], n_ann), "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # a fixed number of parameters
        flat = np.zeros(n_ann * 12 + n_feat + n_feat * n_feat)
        for r in sums:
            flat[r.i] = r.x
        c = flat[: n_ann * 12].reshape(n_ann, 2, 2, 3)
        pool = c.sum(0) + 1.0
        pool = pool / pool.sum(-1, keepdims=True)
        new = c + 6.0 * pool
        new = new / new.sum(-1, keepdims=True)
        g = flat[n_ann * 12 : n_ann * 12 + n_feat] - l2 * w
        h = flat[n_ann * 12 + n_feat :].reshape(n_feat, n_feat) + l2 * np.eye(n_feat)
        w = w + np.linalg.solve(h, g)
        moved = float(np.abs(new - conf).max())
        conf = new
        if moved < 1e-3:
            break
    return Model(annotators, conf, w)


def consensus(answers: DataFrame, item: str, annotator: str, lists: dict[str, tuple[Column, int]], modes: dict[int, int], features: list[Column] | None = None, rounds: int = 12, scratch: Scratch | None = None) -> Consensus:
    """Consensus labels, agreement per item and reliability per annotator.

    ``modes`` maps a label to 0 (presence and absence are stated) or 1 (only
    presence is).  Returns

    * ``labels`` (item, label_idx, n_present, n_absent, n_open, probability,
      named): every label that some annotator stated; ``named`` if one stated
      its presence, be it one who called it absent too and so is counted as open,
    * ``items`` (item, n_annotators, agreement): the mean over its labels of the
      share of pairs of annotators who agree, NULL for a single annotator,
    * ``annotators`` (annotator, mode, answers, p_present_if_true,
      p_present_if_false, reliability): the fitted matrix, and the mean of the
      chances of calling a true label present and a false one not present.

    Answers without an item or annotator are no cases; NULL lists are empty.
    Empty tables give empty results.
    """
    spark = answers.sparkSession
    scratch = scratch or Scratch(spark, "consensus")
    people = [r[0] for r in answers.select(annotator).where(F.col(annotator).isNotNull()).distinct().limit(MAX_ANNOTATORS + 1).collect()]
    if len(people) > MAX_ANNOTATORS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
    people.sort()
    names = spark.createDataFrame([(p, i) for i, p in enumerate(people)], "name string, who int")
    packed = scratch.keep(pack_answers(answers, item, annotator, lists, features or [], names), "answers")
    mode = np.zeros(max(modes, default=0) + 1, int)
    for j, m in modes.items():
        mode[j] = m
    model = fit(packed, people, mode, rounds) if people else Model([], np.zeros((0, 2, 2, 3)), np.zeros(len(mode) + FEATURES + COUNTS))

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c_row, c_lab, a_cell, a_who, answer, m, x, z, q, _, named = _posterior(batch, mode, model.confusion, model.weights)
            count = lambda v: pa.array(np.bincount(a_cell[answer == v], minlength=len(c_row)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c_row)), pa.array(c_lab, pa.int32()), count(PRESENT), count(ABSENT), count(OPEN), pa.array(q), pa.array(named)], ["item", "label_idx", "n_present", "n_absent", "n_open", "probability", "named"])

    kind = packed.schema["item"].dataType.simpleString()
    labels = packed.mapInArrow(score, f"item {kind}, label_idx int, n_present bigint, n_absent bigint, n_open bigint, probability double, named boolean")
    n = F.col("n_present") + F.col("n_absent") + F.col("n_open")
    same = F.expr("n_present * (n_present - 1) + n_absent * (n_absent - 1) + n_open * (n_open - 1)")
    items = labels.groupBy("item").agg(F.max(n).alias("n_annotators"), F.avg(F.when(n > 1, same / (n * (n - 1)))).alias("agreement"))
    conf = model.confusion
    lines = [(a, "pn" if m == 0 else "pu", float(conf[i, m, 1, PRESENT]), float(conf[i, m, 0, PRESENT]), float((conf[i, m, 1, PRESENT] + 1 - conf[i, m, 0, PRESENT]) / 2)) for i, a in enumerate(people) for m in (0, 1)]
    reliable = spark.createDataFrame(lines, "annotator string, mode string, p_present_if_true double, p_present_if_false double, reliability double")
    return Consensus(labels, items, reliable)
