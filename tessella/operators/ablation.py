"""Greedy ablation of persona fields under the heuristic judge."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that may be taken away, and for each dimension of the judge the weight of
# a field and how many entries count.
FIELDS = ("goals", "pains", "motivations", "objections", "channels", "vocabulary", "decision_triggers", "sample_quotes", "journey_stages")
JUDGE = {
    "grounded": (("goals", 1.7, 4), ("pains", 1.3, 4), ("motivations", 1.0, 3), ("objections", 0.8, 3), ("sample_quotes", 0.8, 4)),
    "distinctive": (("sample_quotes", 1.8, 4), ("vocabulary", 1.2, 6), ("goals", 0.6, 4), ("journey_stages", 0.4, 2)),
    "coherent": (("goals", 1.2, 4), ("pains", 1.0, 4), ("motivations", 1.0, 3), ("objections", 1.0, 3), ("journey_stages", 0.8, 2), ("decision_triggers", 0.8, 3)),
    "actionable": (("goals", 1.7, 4), ("pains", 1.4, 4), ("decision_triggers", 1.3, 3), ("sample_quotes", 0.6, 4)),
    "voice_fidelity": (("sample_quotes", 1.8, 4), ("vocabulary", 1.4, 6), ("channels", 0.4, 4), ("journey_stages", 0.4, 2)),
}
COLLAPSE = 2.0


def clean_count(values: Column) -> Column:
    """Entries that aren't blank; none for null."""
    return F.coalesce(F.size(F.filter(values, lambda v: F.trim(v) != "")), F.lit(0))


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dimension(specs: tuple, count) -> Column:
    """1 to 5 by the weighted share of entries, halves rounded to even; ``count`` gives a field's number of them."""
    total = sum(w for _, w, _ in specs)
    return F.bround(1 + 4 * (_sum([F.lit(w) * F.least(count(f) / F.lit(float(cap)), F.lit(1.0)) for f, w, cap in specs]) / F.lit(total)), 2)


def overall(count) -> Column:
    return F.bround(_sum([dimension(s, count) for s in JUDGE.values()]) / len(JUDGE), 2)


def judge(personas: DataFrame) -> DataFrame:
    """``personas`` (persona_id and an array<string> for each of ``FIELDS``) with the judge's dimensions and overall."""
    n = {f: clean_count(F.col(f)).cast("double") for f in FIELDS}
    d = personas.select("persona_id", *(n[f].alias(f) for f in FIELDS))
    return d.select("persona_id", *(dimension(s, F.col).alias(k) for k, s in JUDGE.items()), overall(F.col).alias("overall"))


def spine(personas: DataFrame, collapse: float = COLLAPSE) -> DataFrame:
    """persona_id, control, removal_order, scores, steps, spine, spine_overall: fields taken away one after
    another, each time that without which the judge still gives most (of equal ones the last by name),
    until the score is below ``collapse`` or nothing is left.

    Counts and scores are whole numbers here: a dimension is looked up by its fields' counts, and all personas of a
    batch take a step at once. No rows meet, so nothing is shuffled."""
    clean = F.array(*(clean_count(F.col(f)) for f in FIELDS))
    present = F.array(*(F.coalesce(F.size(f), F.lit(0)) > 0 for f in FIELDS))
    d = personas.select("persona_id", clean.alias("n"), present.alias("present"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_table(specs) for specs in JUDGE.values()]
        for batch in batches:
            if batch.num_rows:
                n, present = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("n", "present"))
                yield pa.RecordBatch.from_arrays([batch.column("persona_id"), *_spines(n, present, tables, collapse)], SPINE)

    kind = personas.schema["persona_id"].dataType.simpleString()
    return d.mapInArrow(run, f"persona_id {kind}, control double, removal_order array<string>, scores array<double>, steps int, spine array<string>, spine_overall double")


SPINE = ["persona_id", "control", "removal_order", "scores", "steps", "spine", "spine_overall"]


def _table(specs: tuple) -> tuple[np.ndarray, np.ndarray]:
    """A dimension in hundredths by the place of its fields' counts, and how much one entry of each of ``FIELDS`` (up to
    its cap) moves that place; rounded as :func:`dimension` is, halves of the written number to even."""
    total, stride, steps = sum(w for _, w, _ in specs), 1, np.zeros((2, len(FIELDS)), dtype=np.int64)
    for f, _, cap in reversed(specs):
        steps[:, FIELDS.index(f)] = stride, cap
        stride *= cap + 1
    values = np.empty(stride, dtype=np.int64)
    for at, counts in enumerate(itertools.product(*(range(cap + 1) for _, _, cap in specs))):
        got = reduce(lambda a, b: a + b, (w * min(c / float(cap), 1.0) for c, (_, w, cap) in zip(counts, specs, strict=True)))
        values[at] = int(Decimal(repr(1 + 4 * (got / total))).quantize(Decimal("0.01"), ROUND_HALF_EVEN) * 100)
    return values, steps


def _spines(n: np.ndarray, present: np.ndarray, tables: list, collapse: float) -> list[pa.Array]:
    rows, k = n.shape
    share = [np.minimum(n, steps[1]) * steps[0] for _, steps in tables]  # of each field in a dimension's place
    place = [s.sum(axis=1) for s in share]
    # the mean of five is a fifth of hundredths, which never lies half way
    mean = lambda places: (2 * sum(v[p] for (v, _), p in zip(tables, places, strict=True)) + len(tables)) // (2 * len(tables))
    control = last = mean(place)
    left, by_name = present.astype(bool), sorted(range(k), key=lambda f: FIELDS[f], reverse=True)
    order, scores, steps = np.zeros((rows, k), dtype=np.int64), np.zeros((rows, k), dtype=np.int64), np.zeros(rows, dtype=np.int64)
    for _ in range(k):
        on = left.any(axis=1) & ((steps == 0) | (last / 100.0 >= collapse))
        if not on.any():
            break
        best, field = np.full(rows, -1), np.zeros(rows, dtype=np.int64)
        for f in by_name:  # of equal scores the last name, which comes first here
            score = np.where(left[:, f], mean([p - s[:, f] for p, s in zip(place, share, strict=True)]), -1)
            field, best = np.where(score > best, f, field), np.maximum(score, best)
        r, f = np.flatnonzero(on), field[on]
        order[r, steps[r]], scores[r, steps[r]] = f, best[r]
        last = np.where(on, best, last)
        place = [np.where(on, p - s[np.arange(rows), field], p) for p, s in zip(place, share, strict=True)]
        left[r, f] = False
        steps[r] += 1
    names, taken = pa.array(FIELDS), np.arange(k) < steps[:, None]
    lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
    spine = lists(left.sum(axis=1), names.take(pa.array(np.nonzero(left)[1])))
    return [pa.array(control / 100.0), lists(steps, names.take(pa.array(order[taken]))), lists(steps, pa.array(scores[taken] / 100.0)), pa.array(steps.astype(np.int32)), spine, pa.array(last / 100.0)]


def removal_ranking(spines: DataFrame) -> DataFrame:
    """field, mean_removal_step, survival_rate over all personas; a field that was never taken counts as
    the step after the last."""
    total = spines.agg(F.count("*").alias("total"))  # one row
    d = spines.select(F.explode(F.array(*map(F.lit, FIELDS))).alias("field"), "removal_order", "steps", "spine")
    at = F.array_position("removal_order", F.col("field"))
    d = d.groupBy("field").agg(F.avg(F.when(at > 0, at).otherwise(F.col("steps") + 1)).alias("mean_removal_step"), F.count_if(F.array_contains("spine", F.col("field"))).alias("kept"))
    return d.join(total, F.lit(True)).select("field", "mean_removal_step", (F.col("kept") / F.col("total")).alias("survival_rate"))
