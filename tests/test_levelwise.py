"""Level-wise combination mining against enumeration, with more labels than a mask has bits."""

import itertools
import random
from collections import Counter

import pytest

from groundwork import operators as op

SCHEMA = "area string, wid string, logdate string, parlabel string"


def _brute(rows, support, max_size, min_count=1, keys=(1,)):
    counts, totals = Counter(), Counter()
    for r in rows:
        if r[3] is None or any(r[k] is None for k in keys):
            continue
        unit = (r[0], *[r[k] for k in keys])
        counts[(unit, r[3])] += 1
        totals[unit] += 1
    held = {}
    for (unit, label), n in counts.items():
        if n >= min_count:
            held.setdefault(unit, set()).add(label)
    out = {}
    for unit, labels in held.items():
        for k in range(1, max_size + 1):
            for c in itertools.combinations(sorted(labels), k):
                wells, samples = out.get((unit[0], c), (0, 0))
                out[(unit[0], c)] = (wells + 1, samples + totals[unit])
    return {k: v for k, v in out.items() if v[0] >= support}


def _found(df):
    return {(r["area"], tuple(r["members"])): (r["units"], r["samples"]) for r in df.collect()}


def test_two_hundred_labels_equal_enumeration(spark):
    rng = random.Random(5)
    labels = [f"L{i:03d}" for i in range(200)]
    rows = []
    for w in range(120):
        mine = rng.sample(labels, 6) + [x for x in labels[:6] if rng.random() < 0.6]
        rows += [(f"A{w % 2}", f"w{w}", "d", x) for x in mine for _ in range(rng.randint(1, 3))]
    rows += [("A0", "hot", "d", labels[i % 8]) for i in range(2000)] + [("A0", None, "d", "L001"), ("A0", "w1", "d", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = _brute(rows, 3, 4, 2)
    got = op.frequent_combos(op.label_sets(df, min_count=2, group_cols=["area"]), 3, range(1, 5), ["area"])
    assert _found(got) == want
    assert max(len(k[1]) for k in want) >= 3


def test_runs_to_the_last_level_and_reports_wanted_sizes(spark):
    rows = [("A", w, "d", x) for w in ("w1", "w2") for x in "abcde"] + [("A", "w3", "d", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    sets = op.label_sets(df, min_count=1, group_cols=["area"])
    every = _found(op.frequent_combos(sets, 2, None, ["area"]))
    assert every == _brute(rows, 2, 5) and len(every) == 31
    sized = _found(op.frequent_combos(sets, 2, [3, 5], ["area"]))
    assert sized == {k: v for k, v in every.items() if len(k[1]) in (3, 5)}


def test_visits_as_units_and_text(spark):
    rows = [("A", "w", "d1", "b"), ("A", "w", "d1", "a"), ("A", "w", "d2", "a"), ("A", "w", None, "b"), ("A", "v", "d1", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    sets = op.label_sets(df, keys=["wid", "logdate"], min_count=1)
    got = {(r["contaminants"], r["units"], r["samples"], r["c_num"]) for r in op.frequent_combos(sets, 1).collect()}
    assert got == {("['a']", 3, 4, 1), ("['b']", 1, 2, 1), ("['a', 'b']", 1, 2, 2)}


def test_nothing_frequent_and_empty_tables(spark):
    df = spark.createDataFrame([("A", "w", "d", "a")], SCHEMA)
    for t in (df, df.limit(0)):
        out = op.frequent_combos(op.label_sets(t, min_count=1), 2)
        assert out.columns == ["contaminants", "members", "units", "samples", "c_num"] and out.count() == 0
    assert op.frequent_combos(op.label_sets(df, min_count=1), 1, []).count() == 0
    with pytest.raises(ValueError):
        op.frequent_combos(op.label_sets(df), 0)


def test_levels_need_no_nested_loop(spark):
    rows = [("A", f"w{i}", "d", x) for i in range(4) for x in "abc"]
    sets = op.label_sets(spark.createDataFrame(rows, SCHEMA), min_count=1)
    from groundwork.operators.levelwise import _candidates

    frequent = op.frequent_combos(sets, 1, [2]).select("members").withColumnRenamed("members", "combo")
    plan = _candidates(frequent, [], 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
