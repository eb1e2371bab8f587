"""Invariants from the test plan, on the sf0.001 tables."""

import itertools

from groundwork import operators as op
from groundwork.params import CONTS11
from groundwork.plans import catalog as cat
from groundwork.sources import lookups
from tests.conftest import SF001


def test_lookup_joins_never_grow_rows(spark):
    clean = cat._clean(spark, SF001)
    n = clean.count()
    m = op.join_mcl(clean, lookups.mcl_table(spark))
    u = op.convert_units(m, lookups.unit_table(spark))
    loc = op.join_locations(u, cat._locations(spark, SF001))
    assert n >= m.count() >= u.count() >= loc.count()


def test_strict_wells_within_relaxed_wells(spark):
    e = cat._enriched(spark, SF001)
    for k in (3, 4):
        strict = {r.wid for r in op.spec_wells(e, CONTS11, since=cat.SINCE, min_count=k).select("wid").distinct().collect()}
        relaxed = {r.wid for r in op.spec_wells_relaxed(e, CONTS11, min_count=k, since=cat.SINCE).select("wid").distinct().collect()}
        assert strict <= relaxed


def test_combination_support_is_anti_monotone(spark):
    st = {r.contaminants: r.wells for r in cat.q_combo_stats(spark, SF001).collect()}
    labels = sorted(CONTS11)
    for k in range(4, 11):
        for c in itertools.combinations(labels, k):
            small = st[str(list(c))]
            for extra in labels:
                if extra not in c:
                    bigger = str(sorted([*c, extra]))
                    assert st[bigger] <= small
