"""Queries that no SQL checks, over whole tables."""

from collections import defaultdict

from listwright.plans.catalog import listings
from listwright.registry import QUERIES

SF = "/root/testdata/sf0.01"


def test_groups_use_the_tolerance_within_a_district(spark):
    known = {r.ord: r for r in listings(spark, SF).select("ord", "price_eur", "area", "source_domain").collect()}
    groups = defaultdict(list)
    for r in QUERIES["constrained_groups"](spark, SF).collect():
        groups[r.property_id].append(known[r.ord])
    several = [g for g in groups.values() if len(g) > 1]
    assert sum(map(len, groups.values())) == len(known)
    assert any(len({r.price_eur for r in g}) > 1 for g in several)
    for g in several:
        low, high = min(r.price_eur for r in g), max(r.price_eur for r in g)
        assert high - low <= 0.015 * high and len({r.area for r in g}) == len({r.source_domain for r in g}) / len(g) == 1
