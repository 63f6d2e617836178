"""Canonical records: rounds against a walk over the proposals, and the phases on fixtures."""

import numpy as np
import pytest

from kadastra.operators import canonical

LABEL = "node long, root long, pinned boolean"
PROPOSAL = "source long, target long, reason string, ord long"


def walk(nodes, proposals, separate, pinned):
    root = {n: n for n in nodes}
    for source, target, _, _ in sorted(proposals, key=lambda p: p[3]):
        a, b = root[source], root[target]
        if a == b or a in pinned:
            continue
        one, two = ({n for n in nodes if root[n] == r} for r in (a, b))
        if any((x in one and y in two) or (x in two and y in one) for x, y in separate):
            continue
        root.update({n: b for n in one})
    return root


@pytest.mark.parametrize("seed", [1])
def test_rounds_give_what_the_walk_gives(spark, seed):
    draw = np.random.default_rng(seed)
    nodes = list(range(40))
    proposals = [(int(a), int(b), "r", i) for i, (a, b) in enumerate(draw.integers(0, 40, (24, 2)))]
    separate = [(int(a), int(b)) for a, b in draw.integers(0, 40, (60, 2)) if a != b]
    pinned = {3, 17, 39}
    labels = spark.createDataFrame([(n, n, n in pinned) for n in nodes], LABEL)
    got, taken = canonical.settle(labels, spark.createDataFrame(proposals, PROPOSAL), spark.createDataFrame(separate, "a long, b long"))
    want = walk(nodes, proposals, separate, pinned)
    assert {r.node: r.root for r in got.collect()} == want
    assert taken.count() == 40 - len(set(want.values()))


def test_all_that_come_to_one_record_are_decided_together(spark, monkeypatch):
    rounds, cut = [], canonical.cut
    monkeypatch.setattr(canonical, "cut", lambda df: rounds.append(1) or cut(df))
    proposals = [(n, 0, "r", n) for n in range(1, 60)] + [(0, 60, "r", 60), (61, 0, "r", 61)]
    separate = [(3, 5), (5, 9), (0, 7), (61, 60)]
    labels = spark.createDataFrame([(n, n, n == 11) for n in range(62)], LABEL)
    got, _ = canonical.settle(labels, spark.createDataFrame(proposals, PROPOSAL), spark.createDataFrame(separate, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == walk(range(62), proposals, separate, {11})
    assert len(rounds) < 40  # sixty rounds before


COMPLEX = "id long, parent_id long, name string, core string, junk boolean, bare_junk boolean, slug string, is_umbrella boolean, housing_class string, is_newbuild boolean, listings long"


def record(i, name, **more):
    base = {"id": i, "parent_id": None, "name": name, "core": name, "junk": False, "bare_junk": False, "slug": None, "is_umbrella": False, "housing_class": None, "is_newbuild": False, "listings": 0}
    return tuple((base | more).values())


def run(spark, rows, separate=(), manual=()):
    got = canonical.assign(spark.createDataFrame(rows, COMPLEX), spark.createDataFrame(list(separate), "a long, b long"), spark.createDataFrame(list(manual), "id long, target long"), "for sale|flat")
    return {r.id: (r.canonical_id, r.reason) for r in got.collect()}


def test_junk_goes_to_the_name_that_it_begins_with(spark):
    rows = [record(1, "garden"), record(2, "garden hills"), record(3, "garden hills for sale now", junk=True), record(4, "garden 2 for sale", junk=True), record(5, "garden: flat", junk=True), record(6, "gardens", junk=True), record(7, "twin"), record(8, "twin"), record(9, "twin flat", junk=True), record(10, "garden", junk=True, parent_id=1)]
    got = run(spark, rows)
    assert got[3] == (2, "name_prefix") and got[5] == (1, "name_prefix")
    assert {got[i] for i in (4, 6, 9, 10)} == {(None, "junk_unmatched")} and got[1] == (None, None)


def test_equal_slugs_join_families(spark):
    rows = [
        record(1, "sun", slug="s", listings=5), record(2, "sun by x", core="sun", slug="s", housing_class="a"), record(3, "for sale", junk=True, bare_junk=True, slug="s"),
        record(4, "moon", slug="m"), record(5, "star", slug="m"), record(6, "moon y", core="moon", slug="m", listings=9), record(7, "flat", junk=True, bare_junk=True, slug="m"),
        record(8, "sun", slug="s", parent_id=2), record(9, "sun for sale", junk=True),
    ]
    got = run(spark, rows)
    assert got[1] == (2, "krisha_slug") and got[3] == (2, "krisha_slug")
    assert got[4] == (6, "krisha_slug") and got[5] == (None, None) and got[7] == (None, "junk_unmatched")
    assert got[8] == (None, None) and got[9][1] == "junk_unmatched"  # 8 has the name too


def test_separations_hold_through_a_chain(spark):
    rows = [record(i, "sun", slug="s", listings=10 - i) for i in range(1, 5)]
    got = run(spark, rows, separate=[(2, 3)])
    assert got == {1: (None, None), 2: (1, "krisha_slug"), 3: (None, None), 4: (1, "krisha_slug")}


def test_manual_decisions_come_first_and_pin(spark):
    rows = [record(1, "sun", slug="s", listings=9), record(2, "sun", slug="s"), record(3, "old name"), record(4, "x", slug="s", core="sun"), record(5, "y")]
    got = run(spark, rows, manual=[(3, 2), (4, None), (5, 3)])
    assert got[3] == (2, "manual_review") and got[5] == (2, "manual_review")
    assert got[4] == (None, None) and got[2] == (None, None) and got[1] == (2, "krisha_slug")
    with pytest.raises(ValueError, match="separates"):
        run(spark, rows, separate=[(2, 3)], manual=[(3, 2)])


def test_no_records(spark):
    assert run(spark, []) == {}
