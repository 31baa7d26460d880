"""Carrier fits against brute force, with more carriers than any plan could carry as a constant."""
import random

from pyspark.sql import functions as F

from packledger.operators import carryon as K

LIMITS = "name string, region string, carry_on_cm array<int>, carry_on_linear_cm int, personal_cm array<int>"
BAGS = ("id string, dims_cm array<double>, volume_l double, weight_g int, category string")


def fitting(dims, carry_on, linear, personal):
    """(carry_on, personal) as true, false or None."""
    three = dims is not None and len(dims) >= 3
    axes = lambda limit: None if not three or limit is None else len(limit) >= len(dims) and all(
        d is None or d <= m for d, m in zip(sorted(dims, key=lambda x: (x is None, -(x or 0))), sorted(limit, reverse=True)))
    by_axis = axes(carry_on)
    by_sum = None if not three or linear is None or None in dims else sum(dims) <= linear
    both = by_axis if by_sum is None else by_sum if by_axis is None else by_axis and by_sum
    return both, axes(personal)


def carriers(n, rng):
    for i in range(n):
        limit = [rng.randint(45, 60), rng.randint(30, 45), rng.randint(15, 30)]
        rng.shuffle(limit)
        yield (f"Line {i}", "r", None if i % 9 == 0 else limit, None if i % 4 else rng.randint(95, 125),
               None if i % 5 == 0 else [rng.randint(30, 45), rng.randint(20, 35), rng.randint(10, 25)])


def bags(n, rng):
    for i in range(n):
        dims = [float(rng.randint(10, 62)) for _ in range(3)] if i % 3 else [50.0, 35.0, 20.0]  # a hot shape
        dims = None if i % 17 == 0 else dims[:2] if i % 13 == 0 else dims + [5.0] if i % 11 == 0 else dims
        yield (f"b{i}", dims, None if i % 7 == 0 else float(i % 60), 900, f"c{i % 3}")


def test_fifty_thousand_carriers(spark):
    rng = random.Random(11)
    lines, packs = list(carriers(50_000, rng)), list(bags(60, rng))
    table, rows = spark.createDataFrame(lines, LIMITS), spark.createDataFrame(packs, BAGS)
    got = {r["id"]: (r["carry_on"], r["carry_on_of"], r["personal"], r["personal_of"]) for r in K.compliance(rows, table).collect()}
    said = sum(c is not None or s is not None for _, _, c, s, _ in lines), sum(p is not None for *_, p in lines)
    for id_, dims, *_ in packs:
        if dims is not None and len(dims) >= 3:
            fits = [fitting(dims, c, s, p) for _, _, c, s, p in lines]
            assert got.pop(id_) == (sum(f[0] is True for f in fits), said[0], sum(f[1] is True for f in fits), said[1]), dims
    assert not got


def test_every_question_agrees_and_none_reads_at_plan_time(spark):
    rng = random.Random(12)
    lines, packs = list(carriers(40, rng)), list(bags(80, rng))
    packs.append(("odd", [40.0, None, 10.0], 3.0, 900, "c0"))
    table, rows = spark.createDataFrame(lines, LIMITS), spark.createDataFrame(packs, BAGS)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    asked = [K.carriers_fitting(rows, table), K.fits_by_airline(rows, table), K.just_misses(rows, table),
             K.fit_matrix(rows, table), K.category_mix(rows, table), K.compliance(rows, table)]
    assert len(tracker.getJobIdsForGroup()) == before
    slug = lambda n: n.lower().replace(" ", "-")
    fits = {(i, slug(n)): fitting(d, c, s, p) for i, d, *_ in packs for n, _, c, s, p in lines}
    assert {(r["id"], r["airline"]): (r["carry_on"], r["personal"]) for r in asked[3].collect()} == fits
    assert {r["id"]: r["airlines"] for r in asked[0].collect()} == {
        i: sorted(a for (j, a), f in fits.items() if i == j and f[0]) for i, *_ in packs}
    known = {i for i, d, *_ in packs if d is not None and len(d) >= 3}
    counted = {r["airline"]: (r["fits"], r["personal"]) for r in asked[1].collect()}
    assert counted == {slug(n): tuple(sum(f[k] is True for (i, a), f in fits.items() if a == slug(n) and i in known)
                                      for k in (0, 1)) for n, *_ in lines}
    total = sum(c is not None or s is not None for _, _, c, s, _ in lines)
    n_fit = {i: sum(f[0] is True for (j, _), f in fits.items() if i == j) for i in known}
    assert {(r["airline"], r["id"]) for r in asked[2].collect()} == {
        (a, i) for (i, a), f in fits.items() if i in known and f[0] is False and n_fit[i] * 5 >= total * 3}
    none = table.limit(0)
    assert K.compliance(rows, none).agg(F.sum("carry_on"), F.max("personal_of")).first()[0] == 0
    assert K.fits_by_airline(rows.limit(0), table).where("fits = 0 and personal = 0").count() == len(lines)
