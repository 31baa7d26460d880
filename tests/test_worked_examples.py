"""Examples whose outcome is stated."""
import pytest
from pyspark.sql import functions as F

from packledger.functions import fixed as X, scalars as S, text as T
from packledger.operators import classify as C, models as M


def test_volume(ev):
    assert ev(T.volume, "Travel Pack 45L", "28lt / 1710cu.in", "45 L", "x12L", None) == [45, 28, 45, None, None]
    assert ev(T.volume_cuin, "1710 cu in", "no") == [28.0, None]


def test_bag_volume(ev):
    assert ev(T.volume_bag, "Quarry 16 with Pebble 2L Reservoir",
              "Capacity: 20 liters  Hydration Bladder Capacity: No",
              "can be easily attached to or removed from our Iterus 38L",
              "Fits Session 16L, Drafter 18L, Drafter 14L", "fits laptops up to 16in\nCapacity: 24 L",
              "designed for the on-the-go traveler this versatile 17L bag",
              "this personal item bag fits under most airline seats and offers 18 liters of organized space"
              ) == [None, 20, None, None, 24, 17, 18]


def test_long_text_without_punctuation(ev):
    assert ev(T.volume_bag, "fits " + "word " * 60000 + "40L") == [None]


def test_dims(ev):
    got = ev(T.dims, 'Length: 21.5" (54.5 cm)  Width: 13.5" (34 cm)  Depth: 9" (23 cm)',
             "22.5in H x 11in L x 12.8in W", "52 × 33 × 23 cm", '20.5" x 13" x 9"',
             "52 / 23 / 18 (L x W x D) cm", "38/40/42 cm", "Height: 30")
    assert [(r.dims, r.source) if r else None for r in got] == [
        ([54.5, 34, 23], "description:labelled"), ([57.1, 32.5, 27.9], "description:axis-in"),
        ([52, 33, 23], "description:cm"), ([52.1, 33.0, 22.9], "description:in"), None, None, None]
    slash = ev(lambda c: T.dims(c, slash=True), "52 / 23 / 18 (L x W x D) cm")[0]
    assert (slash.dims, slash.source) == ([52, 23, 18], "description:cm-slash")


def test_weight(ev):
    assert ev(T.weight, "2,7 kg", "10-11kg", "6–7kg", "3.85oz/sqy", "865g / 1lb 14.5oz") == [2700, None, None, None, 454]
    assert ev(lambda c: T.weight(c, True), "865g / 1lb 14.5oz") == [865]
    assert ev(T.weight_labelled, "600D means 9,000 meters of yarn weigh 600 grams", "Fabric weight: 130 g/m²") == [None, None]
    assert ev(lambda c: T.near_label(c, "weight", T.weight),
              "hip belt 4.7 Oz Weights & Measurements / 31.8 Oz") == [902]
    assert ev(S.store_grams, "880", "1.184", "0") == [880, 1184, None]


def test_capacity_lists(ev):
    nav, spec = "20L 30L 35L 40L 46L", "TOTAL VOLUME: 3,274 CI | 54 L Main Body: 2184 CI | 35.8 L and 3.4 L"
    assert ev(T.capacity_lists_blanked, nav, spec) == [" " * len(nav), spec]


def test_many_capacity_runs(ev):
    gap = " and then words that stand between these runs, too many for them to be one " * (1 + X.CAPACITY_RUN_SPAN // 50)
    nav, two = "11L 12L 13L", "21L 22L"
    text = gap.join([nav, two] * 3000)
    blank = gap.join([" " * len(nav), two] * 3000)
    assert ev(T.capacity_lists_blanked, text, f"x{gap}{nav} end", None, "", "11L 12L", "11L 11L 11L") == [
        blank, f"x{gap}{' ' * len(nav)} end", None, "", "11L 12L", "11L 11L 11L"]


@pytest.mark.parametrize("title,category", [
    ("Cross Body Bag XL", "sling"), ("Waistpack", "hip-pack"), ("Seat-Pack", "bike-bag"),
    ("Toptube-Bag", "bike-bag"), ("Hiking 28 L Backpack", "hiking-pack"),
    ("Trekking 45+10 L Rucksack", "hiking-pack"), ("Hiking Shoes", None), ("Belt Bag", "hip-pack")])
def test_titles(ev, title, category):
    assert ev(C.titled, title) == [category]


def test_exclusions(ev):
    gone = lambda c: C.excluded(c, multipack=True)
    assert ev(gone, "Contact Sling 8.0 180cm", "Belt Bag", "Leather Coasters 4-Pack", "Arete 18 Pack 1.5L") == [True, False, True, False]


def test_colours(ev):
    assert ev(C.family_of_words, "Multicam Black", "Atacama Clay", "X-Pac", "A35-CHOICEDDC_ZL-10") == ["multi", "brown", None, None]


def test_names(ev):
    assert ev(M.model_key, "Stash Pouch - Black", "PRVKE 15L in Wasatch Green", "Travel Pack 3 in X-Pac Black") == [
        "stash pouch", "prvke 15l", "travel pack 3 in x-pac black"]
    assert ev(S.name_without_volumes, "Vanish Jet Duffel 38L & 58L", "Dry Bags: 3L, 5L, 10L or 15L") == ["Vanish Jet Duffel", "Dry Bags"]
    assert ev(S.locale_currency, "en-us", None) == ["USD", None]


def test_rounding_is_to_the_binary_value(ev):
    n = lambda c: T.tenth(c.cast("double"))
    assert ev(n, "6.35", "31.75", "57.15", "12.25", "2.55") == [round(x, 1) for x in (6.35, 31.75, 57.15, 12.25, 2.55)]


def test_taxonomy_and_shelves(ev):
    assert ev(C.taxonomy, "Backpack > Convertible > RFID Protection") == [None]
    assert ev(lambda c: C.type_veto(c, F.lit("Thing")), "Beauty, Cosmetic Case", "Footwear") == [False, True]
    veto = lambda c: C.climb_veto(F.lit("sling"), F.array_join(C.shelf_crumbs(
        F.array(F.lit("Climb On"), c), F.lit("Climb On")), " "))
    assert ev(veto, "Camp & Hike", "Climb") == [False, True]


def test_figures_outside_the_plausible_range_are_harmless(spark):
    from packledger.functions import scalars as S
    rows = [("500 cm", "40 cm"), ("999 in", "10 in"), ("450", "30"), ("50 cm", "30 cm")]
    df = spark.createDataFrame([([["Height", "Width"], list(r)],) for r in rows], "t array<array<string>>").select(
        T.table_specs(F.array("t")).alias("s"))
    assert [None if r.s is None else r.s.dims for r in df.collect()] == [None, None, None, [50.0, 30.0]]
    w = spark.sql("select explode(array(100000.0D, 1234.0D, 999999999.0D)) as g").select(S.weight_text(F.col("g"))).collect()
    assert [r[0] for r in w] == ["100.00 kg", "1.23 kg", "1000000.00 kg"]
    d = spark.sql("select array(500.0D, 40.25D) as d").select(S.dims_text(F.col("d"))).first()[0]
    assert d == "500.0 × 40.3 cm"


def test_digest_has_no_limits(spark):
    from packledger.operators import markup
    page = ("<img src='/i.jpg'>" * 60 + "<table><tr><td>1</td></tr></table>" * 20 + "<dl>" + "<dt>a<dd>b" * 150 + "</dl><p>"
            + "word " * 10_000 + "</p>Capacity 33 L")
    d = markup.digest(page)
    assert (len(d["images"]), len(d["tables"]), len(d["pairs"])) == (60, 20, 150)
    assert d["text"].endswith("Capacity 33 L") and len(d["text"]) > 50_000
    deep = "[" * 5000 + "]" * 5000
    assert markup.parsed("{broken") is None and markup.spec_lines(deep) == [] and markup.spec_lines("{}") == []
    nested = {"size": "1 L"}
    for _ in range(300):
        nested = {"x": [nested]}
    import json
    assert markup.spec_lines(json.dumps(nested)) == ["size: 1 L"]
    assert markup.product_and_trail(["{broken", '{"@graph": [{"@type": ["Product"], "name": "x"}]}'])[0] is not None
