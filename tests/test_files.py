"""Readers and writers on small files."""
import gzip
import json

import pytest
from pyspark.sql import functions as F

from packledger.sources import files as IO


def test_raw_with_a_torn_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"slug": "a", "products": [{"id": 1, "t": "x"}, {"id": 2}]}, indent=1))
    (tmp_path / "b.json").write_text('{"slug": "b", "products": [{"id": 1')
    products, unreadable = IO.read_raw(spark, str(tmp_path))
    assert [(r.pos, json.loads(r.product)["id"], r.platform) for r in products.orderBy("pos").collect()] == [
        (0, 1, "shopify"), (1, 2, "shopify")]
    assert [r.file for r in unreadable.collect()] == ["b.json"]


def test_rulings_have_three_states_and_a_vocabulary(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"_note": {"x": "y"}, "brand-1": {"X-Pac": None, " Royale  Red": "red"}}))
    got = {(r.brand, r.key): r.value for r in IO.read_rulings(spark, str(path), ["red"]).collect()}
    assert got == {("brand-1", "x-pac"): None, ("brand-1", "royale red"): "red"}
    with pytest.raises(Exception, match="unknown ruling"):
        IO.read_rulings(spark, str(path), ["blue"]).collect()


def test_ledger_drops_a_torn_line(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    path.write_text('{"ts":"2026-01-01T00:00:00","bag_id":"a","price":1.5}\n{"ts":"2026-01-02T00:')
    assert [(r.bag_id, r.price) for r in IO.read_ledger(spark, str(path)).collect()] == [("a", 1.5)]


def test_state_snapshots(spark, tmp_path):
    path = str(tmp_path / "state")
    assert IO.load_state(spark, path).count() == 0
    df = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "key string, price double")
    IO.save_state(df, path, "1")
    IO.save_state(df.where("key = 'a'"), path, "2")
    assert [r.key for r in IO.load_state(spark, path).collect()] == ["a"]
    assert IO.load_state(spark, path, "1").count() == 2


def test_airlines_and_rates(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"airlines": [{"name": "X", "carry_on_cm": [1, 2, 3], "personal_cm": None}]}))
    row = IO.read_airlines(spark, str(tmp_path / "a.json")).first()
    assert (row["name"], row["carry_on_cm"], row["personal_cm"]) == ("X", [1, 2, 3], None)
    (tmp_path / "fx.xml").write_text("<x><Cube time='2026-01-05'><Cube currency='USD' rate='1.25'/><Cube currency='GBP' rate='0.5'/></Cube></x>")
    rates, missing = IO.read_fx(spark, str(tmp_path / "fx.xml"))
    assert {r.currency: r.per_usd for r in rates.collect()} == {"USD": 1.0, "GBP": 0.4, "EUR": 0.8}
    assert "GBP" not in {r.currency for r in missing.collect()} and missing.count() == 12


def test_stored_pages_open_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "brand__bag.html.gz", "wt", encoding="utf-8") as f:
        f.write("<p>Größe\n45 L</p>")
    row = IO.read_pages(spark, str(tmp_path)).first()
    assert (row.page_key, row.html) == ("brand__bag", "<p>Größe\n45 L</p>")


def test_images_and_baseline(spark, tmp_path):
    (tmp_path / "i.jpg").write_bytes(b"abc")
    assert IO.read_images(spark, str(tmp_path)).first().length == 3
    assert IO.baseline(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        IO.baseline(spark, str(tmp_path / "none"), require=True)


def test_worklist_round_trip(spark, tmp_path):
    rows = [("a", 'x, "y"\nz'), ("b", "plain")]
    IO.write_worklist(spark.createDataFrame(rows, "name string, domain string"), str(tmp_path / "w"))
    assert sorted(tuple(r) for r in IO.read_worklist(spark, str(tmp_path / "w")).collect()) == rows


def test_lookup_bounds(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [(r.id, r.place) for r in IO.lookup(df, ["b", "x", "a", "b"]).collect()] == [("b", 0), ("a", 2), ("b", 3)]
    assert IO.lookup(df, []).count() == 0
    many = IO.lookup(df, ["a"] * 500)
    assert many.count() == 500
    asked = spark.createDataFrame([("b", 7)], "id string, place int")
    assert [(r.id, r.place) for r in IO.lookup(df, asked).collect()] == [("b", 7)]


def test_a_lost_run_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "state")
    df = spark.createDataFrame([("a", 1.0)], "key string, price double")
    IO.save_state(df, path, "1")
    IO.save_state(df.withColumn("price", df.price + 1), path, "2")
    (tmp_path / "state" / "run=2" / "_SUCCESS").unlink()  # as a lost job leaves it
    assert [r.price for r in IO.load_state(spark, path).collect()] == [1.0]
    IO.write_catalogue(df, df, df, str(tmp_path / "c"), "1")
    IO.write_catalogue(df.limit(0), df, df, str(tmp_path / "c"), "2")
    (tmp_path / "c" / "run=2" / "meta" / "_SUCCESS").unlink()
    assert IO.read_catalogue(spark, str(tmp_path / "c"), "bags").count() == 1


def test_a_repeated_run_replaces_its_ledger_rows(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2026-01-02 00:00:00' as ts, 'a' as bag_id, 1.0D as price, 1L as ord")
    for run in ("1", "2", "2"):
        IO.append_ledger(rows, str(tmp_path / "l"), run)
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
