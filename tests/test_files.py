from datetime import date

import pytest
from pyspark.sql import functions as F

from skuflow.functions import clean as C
from skuflow.sources import files


def test_headers():
    assert files.header_names(["Date", "Produit", "Type flux", "Qty"]) == {
        "Date": "date", "Produit": "product_id", "Type flux": "flow_type", "Qty": "quantity"}
    assert files.header_names([" Product type ", "date", "flow", "quantite"])[" Product type "] == "product_id"
    with pytest.raises(ValueError, match="quantity"):
        files.header_names(["Date", "Product", "Flow Type"])


def test_event_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Date,Product,Flow Type,Quantity\n15-02-2026,31554,Ingoing,150\n2026-02-16,x,out,7.9\n,3,in,\n")
    got = files.read_events(spark, str(tmp_path)).orderBy("sku").collect()
    assert [(r.day, r.sku, r.flow_word, r.qty) for r in got] == [
        (date(2026, 2, 16), 0, "out", 7), (None, 3, "in", 0), (date(2026, 2, 15), 31554, "Ingoing", 150)]


def test_each_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("Date,Product,Flow Type,Quantity\n15-02-2026,1,in,5\n")
    (tmp_path / "b[1].csv").write_text('\n\ufeffnote,"Qty",TYPE,produit,date,Product again\nx,7,"a,b",2,2026-02-16,9\ny,8,out\n')
    (tmp_path / "c.csv").write_text("date,product_id,flow,quantity\n2026-02-17,3,out,1\n")  # the layout of the first
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("quantity,date,flow,product_id\n")
    got = files.read_events(spark, str(tmp_path))
    assert sorted((str(r.day), r.sku, r.flow_word, r.qty) for r in got.collect()) == [
        ("2026-02-15", 1, "in", 5), ("2026-02-16", 2, "a,b", 7), ("2026-02-17", 3, "out", 1), ("None", 0, "out", 8)]
    (tmp_path / "f.csv").write_text("date,product,flow\n")
    with pytest.raises(ValueError, match="quantity"):
        files.read_events(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "g.csv").write_text("\n\n")
    with pytest.raises(ValueError, match="header"):
        files.read_events(spark, str(tmp_path / "none"))


def test_dirty_products(spark):
    raw = spark.createDataFrame(
        [(1, "A", "12", "x", None, "2.5", "True"), (2, "B", None, "4", "bad", "", "False"), (3, "C", "1", "1", "1", "1", None)],
        "sku int, category string, pack_bundle string, pack_pallet string, unit_volume string, weight_kg string, stackable string",
    )
    got = [tuple(r)[2:] for r in files.clean_products(raw).orderBy("sku").collect()]
    assert got == [(12.0, 1.0, 0.0, 2.5, 1.0), (1.0, 4.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0, 0.0)]


def test_finite_or_zero(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), None, "s"), (1.5, float("-inf"), 3, None)], "a double, b double, c long, d string")
    assert [tuple(r) for r in C.finite_or_zero(df).collect()] == [(0.0, 0.0, 0, "s"), (1.5, 0.0, 3, None)]


def test_rounding(spark):
    df = spark.createDataFrame([(0.125, 2.5, -0.00001), (0.135, 0.2, 1.0)], "a double, q double, n double")
    got = df.select(C.even_rounded("a"), C.pick_quantity("q"), C.rounded("n").cast("string")).collect()
    assert tuple(got[0]) == (0.12, 2, "0.0") and got[1][1] == 1


def test_forecast_sinks(spark, tmp_path):
    df = spark.createDataFrame([(date(2026, 1, 2), 7, 1.239)], "day date, sku long, pred double")
    files.write_forecast(df, str(tmp_path / "iso"))
    files.write_forecast(df, str(tmp_path / "fr"), style="day_first", by_day=True)
    iso = spark.read.option("header", True).csv(str(tmp_path / "iso"))
    assert iso.columns == ["date", "id_produit", "quantite_demande"] and tuple(iso.first()) == ("2026-01-02", "7", "1.24")
    fr = spark.read.option("header", True).csv(str(tmp_path / "fr")).first()
    assert fr.Date == "02-01-2026" and fr.day == date(2026, 1, 2)


def test_instruction_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "Storage", "S1", "Reception -> S1", " why: ")], "event_id int, Product int, Action string, Location string, Route string, Reason string")
    files.write_instructions(df, str(tmp_path / "i"))
    back = spark.read.option("header", True).csv(str(tmp_path / "i"))
    assert back.columns == ["Product", "Action", "Location", "Route", "Reason"] and back.first()["Reason"] == " why: "


def test_log_target_inverse(spark):
    df = spark.createDataFrame([(0.0,), (41.5,)], "y double")
    got = df.select(C.unlog_target(C.log_target("y")).alias("y"), C.unlog_target(F.lit(-3.0)).alias("z")).collect()
    assert [r.y for r in got] == pytest.approx([0.0, 41.5]) and got[0].z == 0.0
