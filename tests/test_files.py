"""Delimited files and index extracts."""

import json

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from domicilia.sources import files

SCHEMA = StructType(
    [StructField("a", IntegerType()), StructField("b", DoubleType()), StructField("c", StringType())]
)


def test_scan_delimited_trims(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a;b;c\n 1 ; 2.5 ; x y \n2;;\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_delimited(spark, str(path), SCHEMA).collect()] == [(1, 2.5, "x y"), (2, None, None)]


def test_scan_decimal_comma(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes('a;b;c\n1;"2,5";São\n2;-0,125;\n3;1234,5;z\n'.encode("iso-8859-1"))
    got = files.read_delimited(spark, str(path), SCHEMA, decimal_comma=True, encoding="ISO-8859-1").collect()
    assert [tuple(r) for r in got] == [(1, 2.5, "São"), (2, -0.125, None), (3, 1234.5, "z")]


def test_sink_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2.5, "São"), (2, None, None), (3, -0.25, "b;c"), (4, 123456789.125, "d"), (5, 0.0, "e"), (6, 100.0, "f")], SCHEMA)
    path = str(tmp_path / "out")
    files.write_delimited(frame.coalesce(1), path)
    text = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert "São".encode("iso-8859-1") in text and b"2,5" in text and b"\n2;;" in text
    back = files.read_delimited(spark, path, SCHEMA, decimal_comma=True, encoding="ISO-8859-1")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in frame.collect())


def test_index_extract(spark, tmp_path):
    rows = [
        {"Mês (Código)": "201803", "Mês": "março 2018", "Valor": "0.09", "classe": 7169},
        {"Mês (Código)": "201804", "Mês": "abril 2018", "Valor": "...", "classe": 7169},
    ]
    path = tmp_path / "extract.json"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    got = files.read_index_extract(spark, str(path)).select("ref", "ref1", "valor", "classe").collect()
    assert sorted(tuple(r) for r in got) == [("201803", "março 2018", 0.09, 7169), ("201804", "abril 2018", None, 7169)]


def test_polygon_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(4).write.parquet(str(tmp_path / "v"))
    attributes, vertices = files.read_polygons(spark, str(tmp_path / "a"), str(tmp_path / "v"))
    assert (attributes.count(), vertices.count()) == (3, 4)


def test_numbers_survive_writing_and_reading(spark, tmp_path):
    values = [0.123456789012345, 4.2e-12, -1e-12, 1e21, 1234.9, 5.0, 1e10, -0.1, None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    path = str(tmp_path / "numbers")
    files.write_delimited(frame, path)
    back = files.read_delimited(spark, path, frame.schema, decimal_comma=True, encoding="ISO-8859-1")
    assert [r.x for r in back.orderBy("id").collect()] == values
