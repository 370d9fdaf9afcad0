import datetime

import pytest
from pyspark.errors import PySparkException

from knotwork.sources import importers
from knotwork.streaming.calls import windowed_pairs


def _file(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_registry_layouts(spark, tmp_path):
    a = _file(tmp_path, "a.csv", "﻿Empresa;Sócio;Qualificação;Telefone;E;Data\nBeta Obras Ltda;Rui Sá;Administrador;(11) 98888-7777;;03/2021\n;;;;;\nGama SA;;;;;\n")
    got = {(r.de, r.para, r.label, str(r.day)) for r in importers.registry(spark, a, "reg").collect()}
    assert got == {("person:rui sa", "company:beta obras", "Administrador", "2021-03-01"), ("company:beta obras", "phone:11988887777", "phone", "2021-03-01")}
    b = _file(tmp_path, "b.csv", 'de,tipo_de,para,tipo_para,rotulo,fonte,data\n"Sá, Rui",Pessoa,Beta,EMPRESA,sócio,junta,2020-02-01\n,,,,,,\n')
    (r,) = importers.registry(spark, b, "reg").collect()
    assert (r.de, r.para, r.weight, r.source, r.day) == ("person:sa rui", "company:beta", 3, "junta", datetime.date(2020, 2, 1))
    for text in ("de,tipo_de,para,tipo_para\nx,planeta,y,pessoa\n", "de,tipo_de,para,tipo_para\nx,pessoa,,pessoa\n"):
        with pytest.raises(PySparkException):
            importers.registry(spark, _file(tmp_path, f"c{len(text)}.csv", text), "reg").collect()
    with pytest.raises(ValueError, match="layout A"):
        importers.registry(spark, _file(tmp_path, "d.csv", "x,y\n1,2\n"), "reg")
    with pytest.raises(ValueError, match="empty"):
        importers.registry(spark, _file(tmp_path, "e.csv", ""), "reg")


def test_call_records(spark, tmp_path):
    path = _file(tmp_path, "c.csv", "origem,destino,data,duracao\n11988887777,11977776666,2024-01-02 23:10:00,1:05\n+55 11 98888-7777,11977776666,03/01/2024 10:00,60\n11988887777,11988887777,,5\n12,11977776666,,5\n")
    (r,) = importers.call_records(spark, path).collect()
    assert (r.a, r.b, r.n, r.seconds, r.night) == ("11988887777", "11977776666", 2, 125, 1)


def test_vcards_and_dictionary(spark, tmp_path):
    path = _file(tmp_path, "x.vcf", "BEGIN:VCARD\r\nFN:Ana\r\n  Lima\r\nitem1.TEL;TYPE=cell:(11) 98888-7777\r\nTEL:12\r\nEMAIL:a@b.co\r\nORG:Beta\r\nEND:VCARD\r\nBEGIN:VCARD\r\nN:Sá;Rui;;;\r\nEND:VCARD\r\n")
    a, b = importers.vcards(spark, path).collect()
    assert (a.name, a.tels, a.emails, a.org) == ("Ana Lima", ["11988887777"], ["a@b.co"], "Beta") and (b.name, b.tels) == ("Rui Sá", [])
    d = importers.dictionary(spark, _file(tmp_path, "d.txt", "# note\nEmpresa;Beta; Obras\nplaneta;x\npessoa;\n"))
    assert [(r.kind, r.name) for r in d.collect()] == [("company", "Beta; Obras")]


def test_pages(spark):
    html = "<html><title>T <b>x</title><nav>menu</nav><p>one<br>two</p><script>bad()</script><div>three</div></html>"
    rows = spark.createDataFrame([(1, html), (2, None), (3, "<article>" + "word " * 100 + "</article><p>rest</p>")], "page_id long, html string")
    got = {r.page_id: r for r in importers.page_texts(rows).collect()}
    assert got[1].text.split() == ["one", "two", "three"] and got[2].text == "" and "rest" not in got[3].text


def test_stream(spark, tmp_path):
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    rows = [(1, 2, at(1, 3), 5.5), (1, 2, at(1, 4), 6.0), (2, 2, at(1, 4), 1.0), (1, 3, at(2, 4), 7.0)]
    spark.createDataFrame(rows, "a long, b long, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_pairs(spark.readStream.schema("a long, b long, ts timestamp, value double").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("pairs").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.a, r.b, r.n, r.seconds) for r in spark.table("pairs").collect()} == {(1, 2, 2, 11), (1, 3, 1, 7)}
