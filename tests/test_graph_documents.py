import json

import pytest
from pyspark.errors import PySparkException

from knotwork.cases import analysing, building, graphs
from knotwork.operators import export

TEXT = """A Oficina Roda Viva Ltda fica situada na Rua do Sino, 3. Téo Prates Lobo é dono da Oficina Roda Viva Ltda desde 2015.

Téo Lobo é sócio da Casa </script> Lima ME. O telefone (71) 3222-1010 é da Oficina Roda Viva Ltda. "Aspas" e \\barras\\ de Téo Prates Lobo.
"""


def plain(rows, *without):
    return sorted(json.dumps({k: v for k, v in r.asDict(True).items() if k not in ("case_id", "ord", *without)}, sort_keys=True) for r in rows.collect())


@pytest.mark.parametrize("page", [False, True])
def test_a_document_comes_back(spark, tmp_path, page):
    texts = spark.createDataFrame([("c", 0, "um.txt", TEXT), ("c", 1, "dois.txt", TEXT.replace("2015", "2016"))], "case_id string, src int, source string, text string")
    case = building.build(spark, [], texts)
    nicknames = spark.createDataFrame([("c", "phone:+557132221010", "Téo «T»", "a.csv", None)], "case_id string, id string, name string, source string, org string")
    case = case._replace(nicknames=nicknames)
    export.write_document(graphs.document(case, "Título", page), f"{tmp_path}/parts")
    name = "graph.html" if page else "graph.json"
    export.concatenate(spark, f"{tmp_path}/parts", f"{tmp_path}/{name}")
    text = (tmp_path / name).read_text(encoding="utf-8")
    if not page:
        assert {e["tipo"] for e in json.loads(text)["entidades"]} == {"pessoa", "empresa", "endereco", "telefone"}
    else:
        assert text.count("</script>") == 1
    back = graphs.read(spark, f"{tmp_path}/{name}")
    for t in ("sources", "entities", "evidence", "links", "suggestions", "nicknames"):
        got, want = plain(getattr(back, t)), plain(getattr(case, t))
        assert got == want and want, t
    order = lambda c: [r.id for r in c.entities.orderBy("ord").collect()]
    assert order(back) == order(case) and {r.case_id for r in back.links.collect()} == {name}
    assert plain(analysing.pivots(back.links)) == plain(analysing.pivots(case.links))


def test_foreign_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"entidades":[{"id":"pessoa:x","tipo":"pessoa","rotulo":"X"}],"vinculos":[{"de":"pessoa:x","para":"empresa:cnpj:1","tipo":"Oficial","rotulo":"r"}],"other":1}', encoding="utf-8")
    case = graphs.read(spark, f"{tmp_path}/a.json")
    assert [(r.id, r.kind, r.aliases, r.review) for r in case.entities.collect()] == [("person:x", "person", [], False)]
    assert [(r.de, r.para, r.weight, r.sources) for r in case.links.collect()] == [("person:x", "company:cnpj:1", 3, [])]
    assert case.sources.count() == case.suggestions.count() == case.nicknames.count() == 0
    (tmp_path / "b.html").write_text("<html>nothing</html>", encoding="utf-8")
    (tmp_path / "c.json").write_text("{no", encoding="utf-8")
    for name, error in (("b.html", "no graph in the page"), ("c.json", "no graph in c.json")):
        with pytest.raises(PySparkException, match=error):
            graphs.read(spark, f"{tmp_path}/{name}").entities.collect()
