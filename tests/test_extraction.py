from knotwork.operators import extraction, relations

TEXT = (
    "O empresário Rui Barros Lima é sócio da Beta Obras Ltda. (CNPJ 11.222.333/0001-81). O telefone de contato da Beta Obras Ltda é (11) 98888-7777.\n\n"
    "Ana Prado Nunes, irmã de Rui Barros Lima, mora na Rua Flores, 12. A Gama Serviços S/A integra o Consórcio Norte Vivo."
)


def _run(spark, rows, dictionary=None):
    sents = extraction.sentences(spark.createDataFrame(rows, "doc_id long, text string"))
    return sents, extraction.mentions(sents, dictionary)


def test_mentions_and_relations(spark):
    sents, found = _run(spark, [(1, TEXT)])
    kinds = {(r.kind, r.text.rstrip(".")) for r in found.collect()}
    assert {("company", "Beta Obras Ltda"), ("company_number", "11.222.333/0001-81"), ("phone", "(11) 98888-7777"), ("person", "Rui Barros Lima"), ("person", "Ana Prado Nunes"), ("address", "Rua Flores, 12"), ("consortium", "Consórcio Norte Vivo")} <= kinds
    got = {(r.de, r.para, r.label) for r in relations.relations(sents, found).collect()}
    assert {
        ("person:rui barros lima", "company:beta obras", "partner"),
        ("company:beta obras", "phone:11988887777", "phone"),
        ("person:ana prado nunes", "person:rui barros lima", "kin"),
        ("company:gama servicos", "consortium:consorcio norte vivo", "integra"),
    } <= got
    assert {(r.number, r.owner) for r in extraction.attach_numbers(found).collect()} == {("company_number:11222333000181", "company:beta obras")}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a" * 200_000), (4, "Rui Lima viu Rui Lima."), (5, "O grupo delta x cresceu.")]
    sents, found = _run(spark, rows, {"Delta X": "company"})
    assert sents.where("length(s) > 1500").count() == 0
    assert {(r.doc_id, r.id) for r in found.collect()} == {(4, "person:rui lima"), (5, "company:delta x")}
    assert relations.relations(sents, found).count() == 0


def test_entities_and_suggestions(spark):
    _, found = _run(spark, [(1, "disse Rui Barros Lima."), (2, "disse Rui Lima."), (3, "disse Rui Lima."), (4, "disse Rui Sousa Lima.")])
    known = extraction.entities(found)
    assert {(r.id, r.sources, r.review) for r in known.collect()} == {("person:rui barros lima", 1, True), ("person:rui lima", 2, False), ("person:rui sousa lima", 1, True)}
    assert {(r.a, r.b) for r in extraction.merge_suggestions(known).collect()} == {("person:rui barros lima", "person:rui lima"), ("person:rui lima", "person:rui sousa lima")}


def test_only_telling_sentences_are_searched(spark):
    """What can't name anything is dropped before it is split; no mention is lost by it."""
    said = ["nada aqui. Nem ali.", "a b c", "ligue (31) 98765-4321 ja", "cpf 123.456.789-09", "cnpj 12.345.678/0001-95", "٠٠ ١٢٣.٤٥٦.٧٨٩-٠٩", "ver Av. Brasil", "o Dr. Rui foi", "a Rua\nFlores, 12", "x@y.co", "É A", "Ana e Bia", "D'Ávila de O-x", "Olmo S. A. veio", "Ro\rsa Ma\rria", "Casa Um & Dois ME.", "Gil. Eva"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    rows = lambda sents: sorted((r.doc_id, r.sent, r.pos, r.kind, r.text) for r in extraction.mentions(sents).collect())
    few = extraction.telling_sentences(docs)
    assert rows(few) == rows(extraction.sentences(docs)) and len(rows(few)) > 10
    assert not {0, 1, 16} & {r.doc_id for r in few.collect()}
