"""Sentences that name many: no cap on who is linked."""

from itertools import combinations

from knotwork.operators import extraction, relations

WORDS = ("Lima", "Prado", "Nunes", "Barros", "Sousa", "Rocha", "Melo", "Dias", "Pinto")


def test_sentences_of_many_names_link_all(spark):
    persons = [f"Rui {w}" for w in WORDS]
    sents = extraction.sentences(spark.createDataFrame([(1, f"disse que {', '.join(persons)}, sócio da Beta Obras Ltda, e da Gama Obras Ltda.")], "doc_id long, text string"))
    found = extraction.mentions(sents, None)
    ids = {r.id for r in found.collect()}
    assert len(ids) == 11  # 18 pairs of a person and a company, 11 entities
    got = {(frozenset((r.de, r.para)), r.label) for r in relations.relations(sents, found).collect()}
    assert {pair for pair, _ in got} == {frozenset(p) for p in combinations(ids, 2)}
    # each person is nearest to the first company, which is nearest to the last person; so is the second one
    beta = {frozenset((f"person:rui {w.lower()}", "company:beta obras")) for w in WORDS}
    assert {pair for pair, label in got if label == "partner"} == beta | {frozenset(("person:rui pinto", "company:gama obras"))}
