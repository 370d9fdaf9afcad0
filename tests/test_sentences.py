from knotwork.functions import scalars
from knotwork.operators import extraction
from pyspark.sql import functions as F

CASES = {
    "Mora na Av. Paulista, 100. O Dr. João Silva viu.": ["Mora na Av Paulista, 100.", "O Dr João Silva viu."],
    "A Exma. Sra. Ana saiu. A Cia. Norte ficou.": ["A Exma Sra Ana saiu.", "A Cia Norte ficou."],
    "A Alfa Obras S.A. Depois caiu. A Beta S. A. faliu.": ["A Alfa Obras SA.", "Depois caiu.", "A Beta SA. faliu."],
    "Um fim. (Dois) fins! “Três” fins.": ["Um fim.", "(Dois) fins!", "“Três” fins."],
    "Da Beta Obras Ltda. O resto.": ["Da Beta Obras Ltda.", "O resto."],
    "Da Beta Obras Ltda. (CNPJ 1) veio.": ["Da Beta Obras Ltda. (CNPJ 1) veio."],
    "\n\n": [],
}


def test_abbreviations_and_starts(spark):
    got = spark.createDataFrame([(k,) for k in CASES], "t string").select("t", scalars.sentences(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == CASES


def test_address_after_abbreviation(spark):
    sents = extraction.sentences(spark.createDataFrame([(1, "Fica na Av. Paulista, 100.")], "doc_id long, text string"))
    assert [r.text for r in extraction.mentions(sents).where("kind = 'address'").collect()] == ["Av Paulista, 100"]
