"""Rules of the name cleaner and of surnames, each by cases of our own."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import names as N
from folioforge.functions import text as T

KEPT = [
    # a role inside, before, after, with a colon, as a segment
    ("Rivas Lago, Tomás, asesor", ["Rivas Lago, Tomás", "Tomás Rivas Lago"]),
    ("Eva Inés Asesora Campo Mora", ["Eva Inés Campo Mora"]),
    ("Eva Inés Co-Asesor Campo Mora", ["Eva Inés Campo Mora"]),
    ("Lago Ruiz, Eva Co-Asesor", ["Lago Ruiz, Eva", "Eva Lago Ruiz"]),
    ("Director: Tomás Lago", ["Tomás Lago"]),
    ("Lago Ruiz, Eva, sinodal", ["Lago Ruiz, Eva", "Eva Lago Ruiz"]),
    ("Lago, Eva, ?,--impresor", ["Lago, Eva", "Eva Lago"]),
    # identifiers and numbers joined to a name
    ("#EVA INÉS", ["EVA INÉS"]),
    ("Lago Ruiz Eva#LARE900101MDFGZV05", ["Lago Ruiz Eva"]),
    ("LAGO RUIZ, EVA:-LARE900101MMNRRR03", ["LAGO RUIZ, EVA", "EVA LAGO RUIZ"]),
    ("EVA LAGO RUIZ:417", ["EVA LAGO RUIZ"]),
    ("Lago Ruiz %2007, Eva", ["Lago Ruiz, Eva", "Eva Lago Ruiz"]),
    ("Lago, Eva de, 1673-1743", ["Lago, Eva de", "Eva de Lago"]),
    ("Lago, Eva de, fl. 1725", ["Lago, Eva de", "Eva de Lago"]),
    ("Lago, Eva, 1961-", ["Lago, Eva", "Eva Lago"]),
    # lists that go on, titles
    ("Lago-Ruiz, Eva... [y otros]", ["Lago-Ruiz, Eva", "Eva Lago-Ruiz"]),
    ("Lago, Eva ... [et al.]", ["Lago, Eva", "Eva Lago"]),
    ("M. en C. LAGO RUIZ, EVA", ["LAGO RUIZ, EVA", "EVA LAGO RUIZ"]),
    ("LAGO RUIZ, MVZ. EVA", ["LAGO RUIZ, EVA", "EVA LAGO RUIZ"]),
    ("EVA C.P.C. y E.I. LAGO", ["EVA LAGO"]),
    # what looks like a role or title and is a name
    ("Eva Tutor Lago", ["Eva Tutor Lago"]),
    ("Ruiz, M.C.", ["Ruiz, M.C.", "M.C. Ruiz"]),
    ("Eva Colegio Lago", ["Eva Colegio Lago"]),
    # characters
    ("Lago‐Ruiz, Eva", ["Lago-Ruiz, Eva", "Eva Lago-Ruiz"]),
    ("\u202aEva Lago", ["Eva Lago"]),
    ("Eva M´endez", ["Eva Méndez"]),
    ("Eva Me´ndez", ["Eva Méndez"]),
    ("EVA RODR´ IGUEZ", ["EVA RODRÍGUEZ"]),
    ("Eva Martı´n", ["Eva Martín"]),
    ("Eva O´Hara", ["Eva O'Hara"]),
    ("EVA NU˜NO", ["EVA NUÑO"]),
    ("Lago, E. (Eva)", ["Lago, E.", "E. Lago"]),
    ("La[g]o Ruiz", ["Lago Ruiz"]),
    ("Garc?a, Mar?a", ["Garc?a, Mar?a", "Mar?a Garc?a"]),
    # several people, or one with two commas
    ("Eva Lago Ruiz, Tom Mora, Inés de la Paz", ["Eva Lago Ruiz", "Tom Mora", "Inés de la Paz"]),
    ("Lago-Ruiz, Eva, J.", ["Lago-Ruiz, Eva, J.", "Eva, J. Lago-Ruiz"]),
]
DROPPED = ["LARE900101MDFGZV05=asesorTesis", "#0000-0001-2345-678X", "# 0000-0001-2345-6789", "#/0000-0001-2345-6789", "CVU1023=asesorTesis", "LARE900101TJ0", "asesorTesis", "2014", "D 2247", "RN3191", "*CA12", "sinodal", "https://ror.org/05x", "info:eu-repo/dai/mx/curp/", "Universiadad Virtual", "Lago & Co., Eva", "Imprenta de Lago", "Lago y Compañía", "uno dos tres cuatro cinco seis siete ocho nueve diez once"]


def test_names_of_a_field(spark):
    rows = [(k, raw) for k, (raw, _) in enumerate(KEPT)] + [(1000 + k, raw) for k, raw in enumerate(DROPPED)]
    got = {r.k: r.names for r in spark.createDataFrame(rows, "k int, x string").select("k", N.clean_names(F.col("x")).alias("names")).collect()}
    assert {KEPT[k][0]: got[k] for k in range(len(KEPT))} == dict(KEPT)
    assert {raw: got[1000 + k] for k, raw in enumerate(DROPPED)} == dict.fromkeys(DROPPED, [])


@pytest.mark.parametrize(("a", "b", "score"), [((), (), 0), (("lago",), (), 0), (("lago", "m"), ("lago", "m"), 0), (("lago",), ("lago", "ruiz"), 1), (("ruiz",), ("lago", "ruiz"), 1), (("lago", "ruiz"), ("lago", "ruiz"), 1), (("lago", "mora"), ("lago", "ruiz"), 0), (("de-la-paz", "mora"), ("paz", "mora"), 1)])
def test_surnames(a, b, score):
    assert N.surname_score(a, b) == score


def test_surname_typos():
    assert N.surname_score(("hernandez", "lago"), ("hernadnez", "lago")) == pytest.approx(1 - 1 / 9)
    assert N.surname_score(("lago", "de-paz", "mora"), ("lago", "paz", "mira")) == pytest.approx(1 - 1 / 8)  # "paz mora"


@pytest.mark.parametrize("heading", ["Conclusiones", "CONCLUSIÓN:", "5. Concluding remarks", "Discusión y conclusiones", "Conclusiones y recomendaciones", "IV Conclusions"])
@pytest.mark.parametrize("end", ["\nReferencias\n[1] x", "\n6. Bibliography\n", "\nAgradecimientos", "\nAnexos", "\nApéndice A", ""])
def test_conclusions(spark, heading, end):
    df = spark.createDataFrame([(f"Intro\n{heading}\n\nAll is well.\nIndeed.{end}",)], "x string")
    assert df.select(T.conclusions(F.col("x"))).first()[0] == "All is well.\nIndeed."


def test_references(spark):
    heads = ["Referencias", "Referencias bibliográficas", "VII. Bibliografía:", "References", "8. Bibliography", "Fuentes consultadas"]
    body = "[1] Lago, E. (2001). A title of some length.\n2.Mora, T. (1999). Another one, long enough.\n\nPaz, I. 2004. After a blank line, still long.\n3. short\n\nPágina 12\n"
    df = spark.createDataFrame([(f"x\n{h}\n{body}Anexos\nz",) for h in heads] + [("Referencias\n" + body,), (None,)], "x string")
    got = [r[0] for r in df.select(T.split_references(F.concat(F.lit("\n"), T.reference_section(F.col("x"))))).collect()]
    want = ["Lago, E. (2001). A title of some length.", "Mora, T. (1999). Another one, long enough.", "Paz, I. 2004. After a blank line, still long."]
    assert got[:6] == [want] * 6 and got[6:] == [[], []]


def test_types_and_tags(spark):
    kinds = {"Master Thesis": ("Tesis", "Tesis"), "info:eu-repo/semantics/doctoralThesis": ("Tesis", "Documento Académico"), "book chapter": ("Libro", "Libro"), "Journal paper": ("Artículo", "Documento Académico"), "Memorias": ("Conferencia / Ponencia", "Documento Académico"), "Reporte Técnico": ("Reporte Técnico", "Documento Académico"), "ponencia": ("Conferencia / Ponencia",) * 2}
    df = spark.createDataFrame([(k,) for k in kinds] + [(None,)], "x string")
    got = {r[0]: (r[1], r[2]) for r in df.select("x", T.doc_type(F.col("x")), T.statistics_type(F.col("x"))).collect()}
    assert got == kinds | {None: ("Documento Académico",) * 2}
