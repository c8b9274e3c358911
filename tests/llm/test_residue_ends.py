"""Residue whose ends are blanks, rules or mock Latin, and learnt phrases counted over all records."""

from pyspark.sql import functions as F

from tarrafa.llm import residue

SCHEMA = "id long, title string, article_content string, sourceurl string"


def test_blanks_and_rules_at_the_ends_hide_nothing(spark):
    texts = [
        "\n" * 300 + "Erro 404 Página não encontrada", "-" * 300 + "\nErro 404 Página não encontrada\n" + "=" * 300, "\xa0 " * 200 + "Acesso negado" + " \t" * 200, "Página" + " " * 300 + "não encontrada",
        "sed do ut labore et dolore magna aliqua " * 20 + "fim", "Hoje sed do ut labore et dolore magna aliqua enim ad minim quis fim", "qwert " * 60, "Erro 404 " + "-" * 300 + " Página não encontrada",
    ]
    kept = ["\n" * 300 + "A prefeitura abriu 40 vagas.", "-" * 300 + "Obra parou ontem", "Do et al. veio a non grata"]
    df = spark.createDataFrame([(i, "t", t, "https://s.br/1") for i, t in enumerate(texts + kept)], SCHEMA)
    assert {r["id"] for r in residue.residue(df).collect()} == set(range(len(texts)))


def learnt_from(df):
    texts = df.select("id", F.explode(F.array("title", "article_content")).alias("_text"), F.regexp_extract("sourceurl", "//([^/]+)", 1).alias("_site"))
    return texts.where(residue.may_be_page(F.col("_text"))).select("_site", residue.masked(F.col("_text")).alias("_mask")), texts


def test_learnt_phrases_are_counted_over_all_records(spark):
    data = [(i, f"Erro 500 | Agenda da semana | Tente de novo em alguns minutos. | Ray {i:06x}abcd1234", None, f"https://s{i % 5}.br/{i}") for i in range(20)]
    ordinary = [(100 + i, "t", f"Festa no bairro {chr(97 + i)}. Agenda da semana. Chuva volta ao litoral amanhã", f"https://s{i % 5}.br/n{i}") for i in range(10)]
    found = lambda rows: [r[0] for r in residue.induced_phrases(*learnt_from(spark.createDataFrame(rows, SCHEMA))).collect()]
    assert found(data) == ["agenda da semana"] and found(data + ordinary) == []


def test_a_known_end_beyond_the_window_is_seen(spark):
    ends = ["qwe " * 100, "Tente de novo " * 30, "\n" * 300 + "Tente de novo" + "_" * 300]
    data = [(i, "t", f"Ponte {'caiu' * 80} do gateway | {ends[i % 3]}", f"https://s{i % 5}.br/{i}") for i in range(15)]
    assert residue.residue(spark.createDataFrame(data, SCHEMA)).where("reason = 'induced'").count() == 15
