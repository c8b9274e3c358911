"""Filler of one word again and again: three times are enough, however long the word."""

from tarrafa.llm import residue

SCHEMA = "id long, title string, article_content string, sourceurl string"


def test_a_word_three_times_over_is_filler(spark):
    found = ["qwe qwe qwe 618", "nhe nhe nhe", "Preenchimento preenchimento\n PREENCHIMENTO", "nhé\xa0nhé nhé 7", "qwe asd", "zxcv zxcv", "nhe, nhe. nhe, nhe", "nhe nhe nhe, nhe", "nhe nhe nhe | Acesso negado"]
    kept = ["Tora, tora, tora", "Yeah Yeah Yeahs", "Duran Duran 2", "Bora Bora tem 618 hotéis", "nhe nhe nhe virou tema de mostra", "Gol! Gol! Gol!", None, ""]
    rows = [(i, "Manchete", t, "https://s.br/1") for i, t in enumerate(found + kept)] + [(100 + i, t, "Um texto.", "https://s.br/2") for i, t in enumerate(found + kept)]
    assert {r["id"] for r in residue.residue(spark.createDataFrame(rows, SCHEMA)).collect()} == {i for k in (0, 100) for i in range(k, k + len(found))}
