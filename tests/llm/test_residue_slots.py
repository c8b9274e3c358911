"""Slots with names in any letters or nothing in them, and repeated pages in words that no list has."""

from tarrafa.llm import residue

SCHEMA = "id long, title string, article_content string, sourceurl string"


def test_names_in_any_letters_and_blanks(spark):
    found = ["[INSERIR TÍTULO]", "{{título}}", "{{ti\u0301tulo}}", "Obra em <%= região %> atrasa", "custou %PREÇO%", "(completar ÓRGÃO)", "__SEÇÃO__", "{{ }}", "Obra em <%= %> atrasa", "de ${} ontem", "em [[ ]] hoje", "por <?= ?>"]
    kept = ["{} e 100%", "[ ] a fazer", "Ação [Ágil] sobe", "50% às 10%", "() e <>"]
    df = spark.createDataFrame([(i, t, None, "https://s.br/1") for i, t in enumerate(found + kept)], SCHEMA)
    assert {r["id"] for r in residue.residue(df).collect()} == set(range(len(found)))


def test_repeated_pages_in_words_of_no_list(spark):
    words = "A ponte caiu e os duendes foram tomar café. Código {0:06x}abcd1234"
    pages = [(i, f"Manchete {i}", words.format(i), f"https://s{i % 4}.br/{i}") for i in range(12)]
    # The same wire story on many sites, under one headline with the site's name; the same page sent again; figures that differ.
    wire = [(100 + i, f"Chuva alaga bairro - Site {i % 6}", "A chuva alagou o bairro ontem.", f"https://s{i % 6}.br/w{i}") for i in range(18)]
    again = [(200 + i, "Festa começa", None, f"https://s{i % 6}.br/f{i % 6}") for i in range(18)]
    figures = [(300 + i, f"Tarifa sobe {i}%", f"Relato {i} do conselho", f"https://s{i % 3}.br/t{i}") for i in range(18)]
    df = spark.createDataFrame(pages + wire + again + figures, SCHEMA)
    assert {r["id"] for r in residue.residue(df).collect()} == set(range(12))
