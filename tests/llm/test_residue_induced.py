"""Templates in words and delimiters that no list has: induced from the records beside them."""

from tarrafa.llm import residue

SCHEMA = "id long, title string, article_content string, sourceurl string"


def reasons(spark, rows):
    return {r["id"]: r["reason"] for r in residue.residue(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_equal_pages_of_many_sites_in_unlisted_words(spark):
    rows = [(i, f"Manchete {i}", "Sistema fora do ar. Código interno do portal. Aguarde o retorno do plantão.", f"https://s{i % 9}.br/{i}") for i in range(60)]
    assert reasons(spark, rows) == {i: "induced" for i in range(60)}


def test_slots_of_aligned_lines(spark):
    line = "A chuva parou.\nPublicado em {} por {}\nfim"
    filled = [(i, f"m{i}", line.format(f"{i}/3/2020", f"Ana Prado {i}"), f"https://a.br/{i}") for i in range(30)]
    odd = [("~data~", "^autor^"), ("", ""), ("data_publicacao", "Ana"), ("1/2/2003", "None"), ("«data»", "«autor»")]
    kept = ["Rita saiu de  casa por \nfim", "Publicado ontem por ~fulano~ de casa", "[A-12] em 3/4/2020 por Rui"]
    rows = filled + [(100 + i, "m", line.format(*o), "https://a.br/z") for i, o in enumerate(odd)] + [(200 + i, "m", t, "https://a.br/y") for i, t in enumerate(kept)]
    assert reasons(spark, rows) == {100 + i: "induced" for i in range(len(odd))}


def test_what_most_lines_of_a_template_hold_is_no_residue(spark):
    rows = [(i, f"m{i}", f"Leia em Natal às 5h28 por Rita [a{i}b]", f"https://a.br/{i}") for i in range(30)] + [(100 + i, f"x{i}", f"Leia em Natal às 5h28 por Rita {i}", f"https://a.br/x{i}") for i in range(10)]
    assert reasons(spark, rows) == {}


def test_seeds_beyond_plain_names(spark):
    found = ["Prezado {0}, seu pedido %s foi enviado", "{{ user.first-name }}", "${user['nome']}", "{{#each itens}}", "<%- include('topo') -%>", "-" * 300 + "\nPágina não encontrada\n" + "-" * 300, "x" * 5 + " " + "-" * 300 + "\nErro 404 | Acesso negado"]
    kept = ["100%s de aumento", "sobe 5% em {ano", "A ponte caiu em 12 lugares", "Página não encontrada vira filme. " + "O diretor riu. " * 100]
    assert set(reasons(spark, [(i, "t", x, "https://a.br/1") for i, x in enumerate(found + kept)])) == set(range(len(found)))


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "", "\n \n", ""), (2, "{{a}}", None, None), (2, "{{a}}", None, None)]
    assert reasons(spark, rows) == {2: "slot"}
    assert residue.residue(spark.createDataFrame([], SCHEMA)).count() == 0
