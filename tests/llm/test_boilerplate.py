"""Furniture in three languages, in words that the labelled table doesn't have, and blocks of any length."""

import os

import numpy as np
import pytest

from tarrafa.llm import boilerplate
from tarrafa.llm.labelled_pages import KINDS, pages

#: + is the article, - the page around it.
HELD_OUT = """
- Notícias | Esporte | Cultura | Clima | Assine o jornal
- Este portal usa cookies para conhecer melhor o leitor. Ao seguir navegando você aceita a nossa política de privacidade.
- Redação do Correio do Vale
+ A ponte que liga os dois bairros de Campo Largo foi fechada ontem depois que um caminhão bateu na mureta, informou a guarda.
+ O motorista, de 44 anos, saiu ileso. "Foi um susto", disse ele aos bombeiros.
- Anúncio
+ Quando a ponte reabre
+ A prefeitura promete liberar uma das faixas até sábado, e a outra só em novembro.
- Compartilhe com um amigo
- Siga o Correio do Vale nas redes sociais
- Veja também
- Ônibus mudam de rota em Campo Largo
- Guarda apreende 14 motos em dois dias
- Festa do vinho espera 20 mil visitantes
- © 2020 Correio do Vale. Todos os direitos reservados.

- Home | Local | Traffic | Obituaries | Log in
- This website uses cookies to improve your visit. Read our privacy policy.
- By the newsroom
+ The bridge between the two halves of Longfield was closed on Tuesday after a lorry hit the rail, the fire brigade said.
+ The driver, who is 44, was not hurt. "It was a fright," he said.
- Advertisement
+ When it will open again
+ The town says that one lane should be free by Saturday, while the other has to wait until November.
- Share this article
- Follow us on Twitter
- Sign up to get the weekend newsletter
- Related articles
- Buses change their route in Longfield
- Police seize 14 motorbikes
- © 2020 The Longfield Mail. All rights reserved.

- Inicio | Local | Cultura | Deportes | Entrar
- Este sitio usa cookies para mejorar su visita. Lea nuestra política de privacidad.
- Redacción
+ El puente que une los dos barrios de Campolargo fue cerrado ayer después de que un camión golpeara la baranda, informó la policía.
+ El conductor, de 44 años, salió ileso. "Fue un susto", dijo a los bomberos.
- Publicidad
+ El ayuntamiento promete abrir uno de los carriles antes del sábado, y el otro solo en noviembre.
- Comparte este artículo
- Síguenos en Facebook
- Suscríbete para recibir las noticias
- Noticias relacionadas
- Los autobuses cambian de ruta en Campolargo
- La policía retira 14 motos
- © 2020 El Correo del Valle. Todos los derechos reservados.
"""


def test_held_out_pages_in_three_languages():
    model = boilerplate.default_tree()
    both = found = true = 0
    for page in HELD_OUT.strip().split("\n\n"):
        lines = page.split("\n")
        want = {i for i, x in enumerate(lines, 1) if x[0] == "-"}
        got = set(boilerplate.furniture_numbers("\n".join(x[2:] for x in lines), model))
        both, found, true = both + len(got & want), found + len(got), true + len(want)
    assert both >= 0.9 * true and both >= 0.9 * found, (both, found, true)


def test_blocks_of_any_length_have_all_features():
    model = boilerplate.default_tree()
    menu = " | ".join(["Capa", "Mundo", "Polícia", "Cultura", "Ciência", "Blogs", "Fale conosco", "Loterias"] * 30)
    assert len(menu) > 2000 and boilerplate.furniture_numbers(menu + "\n\nA ponte caiu ontem em Campo Largo, informou a guarda.", model) == [1]
    prose = "A ponte que liga os bairros foi fechada ontem, e a guarda pediu calma aos moradores. " * 200
    assert boilerplate.furniture_numbers(prose, model) == []
    f = boilerplate.page_features([menu])[0]
    at = boilerplate.FEATURES.index
    assert f[at("separators")] > 0.3 and f[at("link_density")] > 0.9


def test_trees_look_at_the_neighbours():
    used = set()

    def walk(t):
        if isinstance(t, tuple):
            used.add(boilerplate.FEATURES[t[0]])
            walk(t[2])
            walk(t[3])

    for t in boilerplate.default_tree():
        walk(t)
    assert {"words_before", "words_after", "links_before", "links_after", "link_density", "words"} <= used
    x, y = boilerplate.labelled_blocks(list(pages(60, seed=99)))  # other pages of the same lines
    assert np.mean([(boilerplate.judge(boilerplate.default_tree(), f) >= 0.5) == bool(v) for f, v in zip(x, y)]) > 0.97


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_no_labelled_line_stands_in_the_test_tables():
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.1"
    texts = [r[0] for r in duckdb.sql(f"SELECT article_content FROM '{d}/gdelt_brazil_events.parquet' UNION ALL SELECT text_content FROM '{d}/g1_articles.parquet'").fetchall() if r[0]]
    lines = {line.strip() for t in texts for line in t.split("\n")}
    short = {"Publicidade", "Erro 404", "Página não encontrada", "Imprimir", "SIGA-NOS"}  # a word or two that any site says
    labelled = {x for k in KINDS.values() for v in k.values() for x in v.split("\n")}
    assert {x for x in labelled & lines if len(x.split()) > 2} <= short
