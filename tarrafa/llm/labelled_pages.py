"""The labelled table for page furniture: lines by hand in three languages, and the rule that puts pages together.

``KINDS`` has lines of articles and of the pages around them, by kind. ``pages`` sets them beside each other as sites
do, so that every line is seen with different neighbours. Names, places and numbers are invented.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Kinds of lines that belong to an article; all others are the page around it.
ARTICLE = ("prose", "decoy", "subhead", "caption", "list_head", "item", "row", "service", "message", "embed")

KINDS: dict[str, dict[str, str]] = {
    "pt": {
        "prose": """A câmara de Pedra Alta aprovou na quarta-feira o novo plano de drenagem, que deve custar R$ 7,2 milhões aos cofres do município.
O produtor Tadeu Moura plantou 30 hectares de sorgo e espera colher em julho, apesar do atraso das chuvas.
"Perdemos quase tudo", contou a comerciante Ivone Dias, que teve a loja invadida pela água durante a madrugada.
Segundo o boletim médico, os quatro feridos passam bem e devem receber alta até o fim da semana.
O consórcio assinou o contrato em 2011, mas a duplicação da rodovia só começou três anos depois.
Ninguém foi preso até agora. A delegada Sônia Reis ouviu nove testemunhas e pediu as imagens das câmeras.
Cerca de 1.400 alunos ficaram sem aula em Vale Manso por causa da greve dos servidores, segundo o sindicato.
A seleção feminina venceu por 3 a 1 e garantiu vaga na final, marcada para domingo, às 16h.
O desemprego caiu para 9,8% no trimestre, o menor nível desde 2008, de acordo com a pesquisa divulgada ontem.
O museu reabriu depois de dois anos de reforma. A entrada é gratuita às terças.
Em 1978, a cidade contava 12 engenhos; hoje restam três, todos na margem esquerda do rio.
Os moradores fecharam a avenida por duas horas em protesto contra o aumento da passagem.
O governo do estado negou o repasse, e a obra do hospital de Rio Fundo ficou sem data para terminar.
Otávio Nunes não quis comentar a decisão. A defesa informou que vai recorrer.
Em 1993, Rio Fundo teve 27 casos da doença.
O prazo vence em agosto.
A medida atinge 310 lojas de Vale Manso.
A empresa não respondeu até o fechamento desta reportagem.
Procurado, o vereador Beto Luz não atendeu as ligações até a última atualização do texto.
PESQUISADORES DA UNIVERSIDADE MEDIRAM A ÁGUA DE 40 POÇOS E ACHARAM FERRO EM 11 DELES, DISSE O GEÓLOGO IVO SALES.""",
        "decoy": """A padaria de Lúcia Prates vende 200 cookies por dia e foi citada numa revista por causa da política de preços baixos.
Todos os direitos dos pescadores serão respeitados, prometeu o ministro durante a visita a Pedra Alta, onde ouviu reclamações sobre a privacidade dos cadastros.
A gráfica vai imprimir 5 mil cartilhas, e a prefeitura pede que cada família compartilhe com os vizinhos o que aprender.
O aplicativo da prefeitura pede que o usuário clique em aceitar antes de seguir, reclamou a vereadora Nair Pontes. Ela quer mudar a lei.
A publicidade nas fachadas divide os comerciantes do centro, que temem multas de até R$ 900. O prazo acaba em junho.
O portal mostrou a mensagem "página não encontrada" por uma hora, contou Ivo Sales, e a assinatura do boletim falhou.""",
        "subhead": """O que dizem os vizinhos
Como funciona o sorteio das casas
Entenda a disputa pela água
Quem tem direito ao abono em Pedra Alta, segundo o secretário
Próxima fase
Histórico de enchentes no vale
A resposta da empresa
Como Ivone Dias recebeu a notícia
Por que Beto Luz desistiu da vaga
Os planos de Nair Pontes para Rio Fundo
Quem é Tadeu Moura
Por que o preço subiu""",
        "caption": """Ivone Dias aponta a marca da água na parede da loja, em foto de 2009
Manifestantes na avenida central, à direita o vereador Beto Luz
Fachada do museu depois da reforma, em Vale Manso
Otávio Nunes, ao centro, durante a sessão de terça""",
        "list_head": """Veja quem passou para a segunda etapa em Vale Manso:
Confira os horários divulgados pela secretaria de transportes:
Estes são os vencedores anunciados por Beto Luz:""",
        "item": """• Lauro Pinto, Rio Fundo, 2.310 votos
- Celeste Braga, Pedra Alta, 87 pontos
* Nair Pontes, Vale Manso, 1.045 pontos
– Tadeu Moura, Rio Fundo, 64 pontos
Odila Ramos, Vale Manso, 918 votos""",
        "row": """Vila Nova	8.210	4.118,70	31,2
Centro 14 22.904 61,8
Barro Preto	312	97,5	3,3""",
        "service": """Serviço: a feira do livro abre das 9h às 18h na praça da matriz, até 22 de maio.
As inscrições vão até 14 de agosto na secretaria de cultura de Rio Fundo.
A campanha recebe roupas e alimentos na sede dos bombeiros, de segunda a sexta.""",
        "message": """Erro 503
Página não encontrada
Ative o JavaScript para continuar
Lorem ipsum dolor sit amet elit
Conteúdo de exemplo""",
        "menu": """Capa | Mundo | Saúde | Fotos | Entrar
Cidade  Cultura  Ciência  Blogs  Vídeos
Home › Economia › Agro › Opinião
Polícia • Tempo • Trânsito • Empregos • Colunas
MAPA DO SITE | QUEM SOMOS | ANUNCIE
Educação / Tecnologia / Esporte / Podcasts / Loterias / Concursos / Cultura / Brasil / Mundo""",
        "crumbs": """Capa > Saúde > Posto de Vale Manso recebe 12 médicos
Home / Polícia / Dupla é detida com 8 celulares em Rio Fundo
Início » Esporte » Pedra Alta vira o jogo e leva a taça
Início > Caderno de domingo > Juíza anula leilão de terreno em Vale Manso
Capa > Edição do dia > Beto Luz deixa a chefia da guarda em Rio Fundo
Home > Colunas > Time de Pedra Alta ganha e Lauro Pinto sai machucado""",
        "consent": """Usamos cookies e ferramentas semelhantes para lembrar de você e mostrar anúncios. Aceito | Configurar
A sua privacidade importa para nós. Ao navegar, você aceita o uso de cookies e a nossa política de dados.
Precisamos do seu consentimento para guardar dados de navegação neste aparelho. Recusar | Aceitar tudo
NÓS E 40 PARCEIROS COLETAMOS DADOS PARA PERSONALIZAR SUA VISITA. ENTENDA NA POLÍTICA DE PRIVACIDADE.
Concordo com os cookies
A gente usa cookies para saber quem volta e o que cada um lê. Tudo bem para você?
Com a sua permissão, nossos parceiros e nós lemos dados do seu celular a fim de escolher a propaganda que aparece. Mudar de ideia é possível a qualquer hora nas configurações.
Para oferecer uma experiência melhor, este portal guarda cookies no navegador e aprende com o seu uso. Leia a política de privacidade.
Respeitamos a sua privacidade e só coletamos o necessário para manter o portal no ar. Veja a política de dados. Entendi
Nossas páginas gravam cookies para que a sua próxima visita seja mais rápida. Quem segue navegando concorda com isso.
Nós e outras 12 empresas gravamos informações no seu computador para conhecer a audiência. Saiba como na política de dados.
Para lembrar as suas escolhas, coletamos dados sobre a sua visita. Se continuar aqui, você concorda.
A sua privacidade vale muito: usamos dados e cookies para manter a sua sessão aberta. Gerir opções
Damos valor aos seus dados e os usamos para medir o que interessa a você. Saiba mais | Aceitar
Ajude a melhorar o portal: permita que a gente conte as suas visitas sem guardar o seu nome. Permitir | Agora não""",
        "prompt": """Compartilhe no zap
Compartilhar: Tadeu Moura planta 30 hectares de sorgo em Pedra Alta
Siga o Diário da Serra nas redes
Curta a nossa página
Receba o resumo da manhã no seu e-mail
Assine e leia sem anúncios — primeiro mês grátis
Cadastre o seu e-mail para receber alertas de Diário da Serra
Baixe o nosso aplicativo
Entre no grupo do Diário da Serra no mensageiro
Gostou? Envie para os amigos
Imprimir esta página ↗
Copiar o link
Ouvir a notícia: "Museu reabre depois de dois anos"
Salvar nos favoritos
Escute esta reportagem
Ouça o texto
Guarde para ler mais tarde
Ligue as notificações
Deixe o seu comentário
SIGA A GENTE""",
        "legal": """© 2014 Diário da Serra. Todos os direitos reservados.
Copyright Rádio Vale Manso Ltda. Reprodução proibida sem autorização.
É vedada a cópia total ou parcial deste conteúdo. Diário da Serra, Pedra Alta.
As opiniões dos colunistas não refletem a do jornal.
Os comentários são de responsabilidade de quem os escreve. Diário da Serra.
Conteúdo protegido por direito autoral. Diário da Serra, Pedra Alta.
Termos de uso e política de privacidade
Este texto não pode ser redistribuído. Rádio Vale Manso.
Esta reportagem não pode ser copiada nem redistribuída. Diário da Serra, Pedra Alta.
Nenhuma parte desta página pode ser publicada em outro lugar sem autorização da Rádio Vale Manso.""",
        "byline": """Por Redação, Diário da Serra
Da redação — Diário da Serra
Da Redação Diário da Serra, Pedra Alta
Equipe de reportagem do Diário da Serra
Plantão de notícias Diário da Serra
Redação e agências, Pedra Alta
Do correspondente em Rio Fundo — Diário da Serra""",
        "ads": """Publicidade
Anúncio · 9b27f04c1e
Continua depois da publicidade
Conteúdo patrocinado
PUBLICIDADE · anúncio 40ad77c9""",
        "tags": """Tags: vale manso, chuva, defesa civil
Assuntos: museu, cultura, ivo sales
Tópicos: greve, escolas, rio fundo""",
        "counters": """Atualizado há 40 min · 7 mil leituras
Publicado às 9h12 · atualizado há 2 horas · 3c90de12aa
31 comentários
88 comentários em: Preço do gás sobe 6% e motoristas de Rio Fundo reclamam
Lido 12 mil vezes · 5 min de leitura""",
        "address": """Diário da Serra | Rua das Palmeiras, 410, Pedra Alta | Fale conosco
Rádio Vale Manso | Av. Brasil, 77 | Trabalhe conosco
Diário da Serra | Praça da Matriz, 3, Rio Fundo | Anuncie aqui""",
        "pointer": """LEIA MAIS: Granizo destelha 60 casas em Vale Manso
Leia também: Prefeito de Rio Fundo troca três secretários
Veja mais: Cooperativa exporta 900 caixas de uva
Anterior: Ponte de Pedra Alta é interditada por 20 dias
Próxima: Cão perdido volta para casa depois de 4 meses
Saiba mais em nosso site""",
        "links_head": """Mais lidas em Pedra Alta às 8h40 [7d10c2]
Leia também
Veja mais em Vale Manso às 21h05 [c04e19]
Últimas de Rio Fundo às 6h33 [40b2aa]
Relacionadas em Vale Manso (2e7715)
Notícias relacionadas
MAIS VISTAS""",
        "link": """Granizo destelha 60 casas em Vale Manso
Justiça manda soltar dono de padaria em Rio Fundo
Cooperativa de Pedra Alta exporta 900 caixas de uva
Rio Fundo abre 31 vagas para motoristas
Preço do gás sobe 6% e motoristas reclamam
Festa da colheita reúne 4 mil em Pedra Alta
Ponte sobre o rio Manso fica pronta e recebe 2 mil carros por dia
Time de Rio Fundo empata e Beto Luz é expulso
Nair Pontes deixa a pasta de transportes em Vale Manso
Posto de Pedra Alta ganha 12 médicos
Colheita de 2016 chega a 40 toneladas em Rio Fundo""",
    },
    "en": {
        "prose": """The county council approved a new flood plan on Monday, and work on the lower bank should begin before the autumn rains.
"We lost the whole crop," said farmer Tom Hale, whose fields near Ashby were under water for six days.
Police questioned two men after the fire, but nobody has been charged. The owner was away at the time.
Unemployment fell to 4.1% in the quarter, the lowest figure since 2007, according to a report published last week.
The museum will open again in March after a repair that cost $2.4 million, its director told reporters.
In 1964 the village had nine mills; three are left, and all of them stand on the left side of the river.
In 1987 Milton saw 14 such cases.
The deadline is May 3.
The company had not replied by the time this report was published.
She declined to comment on the ruling, and her lawyer said that they would appeal.
About 800 pupils stayed at home during the strike, the union said. Classes start again on Thursday.""",
        "decoy": """The bakery sells two hundred cookies a day, and its owner says that a strict privacy rule keeps the recipe safe.
All rights of the fishermen will be reserved for their children, the minister promised when he came to Ashby. They cheered.
He asked readers to share the bread with a neighbour and to subscribe to nothing, which made the crowd laugh.""",
        "subhead": """What the neighbours say
How the draw works
Why prices went up
How Ann Reed heard of it
What Paul Cole wants for Ashby
The next step""",
        "caption": """Tom Hale shows the mark that the water left on his barn, in a photo of 1998
Members of the council during the vote, Ann Reed on the left""",
        "list_head": """These are the winners named by Ann Reed:
The following roads will be closed, the county said:""",
        "item": """• Ann Reed, Ashby, 1,204 votes
- Paul Cole, Milton, 97 points
Jane Webb, Ashby, 388 points""",
        "row": """North Ward	1,204	33.1	7.8
Old Town 12 4,018 21.0""",
        "service": """The fair is open from 9 a.m. to 6 p.m. on the market square until May 22.
Donations are taken at the fire station in Ashby, Monday to Friday.""",
        "message": """404 Not Found
Access denied
Please enable JavaScript""",
        "menu": """Home | World | Sports | Weather | Sign in
Politics  Business  Health  Opinion  Video
Home > Travel > Food > Science""",
        "crumbs": """Home > Health > Clinic in Milton hires 12 doctors
News / Crime / Two held with 8 stolen phones in Ashby
Home > Sunday edition > Judge cancels land sale in Milton""",
        "consent": """We use cookies and similar tools to remember you and to show ads. Accept all | Manage options
Your privacy matters to us. By continuing you agree to our use of cookies and to our privacy policy.
We and our partners store data on your device to measure our audience. Reject | Accept
To make your next visit faster, this site keeps cookies in your browser and learns from how you use it. See our privacy policy.
With your permission we may read data from your phone to pick the ads that you see. You can change your mind at any time.
We value your privacy and collect only what we need to keep the site running. Got it""",
        "prompt": """Share this story
Follow us on social media
Sign up for our daily newsletter
Subscribe now and read without limits
Download our app
Print this page
Copy link
Save for later
Get the morning briefing in your inbox
Tell us what you think in the comments
Like our page""",
        "legal": """© 2016 The Ashby Post. All rights reserved.
Copyright Milton Media Ltd. This material may not be published or redistributed without permission.
The views of our columnists are their own.
Terms of use and privacy policy""",
        "byline": """By staff reporters, The Ashby Post
From our correspondent in Milton
The Ashby Post newsroom""",
        "ads": """Advertisement
Sponsored content
Story continues below advertisement""",
        "tags": """Tags: ashby, floods, county council
Topics: museum, culture""",
        "counters": """Updated 12 minutes ago · 4 min read
57 comments
Posted at 9:12 · 8 thousand views""",
        "address": """The Ashby Post | 14 Mill Road, Ashby | Contact us
Milton Media | 3 High Street | Advertise with us""",
        "pointer": """READ MORE: Hail damages 60 homes in Milton
See also: Mayor of Ashby replaces three officials
Previous: Bridge closed for 20 days
Next: Lost dog comes home after four months""",
        "links_head": """Most read in Ashby
Related stories
You may also like
Latest news""",
        "link": """Hail damages 60 homes in Milton
Court frees bakery owner in Ashby
Farmers ship 900 boxes of grapes
Ashby hires 31 drivers
Harvest fair draws 4,000 to Milton""",
    },
    "es": {
        "prose": """El ayuntamiento de Peñalba aprobó el miércoles el nuevo plan de riego, que costará 7,2 millones a las arcas municipales.
"Lo perdimos casi todo", contó la tendera Inés Vidal, que vio entrar el agua en su local de madrugada.
Nadie ha sido detenido. La comisaria oyó a nueve testigos y pidió las grabaciones de las cámaras.
El paro bajó al 9,8 % en el trimestre, el nivel más bajo desde 2008, según la encuesta publicada ayer.
El museo volvió a abrir tras dos años de obras. La entrada es gratuita los martes.
Unos 1.400 alumnos se quedaron sin clase en Valmanso por la huelga, según el sindicato.
En 1978 el pueblo tenía doce molinos; hoy quedan tres, todos en la orilla izquierda del río.""",
        "decoy": """La panadería vende doscientas cookies al día y fue citada en una revista por su política de precios bajos.
El ministro dijo que todos los derechos de los pescadores quedan reservados en la nueva ley, y los vecinos aplaudieron.""",
        "subhead": """Qué dicen los vecinos
Cómo funciona el sorteo
Por qué subió el precio
Cómo lo supo Inés Vidal
Qué quiere Luis Mora para Riohondo
La respuesta de la empresa""",
        "caption": """Inés Vidal señala la marca del agua en la pared de su tienda, en una foto de 2009
Vecinos en la avenida central, a la derecha el concejal Luis Mora""",
        "list_head": """Estos son los ganadores que anunció Luis Mora:
Consulte los horarios difundidos por la consejería:""",
        "item": """• Laura Pinto, Riohondo, 2.310 votos
- Celia Braga, Peñalba, 87 puntos
Tadeo Mora, Valmanso, 1.045 puntos""",
        "row": """Villanueva	8.210	4.118,70	31,2
Centro 14 22.904 61,8""",
        "service": """La feria del libro abre de 9 a 18 en la plaza mayor, hasta el 22 de mayo.
Las inscripciones terminan el 14 de agosto en la consejería de cultura.""",
        "message": """Error 404
Página no encontrada
Active JavaScript para continuar""",
        "menu": """Inicio | Mundo | Salud | Fotos | Entrar
Deportes  Cultura  Ciencia  Vídeos
Portada › Economía › Opinión""",
        "crumbs": """Inicio > Salud > El centro de Valmanso recibe 12 médicos
Portada / Sucesos / Detenidos dos jóvenes con 8 móviles en Riohondo""",
        "consent": """Usamos cookies y herramientas parecidas para recordarle y mostrar anuncios. Acepto | Configurar
Su privacidad nos importa. Si sigue navegando, acepta el uso de cookies y nuestra política de datos.
Para que su próxima visita sea más rápida, este sitio guarda cookies en su navegador. Lea la política de privacidad.
Con su permiso, nuestros socios y nosotros leemos datos de su teléfono para elegir la publicidad que usted ve.""",
        "prompt": """Comparte esta noticia
Síguenos en las redes
Suscríbete a nuestro boletín
Descarga la aplicación
Imprimir
Copiar enlace
Recibe las noticias en tu correo
Guardar para después
Deja tu comentario""",
        "legal": """© 2014 Diario de la Sierra. Todos los derechos reservados.
Prohibida la reproducción total o parcial de este contenido sin autorización.
Las opiniones de los autores no reflejan las del diario.
Aviso legal y política de privacidad""",
        "byline": """Por la redacción, Diario de la Sierra
Redacción y agencias — Peñalba
De nuestro corresponsal en Riohondo""",
        "ads": """Publicidad
Contenido patrocinado
Sigue después de la publicidad""",
        "tags": """Etiquetas: valmanso, lluvia, bomberos
Temas: museo, cultura""",
        "counters": """Actualizado hace 40 min · 7 mil lecturas
31 comentarios""",
        "address": """Diario de la Sierra | Calle de las Palmas, 410, Peñalba | Contacto
Radio Valmanso | Av. del Sol, 77 | Trabaja con nosotros""",
        "pointer": """LEA MÁS: El granizo daña 60 casas en Valmanso
Lea también: El alcalde de Riohondo cambia a tres concejales
Anterior: Cierran por 20 días el puente de Peñalba
Siguiente: Un perro perdido vuelve a casa tras cuatro meses""",
        "links_head": """Lo más leído en Peñalba
Noticias relacionadas
Te puede interesar
Últimas noticias""",
        "link": """El granizo daña 60 casas en Valmanso
La justicia libera al dueño de una panadería
Riohondo abre 31 plazas de conductor
La fiesta de la vendimia reúne a 4 mil vecinos""",
    },
}


def pages(count: int = 960, seed: int = 7) -> Iterator[list[tuple[str, bool]]]:
    """Pages of (line, whether it is furniture): what stands above an article, the article with what interrupts it, what follows."""
    rnd = random.Random(seed)
    for n in range(count):
        kinds = {k: v.split("\n") for k, v in KINDS[("pt", "pt", "en", "es")[n % 4]].items()}
        page: list[tuple[str, bool]] = []

        def put(kind: str, times: int = 1, kinds=kinds, page=page) -> None:
            bullet = rnd.choice(["", "", "• ", "> ", "- "]) if kind == "link" else ""
            if kind == "embed":  # what is left of pictures and frames
                letters = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789/+-_=", k=rnd.randint(40, 400)))
                page.append((rnd.choice(["", "data:image/gif;base64,", "https://img.serra.test/"]) + letters, False))
                return
            for i, line in enumerate(rnd.sample(kinds[kind], min(times, len(kinds[kind])))):
                if kind in ("prose", "decoy"):  # paragraphs of one to four sentences or so
                    body = [line, *rnd.choices(kinds["prose"], k=rnd.choice([0, 0, 1, 1, 2, 3, 9, 40]))]
                    rnd.shuffle(body)
                    line = " ".join(body)
                if kind == "prompt" and ":" not in line and rnd.random() < 0.5:  # prompts that name the page or the site
                    name = kinds["legal"][0].partition(".")[0].partition(" ")[2].partition(" ")[2]
                    line += rnd.choice([f': "{rnd.choice(kinds["link"])}"', f" — {name}", f" {name}", f': {rnd.choice(kinds["link"])}'])
                if rnd.random() < 0.06:
                    line = line.upper()
                if rnd.random() < 0.1:  # uneven spacing
                    line = "".join(c + c if c == " " and rnd.random() < 0.1 else c for c in line)
                mark = f"{i + 1}{'.º)'[n % 3]} " if kind == "link" and n % 5 == 0 else bullet
                page.append((mark + line, kind not in ARTICLE))

        def links(page=page) -> None:
            put("links_head")
            put("link", rnd.randint(2, 5))

        if n % 12 == 11:
            put("message", 3)
            yield page
            continue
        for kind in rnd.sample(["menu", "crumbs", "consent", "byline", "counters", "ads", "prompt", "address", "legal"], rnd.randint(0, 4)):
            put(kind)
        for _ in range(rnd.randint(2, 6)):
            for kind in rnd.choices(["prose", "subhead", "caption", "list", "row", "service", "decoy", "embed"], [10, 2, 2, 2, 1, 1, 3, 0.3], k=rnd.randint(1, 3)):
                if kind == "list":
                    put("list_head")
                put({"list": "item"}.get(kind, kind), {"prose": 2, "list": 3, "row": 2}.get(kind, 1))
            if rnd.random() < 0.5:
                rnd.choice([lambda: put("prompt", rnd.randint(1, 3)), lambda: put("pointer"), lambda: put("ads"), links, lambda: put("tags")])()
        for kind in rnd.sample(["prompt", "tags", "legal", "links", "menu", "counters", "pointer", "address", "consent", "byline", "ads", "crumbs"], rnd.randint(1, 7)):
            links() if kind == "links" else put(kind, 2 if kind in ("prompt", "legal") else 1)
        yield page
