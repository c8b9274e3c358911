"""Reliable sentence boundaries for fitting: texts by hand in several languages, ``|`` where a sentence ends."""

TEXTS = """
A obra parou em maio.| O prefeito culpa a chuva.| Ninguém respondeu até ontem.
O Dr. Lima e a Sra. Prado moram na Av. Central, nº 12, desde 1998.| A casa fica na esquina da R. das Flores com a Pça. da Sé, s/n.| O aluguel custa R$ 1.200.
O prof. Alves, o eng. Brito e a dra. Souza assinaram o laudo de 2001.| O relatório saiu.
Segundo o art. 12 da lei, a alíquota subiu de 8,1% para 9.4 pontos.| A versão 3.2.1 caiu às 7h07; a 3.2.2 voltou em 13.04.2003.
Ver fls. 12 e segs. do processo.| O lote nº. 86 pesa 2,5 kg, ou seja, 3.1 vezes o de 2014.| O fundo rendeu 0.7 ponto, p. ex., em maio.
J. R. Melo assumiu a Cia. Paulista em 1º de maio.| O contrato é da Alves S.A.| O prazo dele acaba em 1994.
O contrato é da Melo S.A.| O dono dela saiu em 2002.| A dívida é da Brito Ltda.| Ela vence hoje.| A empresa S.A. fechou.
Os E.U.A. compraram 12 sacas.| O Sr. Alves Jr. foi eleito.| Lápis, réguas etc. foram entregues.| Compraram arroz, sal etc.| O resto ficou.
"Ninguém paga isso!" gritou Ana, da plateia.| "Quando abre?", perguntou Davi.| "Daqui ninguém nos tira."| A frase foi aplaudida.
Escreveu a juíza: “Arquive-se.”| São 14 folhas ao todo.| “O túnel abre em junho.| O prazo está mantido”, disse Rita.
(Veja o mapa na pág. 12.)| A obra (que parou!) não voltou.| O vereador (quem diria?) faltou.| (Foi ontem.)| Ninguém viu.
Esperei, esperei... e nada mudou.| O trator quebrou outra vez...| Agora falta dinheiro.| Viva Serra Azul!!!| E viva Rita!
Quem paga a conta de R$ 12.300?!| Ninguém respondeu.| eRua, o aplicativo, saiu do ar.| 1988 foi o ano mais seco.| 17 pessoas saíram.
Custou R$ 3.400.| 2017 foi pior.| Foi em 1992.| A lei mudou em 2003.| "Ninguém avisou", disse Lia.| (Veja a lista.)
Os dados estão em www.casa.example.br/v2.1/base.csv desde maio.| Escreva para ana@casa.example até as 9h.| A sala é a 12.| Sim.
O caso acabou.|Segundo Rita, foi tarde.| Tudo parou.|A chuva voltou.| Era o fim.|"Vamos", disse ela.| Nada mudou!|Ninguém veio.
A seca é de 2009.| J. R. Melo saiu.| Custou R$ 1.016,81.| J. L. Paz llegó.| El gasto fue de $ 874.233.| EE. UU. importó trigo.| Nadie vino.| J. L. Paz tampoco.| Viva Rita!| J. R. Melo saiu.| Quem viu?| A. B. Lima viu.
Pois é...| Talvez amanhã.| Quem sabe…| Acabou tudo.| Hum...| Certo.| I see...| Perhaps tomorrow.| Bueno...| Vamos.
1. Abrir a porta.
2. Fechar a janela.
12. Voltar para casa.
O gen. Souza e o cel. Lima vieram.| A profa. Ana saiu.| O dep. Melo e a sen. Prado faltaram.| O min. Alves voltou.| Sto. Antônio fica na rod. 12.
O séc. 20 acabou.| No cap. 3, o vol. 2 cita a ed. 4.| O tel. 3344 não atende.| Ligue já.| O km. 12 caiu.| Cf. p. 12 e pp. 13 a 15.
The mayor left.| No one knows why.| Dr. Lee and Mrs. Gray live at St. James Square, no. 12.| The U.S. bought 7 tons of coffee.| It rained.
They met at 9 a.m. on Monday.| They left at 9 p.m.| The clerk stayed until dawn.| They came at 10 a.m.| It was cold.
Shares of Gray Ltd.| Trading resumed in London.| Shares of Hill Inc. fell.| He joined Hill Corp.| Sales rose.| Gray Co. grew.
Wait... what happened to him?| Nobody can say.| "Who pays for it?" asked Ann.| "Get out!"| The crowd ran.| "We shall go on.| The date is set," said Bob.
J. K. Gray v. Hill, the case of 1985, is open.| See www.gray.example/a.b.html for the list.| The rate fell from 7.1% to 6.2% in 1999.
John Hill, Jr., paid $9.50.| It rained (a lot!) all day.| Mr. Bo came.| Ms. Fay left.| He lives in the U.S.| She does too.| The U.S. Senate voted.
El Dr. Ruiz y la Sra. Paz viven en la Av. Sol, núm. 12.| La tasa bajó del 5,6 % al 7.8 % en 1962.| ¡Fuera todos!| El lema reunió a 12 vecinos.
EE. UU. importó 12 toneladas.| ¿Quién sabe?| No hay respuesta.| «¿Quién paga?», preguntó Ruiz.| «No damos más tiempo.| El plazo vence en mayo», dijo Paz.
Vendieron leche, queso, miel, etc.| El gasto fue de $ 12.300.| El pág. 12 del informe cita a J. L. Paz.| Llegó la Srta. Luz.| ¿Y ahora?| ¡Vamos!
La compañía S. A. cerró.| Vive en EE. UU.| Su hermana también.| Pregunte por D. Juan.| El art. 3 cambió.| Llovió (¡mucho!) ayer.
Мэрия г. Томска открыла мост.| В 2009 г. урожай вырос на 9.5 %.| Цена 12 млн руб. в мае.| Довольно!| Когда починят?| Ответа нет.
Дождь затронул 9 семей, т. е. 40 человек.| А. Б. Иванов живёт на ул. Мира, д. 5.| «Мы не уйдём.| Срок назначен», сказал Петров.
Это было в 2001 г.| Мэр уехал.| Завод открыли в 1985 г.| Закрыли его позже.| Он родился в 1950 г.| Умер в Туле.| Стоит 5 руб.| Дорого.| И т. д.| Он ушёл.| Проф. Орлов приехал.| См. стр. 12.| Подождите... он идёт.
أعلنت البلدية عن بناء جسر بكلفة 3.5 مليون.| بقي السؤال بلا جواب.| قال د. سامي إن المطر أضر بالناس.| «سنواصل العمل.| الموعد ثابت»، قال نور.
هل سيفتح الطريق؟| بقي السؤال بلا جواب.| شارك الناس في المهرجان!| انخفض الإنتاج بنسبة 2.5٪ في تالاب.| قال أ. نور كلمة.
रास्ता कब बनेगा?| सब चुप रहे।| डॉ. राम ने कहा कि पुल मई में खुलेगा।| “हम नहीं हटेंगे।| समय तय है”, राम ने कहा।| अब बस!| भीड़ घर लौट गई।
गर्मी 12.4 अंश बढ़ी।| श्री. राम आए।| पुल खुलेगा।| सब ठीक है।|रास्ता खुला।
雨で9世帯が避難した。|いつ直るのか？|市長は答えなかった。|「私たちは続ける。|橋は五月に開く」と市長は話した。|「どこへ行くのですか？」と母が聞いた。|やった！|祭りに人が集まった。
株価は2.5％上がった（午前の終値）。|詳しくは www.casa.example/a.html を見てほしい。|「行こう！」という声があった。|「来るな。」|彼は去った。|（写真は市提供。）|雨が降った。
市政府宣布投资3.5亿元。|谁来支付？|大家都沉默。|“我们要继续。|六月能完成。”|居民参加了会议！|他说“等等……再看看”，然后离开了。
老师问：“谁做完了？”|没有人回答。|“走吧！”他说。|详情见 www.casa.example/n.html 的公告。|“为什么？”她问。|增长9%。|“好。”|没有人回答。
o rio subiu.| ninguém saiu de casa.| a aula parou e o dr. lima foi embora.| custou 3.400 reais.| e agora?| nada.
choveu ontem na av. central, nº 12.| a luz caiu às 7h.| voltou às 9h.| o sr. prado, da cia. paulista, não veio.
the shop was shut.| we went home.| mr. hill came at 9 a.m. and left.| it rained.| why?| nobody said.
la tienda cerró.| nos fuimos a casa.| el dr. ruiz llegó tarde.| llovió.| ¿y ahora?| nada.
der zug kam zu spät.| wir gingen heim.| es regnete.| warum?
Er wohnt in der Str. 5.| Sie zog in die Lange Str. 12 um.| Hr. Maier, Fr. Vogt und Dr. Lenz kamen.| Vgl. Abs. 3 und Kap. 4.| Warum?| Es regnet.
Yahoo! Inc. bought a mill.| Shares of Yum! Co. fell.| He works for Jeopardy! Ltd. in York.| Oh no!| Corporate taxes rose.
M. Petit et Mme. Roux sont là.| Il pleut.| Qui vient ?| Personne !| « Partez ! »| La foule court.
Ο δήμαρχος έφυγε.| Πού πάμε;| Κανείς δεν ξέρει.| «Φύγετε!»| Το 2.5% έμεινε.| Τι ώρα είναι;| Βρέχει.
Մենք գնացինք տուն։| Անձրև է։| Ո՞վ եկավ։| Բոլորը լռում են։
မိုးရွာသည်။| ကျွန်တော်တို့ အိမ်ပြန်သည်။|ဘယ်သူလာသလဲ။| လမ်းပိတ်သည်။
ភ្លៀងធ្លាក់។| យើងទៅផ្ទះ។|អ្នកណាមក?| ផ្លូវបិទ៕
ཆར་པ་འབབ།| ང་ཚོ་ནང་ལ་འགྲོ།
ዝናብ ጣለ።| እኛ ቤት ሄድን።|ማን መጣ?| መንገዱ ተዘጋ።
"""
