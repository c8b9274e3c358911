"""Template residue and error-page text: rows whose title or text is left-over machinery, not content.

Templates are induced from the records themselves:

* **aligned slots**: lines are aligned by their skeleton, which keeps the words a template repeats and makes a slot of
  each run of names, numbers and symbols. Where a skeleton's slots are filled in by many lines, the few lines that
  keep a variable's name, a default or nothing in one are residue, whatever the delimiters;
* **repeated pages**: a whole title or text, in whatever words, that stands on several pages of each of several
  sites: under other headlines (a text), over other texts (a title);
* **learnt phrases**: a phrase that stands alone among known ones in whole records, on several sites and far more
  often than next to anything else.

What stands too seldom to be induced is told by seeds: delimiters of template languages with a name, an
expression or nothing between them, defaults that a slot shows (``undefined``, ``[object Object]``), and phrases of
error pages, script notices and filler of which a whole title or text must be a run.

Articles that talk about such things aren't found, as their other words belong to no phrase. Every test sees whole
texts. Defined results: a null or blank title and text are no case; repeated rows are each found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarrafa.functions.url import site
from tarrafa.session import checkpointed, written

#: A variable's name, as templates spell it.
_NAME = r"\$?[\p{L}_][\p{L}\p{M}\p{N}_]*(?:[. ][\p{L}_][\p{L}\p{M}\p{N}_]*){0,3}"
_UPPER = r"\p{Lu}[\p{Lu}\p{M}_]*(?: [\p{Lu}\p{M}_]+){0,3}"
#: Seeds: slots by the delimiters of their template language, with a name, an expression or nothing in them.
SLOTS = [
    r"\{\{\{?[^{}\n]*+\}?\}\}", r"[$#]\{[^{}\n]*+\}", rf"(?<![$#{{])\{{\s*[\p{{L}}\p{{M}}_]+(?:[._-][\p{{L}}\p{{M}}_]+)*\s*\}}", r"\{%[^{}%\n]*+%\}", r"(?<![$#{\p{L}\p{N}])\{\d{1,2}\}",
    r"<%[=-]?[^<>%\n]*+%>", r"<\?(?:php|=)(?:[^?\n]|\?(?!>))*+\?>", rf"<\?\s*(?:echo\s+)?{_NAME};?\s*\?>", rf"\[\[\s*{_NAME}\s*\]\]", r"\[\[\s*\]\]", rf"@@\s*{_NAME}\s*@@", rf"(?<![\d\w%])%[\p{{L}}\p{{M}}_]+(?:[._-][\p{{L}}\p{{M}}_]+)*%(?![\w\p{{L}}])", r"(?<![\p{L}\p{N}%])%[sd](?![\p{L}\p{N}%])",
    rf"__[\p{{Lu}}\p{{M}}]+(?:_[\p{{Lu}}\p{{M}}]+)*__", rf"\[{_UPPER}\]", rf"<{_UPPER}>", rf"(?i:\((?:completar|preencher|inserir|colocar|a definir|definir|escrever|trocar)\s)[\p{{Lu}}_][\p{{Lu}}\p{{M}}_ ]*\)",
    rf"(?<!\p{{Lu}})X{{3,}}\s+{_UPPER}\s+X{{3,}}(?!\p{{Lu}})", rf"\b(?:TODO|FIXME)\s*:?\s+(?i:inserir|completar|preencher|colocar|escrever)\b",
]
#: Defaults that a slot shows when its variable was never set.
DEFAULTS = [r"\[object Object\]", r"\bNaN[:/.]NaN\b", r"\bundefined\b[^.\n]{0,40}\b(?:undefined|null|NaN)\b", r"\b(?:em|por|de|às) (?:undefined|null|NaN)\b", r"\AInvalid Date\z"]

# All repeated groups are possessive: the JVM matches those in a loop, others by recursion, which very long
# filler would overflow. A phrase that begins like another one stands in front of it for that reason.
#: A hex id, or the h that stands for one in a masked text, or a number.
_ID = r"(?:[\da-f]{6,}+|\d+|h)"
# Seeds, that is phrases of error pages, access messages, script notices and filler, as patterns
# over text in any case; a space stands for any run of white space.
ERROR_PHRASES = [
    r"(?:ops|oops|ooops|atenção|desculpe|desculpas|aviso|lo sentimos|sorry|whoops|que pena|puxa)",
    r"(?:(?:http|erro|error|código|code|status)\s*)?\d+",
    r"(?:a )?página não (?:foi )?encontrada", r"(?:a )?página (?:solicitada |que você procura )?não existe(?: mais)?", r"(?:the )?page not found", r"(?:la )?página (?:que buscas )?no (?:existe|encontrada)", r"not found", r"conteúdo não (?:foi )?encontrado", r"não encontrad[oa]",
    r"(?:o )?conteúdo (?:foi )?removido(?: ou expirado)?", r"(?:o )?endereço digitado não existe(?: ou mudou)?", r"não achamos o que você procura", r"não (?:foi possível|conseguimos) (?:encontrar|carregar|abrir|exibir)(?: (?:a página|o conteúdo|esta página|este conteúdo))?",
    r"acesso (?:negado|proibido|restrito)", r"access (?:denied|forbidden)", r"forbidden", r"unauthorized", r"não autorizado", r"you don'?t have permission to (?:access|view) this (?:page|resource)", r"você não tem permissão para (?:ver|acessar) (?:esta|essa|a) página",
    r"muitas requisições(?: deste endereço)?", r"too many requests", r"erro interno(?: do servidor)?", r"internal server error", r"bad gateway", r"bad request", r"gateway time-?out", r"service (?:temporarily )?unavailable", r"serviço (?:temporariamente )?indisponível", r"(?:the )?request timed out", r"tempo (?:de resposta )?esgotado",
    r"(?:o )?banco de dados não respondeu", r"error establishing a database connection", r"erro ao (?:conectar|estabelecer uma conexão)(?: com o| ao)? banco de dados", r"algo deu errado(?: do nosso lado)?", r"something went wrong", r"estamos em manutenção(?: e voltamos logo)?", r"site em manutenção", r"voltamos (?:logo|em breve)",
    r"(?:por favor,? )?(?:tente|tentar) (?:de novo|novamente|outra vez)(?: (?:em alguns (?:minutos|instantes)|mais tarde))?", r"(?:please )?try again(?: later| in a few minutes)?", r"use a busca(?: acima| abaixo| do site)?", r"volte (?:para|à) (?:a )?(?:página inicial|home|capa)", r"(?:ir para|voltar (?:para|à)) (?:a )?(?:página inicial|home|capa)", r"contate o administrador(?: do site)?", r"contact the administrator", r"verifique o endereço(?: digitado)?", r"go back(?: home)?",
    rf"ray(?: id)?:?\s*{_ID}", rf"request[-_\s]?id\s*[=:]?\s*{_ID}", r"servidor-?\s*\d+", r"server-?\s*\d+", rf"refer(?:ência|ence)\s*#?:?\s*{_ID}", rf"incident(?:e)?(?: id)?:?\s*{_ID}", r"ip\s*:?\s*\d+", r"(?:erro fatal|fatal error|http|erro|error)(?:\s*http)?(?:\s*\d+)?",
]
SCRIPT_PHRASES = [
    r"(?:(?:você )?(?:precisa|é preciso|é necessário|deve) (?:ligar|habilitar|ativar|ter)|habilit[ea](?:r)?|ativ[ea](?:r)?|lig(?:ue|ar)|(?:please )?(?:enable|turn on)|you need to enable) (?:o |os |a )?(?:javascript|java script|js|scripts|cookies)(?: do (?:seu )?navegador| in your browser)?",
    r"(?:este|esse|o) (?:aplicativo|site|navegador|portal) (?:requer|exige|precisa de|não executa) (?:javascript|js|scripts)", r"(?:o )?seu navegador não (?:executa|suporta|permite|tem) (?:javascript|js|scripts)", r"(?:this (?:app|site|page) )?requires (?:javascript|js|scripts)", r"javascript (?:is|está) (?:disabled|desativado|desabilitado|required)",
    r"(?:e |and )?(?:recarregue|recarregar|reload)(?: (?:a|esta|the|this) (?:página|page))?", r"(?:e |and )?desative o bloqueador(?: de anúncios)?", r"(?:and )?disable your ad ?blocker", r"(?:para|to) (?:ler (?:a|esta) (?:notícia|matéria|página)|ver (?:a|esta) (?:página|notícia|matéria)|continuar|prosseguir|continue|run this app|view this page|read (?:this|the) (?:article|page))",
    r"loading", r"carregando", r"(?:por favor,? )?aguarde(?: (?:um momento|enquanto (?:checamos|verificamos) (?:o )?seu navegador))?", r"checking (?:your browser|if the site connection is secure)(?: before accessing)?", r"(?:estamos )?verificando (?:se a conexão é segura|(?:o )?seu navegador)", r"(?:prove|confirme|verifique) que você (?:não é um robô|é humano)", r"(?:verify|confirm|prove) (?:that )?you are (?:not a robot|human)", r"não sou um robô", r"just a moment", r"um momento",
]
_LATIN = r"(?:lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat|duis|aute|irure|in|reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|laborum)(?!\p{L})"
_KEYS = r"(?:asdf|asd|qwerty|qwer|qwe|zxcvbnm|zxcv|zxc|teste|test|blá|bla|abc|foobar|foo|bar)"
# A word three times over, however long; with stops or commas between, as speech has them, four times.
_AGAIN = r"(?<w>\p{L}[\p{L}\p{M}]*+)(?:(?:[\s.,]+\k<w>){3,}+|(?: \k<w>){2,}+)(?:[\s.,]*\d+)?"
FILLER_PHRASES = [
    rf"{_LATIN}(?:[\s,;]+{_LATIN}){{2,}}+", r"mussum ipsum", r"mussum fictício latim", r"cacilds[^.!?]{0,60}", r"x{3,}(?:[\s.,]++x{3,})*+(?:[\s.,]*\d+)?", rf"{_KEYS}(?:[\s.,]++{_KEYS})++(?:[\s.,]*\d+)?", r"asdf(?:gh(?:jkl)?)?(?:\s*\d+)?", _AGAIN, r"hello,? world",
    r"sem título", r"título da (?:notícia|matéria|página)", r"título", r"untitled", r"no title", r"(?:nova|new) (?:página|page|notícia|post)", r"rascunho(?: automático)?", r"auto draft",
    r"este é um (?:parágrafo|texto|exemplo) de (?:demonstração|exemplo|teste)(?: do tema| do modelo)?", r"(?:clique|dê um clique) (?:duas vezes|aqui) para editar(?: (?:este|o) (?:bloco|texto))?", r"double.click to edit(?: this (?:block|text))?", r"(?:insira|digite|escreva|cole|coloque) (?:aqui )?(?:o |seu |um )?(?:texto|conteúdo|título|corpo|parágrafo)(?: da (?:notícia|matéria|página)| do (?:post|texto|artigo))?(?: aqui)?",
    r"texto de (?:exemplo|teste|demonstração)(?: do (?:modelo|tema))?", r"substitua (?:este texto )?antes de publicar", r"(?:parágrafo|bloco|texto|linha) \d+", r"texto provisório(?: do (?:diagramador|editor|modelo))?", r"(?:apagar|remover|trocar|substituir|excluir|revisar) (?:depois|antes de publicar)", r"(?:this is )?(?:sample|placeholder|dummy) text", r"conteúdo de (?:exemplo|teste)", r"texto.guia", r"texto (?:falso|fictício)", r"placeholder",
]

#: Nothing behind a preposition.
BLANK = r"(?<!\S)((?:em|por|de|às|na|no|da|do|by|on|at|in|from))(?:[ \t]{2,}+|[ \t]++(?=[.,;:)\n]|\z))"
#: What may fill a slot of an aligned line and isn't content: a name in any delimiters or spelt as an identifier,
#: a printf mark, a default, or a blank.
ODD = "|".join([
    r"(?:\{{1,3}[%#]?|\$\{|<[%?]?=?|\[{1,2}|@@|##|__|~|\^|«)\s*+[$:]?[\p{L}_][\p{L}\p{M}\p{N}_.'\[\]-]*+\s*+(?:[%#]?\}{1,3}|[%?]?>|@@|##|(?<=__)|~|\^|»|(?<=\]))",
    r"(?<![\p{L}\p{N}%])%(?:[sd](?![\p{L}\p{N}%])|[\p{L}_][\p{L}\p{N}_.]*%)", r"\{\d{0,2}\}", r"(?<![\p{L}\p{N}$])\$[\p{L}_][\p{L}\p{N}_]*+", r"(?<![\p{L}\p{N}_@./])\p{L}++(?:_[\p{L}\p{N}]++)++(?![\p{L}\p{N}_@])",
    r"(?<![\p{L}\p{N}])(?:undefined|null|NaN|None|N/A|TBD)(?![\p{L}\p{N}])",
    BLANK,
])
#: What every seed of a slot and every odd filling but blanks holds, besides a letter behind % or $ ...
MARKS = ["{", "<", "[", "@", "#", "_", "~", "^", "«", "XXX", "TODO", "FIXME", "(completar ", "(preencher ", "(inserir ", "(colocar ", "(a definir ", "(definir ", "(escrever ", "(trocar "]
DEFAULT_WORDS = ["undefined", "null", "NaN", "None", "N/A", "TBD", "[object", "Invalid Date"]
#: ... and what a blank slot leaves behind.
GAPS = ["  ", "\t", " .", " ,", " ;", " :", " )", " \n"]
#: Share of a text that mock Latin may leave over.
MOCK_REST = 0.3
_BREAK = r"[\s\p{Z}|:!?.,;/>»›•·…\-–—=_*()\[\]\"“”']"
#: Least records and sites on which a phrase must stand next to known residue, and the share of its records.
MIN_RECORDS, MIN_SITES, MIN_SHARE = 5, 3, 0.9
#: Least pages of a site on which the same whole text must stand, on each of MIN_SITES sites.
MIN_PAGES = 3
#: Largest share of a skeleton's lines that may be odd; where more are, that is how its slot is filled.
MAX_ODD = 0.2


def masked(text: Column) -> Column:
    """Lower case, with hex ids as h and numbers as 0, and white space runs as one space (line feeds kept as |)."""
    t = F.lower(F.regexp_replace(text, r"\s*\n\s*", " | "))
    t = F.regexp_replace(t, r"(?U)[\s\p{Z}]+", " ")
    t = F.regexp_replace(t, r"\b(?=[a-f]*\d)[\da-f]{6,}\b", "h")
    return F.trim(F.regexp_replace(t, r"\d+", "0"))


def _holds(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of some strings: plain searches, many times cheaper than a pattern."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def has_slot(text: Column) -> Column:
    """Seeds of slots and defaults; the patterns run only on texts that hold a character or word they all need."""
    marked = _holds(text, MARKS) | _holds(F.lower(text), [m for m in MARKS if m[0] == "("]) | text.rlike(r"%\p{L}")
    return (marked & text.rlike("|".join(SLOTS))) | (_holds(text, DEFAULT_WORDS) & text.rlike("|".join(DEFAULTS)))


def may_be_odd(text: Column) -> Column:
    """What every text needs that has a seed of a slot or an odd line."""
    gap = (_holds(text, GAPS) | F.endswith(text, F.lit(" "))) & text.rlike(BLANK)
    return _holds(text, [*MARKS, *DEFAULT_WORDS]) | text.rlike(r"[%$]\p{L}") | gap | (F.contains(text, F.lit("(")) & _holds(F.lower(text), [m for m in MARKS if m[0] == "("]))


def _phrases() -> str:
    # A number's last digit must not be left over for another phrase, so that runs stay linear.
    return "|".join(p.replace(r"\d+", r"\d++").replace(" ?", r"[\s\p{Z}]*+").replace(" ", r"[\s\p{Z}]++") for p in [*ERROR_PHRASES, *SCRIPT_PHRASES, *FILLER_PHRASES])


def _known_run() -> str:
    return rf"(?iu)\A{_BREAK}*+(?:(?:{_phrases()})(?![\p{{L}}\p{{N}}]){_BREAK}*+)++\z"


#: Mock Latin: a word, and runs of six or more behind a cheap test for six short words in a row.
_GAP = r"[\s\p{Z},;.]+"
_LATIN_RUN = rf"(?i)\b(?=[a-z]{{2,13}}(?:{_GAP}[a-z]{{2,13}}){{5}}){_LATIN}(?:{_GAP}{_LATIN}){{5,}}+\b"


def whole_residue(text: Column, latin: Column | None = None) -> Column:
    """Whether a text is nothing but a run of known phrases; anchored, so it ends at the first word of an article.

    ``latin`` may say whether the text has a run of mock Latin, if that is known already.
    """
    # Mock Latin that fills a text but for a few words is filler too, whatever those words are.
    latin = text.rlike(_LATIN_RUN) if latin is None else latin
    return text.rlike(_known_run()) | (latin & (F.length(F.regexp_replace(text, _LATIN_RUN, "")) < F.length(text) * MOCK_REST))


def may_be_page(text: Column) -> Column:
    """What every text needs that is a run of known phrases but for one: its first or its second is known."""
    first = r"(?>[^\n]*?(?:\||[.!?:]++(?:\s|\z)|\s[-–—]\s|\n))"
    return text.rlike(rf"(?iu)\A{_BREAK}*+(?:{first}{_BREAK}*+)??(?:{_phrases()})(?![\p{{L}}\p{{N}}])")


def _segments(mask: Column) -> Column:
    parts = F.split(mask, r"\s*\|\s*|(?<=[.!?:])\s+|[.!?:]+\z|\s+[-–—]\s+|(?<=[.!])(?=[.!])")
    return F.transform(F.filter(parts, lambda s: s.rlike(r"\p{L}{2}|0")), lambda s: F.regexp_replace(s, r"[\s.!?:]+\z", ""))


def induced_phrases(records: DataFrame, texts: DataFrame, min_records: int = MIN_RECORDS, min_sites: int = MIN_SITES, min_share: float = MIN_SHARE) -> DataFrame:
    """(_segment): masked phrases, unknown to the lists, of repeated whole-page templates.

    ``records`` has _rec (an id), _site and _mask. A record speaks for its unknown phrase if it has one
    only and all its other phrases, at least one of them more than a bare number, are known. What such
    phrases there are is counted over all ``texts`` (_text); where there are none, those aren't read.
    """
    known = lambda s: s.rlike(_known_run())
    cut = records.select("_site", _segments(F.col("_mask")).alias("_segments"))
    flagged = cut.select("_site", F.transform("_segments", lambda s: F.struct(s.alias("s"), known(s).alias("k"))).alias("_f"))
    unknown = F.filter("_f", lambda x: ~x["k"])
    support = F.exists("_f", lambda x: x["k"] & x["s"].rlike(r"\p{L}{3}"))
    each = flagged.where(support & (F.size(unknown) == 1)).select("_site", unknown[0]["s"].alias("_segment"))
    # Partial counts per site first: a phrase on one hot site stays one row per map task.
    counted = each.groupBy("_segment", "_site").agg(F.count("*").alias("_for")).groupBy("_segment").agg(F.sum("_for").alias("_for"), F.count("*").alias("_sites"))
    likely = written(counted.where((F.col("_for") >= min_records) & (F.col("_sites") >= min_sites)).select("_segment", "_for"))
    if likely.isEmpty():
        return likely.select("_segment")
    every = texts.select(F.explode(_segments(masked(F.col("_text")))).alias("_segment")).join(likely, "_segment")
    return every.groupBy("_segment").agg(F.first("_for").alias("_for"), F.count("*").alias("_n")).where(F.col("_for") >= min_share * F.col("_n")).select("_segment")


def repeated_pages(texts: DataFrame, min_pages: int = MIN_PAGES, min_sites: int = MIN_SITES) -> DataFrame:
    """_key of the records whose whole title or text is a template repeated over pages of several sites.

    ``texts`` has _key, _site, _field, _text and _page, a hash of what tells the record's page from others. Hex ids
    are slots, numbers of less than six digits are not: headlines that differ in a figure are different ones. White
    space and punctuation don't count.
    """
    t = F.col("_text")
    form = F.xxhash64(F.regexp_replace(t, r"[\da-f]{6,}|[^\p{L}\p{M}\p{N}]+", ""))
    # A generator, so that the forms of what has letters are worked out once.
    forms = texts.select("_key", F.xxhash64("_site").alias("_site"), "_field", "_page", F.explode(F.when(t.rlike(r"\p{L}{2}"), F.array(form))).alias("_form"))
    forms = checkpointed(forms)
    per_site = forms.groupBy("_field", "_form", "_site").agg(F.count_distinct("_page").alias("_pages")).where(F.col("_pages") >= min_pages)
    often = per_site.groupBy("_field", "_form").agg(F.count("*").alias("_sites")).where(F.col("_sites") >= min_sites)
    return forms.join(often, ["_field", "_form"], "left_semi").select("_key")


def skeleton(line: Column) -> Column:
    """A line's words in lower case, with a * for each run of tokens that begin with a capital, a digit or a symbol."""
    return F.rtrim(F.regexp_replace(line, r"(?<!\S)(?:[^\p{Ll}\s]\S*+(?:\s++|\z))++", "* "))


def odd_forms(text: Column) -> Column:
    """Hashes of the skeletons of a text's odd lines that have two words at least beside their slots."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(ODD))
    bare = F.transform(lines, lambda x: skeleton(F.regexp_replace(F.regexp_replace(x, ODD, "$1 * "), r"\s+", " ")))
    return F.transform(F.filter(bare, lambda x: F.contains(x, F.lit("*")) & (F.regexp_count(x, F.lit(r"\p{L}+")) >= 2)), lambda x: F.xxhash64(x))


def aligned_slots(odd: DataFrame, texts: DataFrame, min_records: int = MIN_RECORDS, max_odd: float = MAX_ODD) -> DataFrame:
    """_key of the records with an odd line in whose place other lines of its template hold content.

    ``odd`` has _key and _form (``odd_forms``), ``texts`` _text. Only skeletons of odd lines are counted, over the lines
    of all texts; a skeleton needs ``min_records`` lines that aren't odd, and few that are.
    """
    kinds = written(odd.groupBy("_form").agg(F.count("*").alias("_odd")))
    every = texts.select(F.explode(F.split("_text", "\n")).alias("_line")).select(F.xxhash64(skeleton(F.col("_line"))).alias("_form"))
    counts = every.join(kinds.select("_form"), "_form", "left_semi").groupBy("_form").agg(F.count("*").alias("_n"))
    kept = kinds.join(counts, "_form").where((F.col("_n") - F.col("_odd") >= min_records) & (F.col("_odd") <= max_odd * F.col("_n"))).select("_form")
    return odd.join(written(kept), "_form", "left_semi").select("_key")


def residue(df: DataFrame, key: str = "id", title: str = "title", text: str = "article_content", url: str = "sourceurl") -> DataFrame:
    """(key, reason) of each row with residue; reason is 'induced', else 'page' or 'slot' (found by seeds alone).

    One pass over the texts applies the seeds and hands on the few texts that may hold a phrase to be learnt.
    """
    fields = F.array(F.col(title), F.col(text))
    keyed = [F.col(key).alias("_key"), site(F.coalesce(F.col(url), F.lit(""))).alias("_site")]
    base = df.select(*keyed, F.posexplode(fields).alias("_field", "_text"))
    # Generators, not projections and filters: the optimizer would evaluate their patterns once per use.
    t = F.col("_text")
    seen = base.select("_key", "_site", "_field", F.inline(F.array(F.struct(t.alias("_text"), t.rlike(_LATIN_RUN).alias("_latin"), may_be_odd(t).alias("_odd")))))
    none, no_form = F.lit(None).cast("string"), F.lit(None).cast("long")
    one = lambda kind, mask: F.array(F.struct(F.lit(kind).alias("_kind"), mask.alias("_mask"), no_form.alias("_form")))
    seeds = F.when(F.col("_odd") & has_slot(t), one("slot", none)).when(whole_residue(t, F.col("_latin")), one("page", none)).when(F.col("_latin") | may_be_page(t), one("open", masked(t)))
    forms = F.when(F.col("_odd"), F.transform(odd_forms(t), lambda x: F.struct(F.lit("odd").alias("_kind"), none.alias("_mask"), x.alias("_form"))))
    found = F.concat(F.coalesce(seeds, F.array().cast("array<struct<_kind:string,_mask:string,_form:bigint>>")), F.coalesce(forms, F.array().cast("array<struct<_kind:string,_mask:string,_form:bigint>>")))
    some = checkpointed(seen.select("_key", "_site", "_field", F.inline(found)))
    sure = some.where("_kind in ('slot', 'page')").select("_key", F.col("_kind").alias("reason"))

    open_ = some.where("_kind = 'open'").select(F.struct("_key", "_field").alias("_rec"), "_key", "_site", "_mask")
    phrases = induced_phrases(open_, base)
    parts = open_.select("_rec", "_key", F.explode(_segments(F.col("_mask"))).alias("_segment"))
    parts = parts.where(~F.col("_segment").rlike(_known_run()))
    judged = parts.join(phrases.withColumn("_in", F.lit(True)), "_segment", "left").groupBy("_rec", "_key").agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("_all"))
    induced = judged.where("_all").select("_key")
    # A page is told by the other field, a headline without the site's name behind it; where that is blank, by the address.
    filled = lambda c: F.nullif(F.btrim(c), F.lit(""))
    headline = F.regexp_extract(F.col(title), r"^(.*?)(?:\s[|–—-]\s|\z)", 1)
    pages = F.array(*[F.struct(F.col(c).alias("_text"), F.xxhash64(F.coalesce(filled(other), F.col(url))).alias("_page")) for c, other in ((title, F.col(text)), (text, headline))])
    paged = df.select(*keyed, F.posexplode(pages).alias("_field", "_x")).select("_key", "_site", "_field", "_x._text", "_x._page")
    induced = induced.unionByName(repeated_pages(paged)).unionByName(aligned_slots(some.where("_kind = 'odd'").select("_key", "_form"), base))
    return sure.unionByName(induced.select("_key", F.lit("induced").alias("reason"))).groupBy("_key").agg(F.min("reason").alias("reason")).withColumnRenamed("_key", key)
