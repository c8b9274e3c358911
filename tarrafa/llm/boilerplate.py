"""Page boilerplate: lines of the page around the article, told from the article's own lines.

Each text is a flat list of blocks (its non-blank lines). A block is described by its word count, its link
density and what else the text alone shows, and by the word counts, densities and ends of its neighbours; a
decision tree trained on a small labelled table (``labelled_pages``) judges it. As the texts hold no markup
any more, link density is the share of a block's words that stand in anchor-like parts: few words between
separators, without a full stop. Beside it stand the share of small words (menus and names have few), capitals, and
words that sites use around articles in three languages.

One Arrow pass per table and no shuffle; the tree is fitted on the driver in about a second and
travels in the task closure (a few hundred numbers). Blocks of any length have all features. Defined results: null
and empty texts have no blocks; blank lines are none; lines of error pages, script notices and filler count as
article, as other operators look for them; repeated rows are each judged.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarrafa.llm.labelled_pages import pages
from tarrafa.llm.residue import DEFAULTS, ERROR_PHRASES, FILLER_PHRASES, SCRIPT_PHRASES, SLOTS

# Words that sites use around an article, in lower case and three languages (endings left open); found
# by one Aho-Corasick automaton.
CUES = [
    "cookie", "privacidad", "privacy", "parceiros", "our partners", "consent", "concordo", "aceito", "aceit", "accept", "acepto", "you agree", "você concorda", "personaliz", "dados de navegação", "your device", "no seu aparelho", "gerir opções", "configurar", "manage options", "recusar", "reject", "política de dados", "política de datos", "audiência", "audience", "ao continuar", "lembrar suas",
    "compartilh", "comparte", "compartir", "share th", "envie ", "mande para", "siga ", "siga-", "síguenos", "follow us", "curta ", "like our", "assine", "assinant", "suscr", "subscri", "sign up", "cadastre", "inscreva", "receba", "recibe ", "get the ", "boletim", "boletín", "newsletter", "notificações", "notifications", "alertas", "baixe", "descarga", "download", "aplicativo", "our app", "grupo do", "nosso canal", "no canal", "no grupo", "mensageiro", "whatsapp", "telegram", "facebook", "redes", "social media", "imprimir", "print this", "copiar", "copy link", "enlace", "o link", "salvar ", "guardar ", "save for", "favoritos", "ouça", "ouvir a", "listen to", "grátis", "gratis", "sem limites", "without limits", "e-mail", "correo", "correio eletrônico", "inbox", "deixe o", "deja tu", "gostou", "tell us",
    "©", "copyright", "direitos reservados", "derechos reservados", "rights reserved", "direito autoral", "direitos autorais", "reprodução", "reproducción", "proibida", "prohibida", "vedada", "redistribu", "may not be", "autorização", "autorización", "permission", "termos de uso", "terms of use", "aviso legal", "as opiniões", "las opiniones", "the views of", "não reflete", "no reflejan", "de responsabilidade", "conteúdo protegido",
    "publicidad", "advertis", "anúncio", "anuncie", "patrocinad", "sponsored", "atualizado há", "actualizado hace", "updated ", "acessos", "leituras", "lecturas", "views", "min read", "comentários", "comentarios", "comments", "tags:", "assuntos:", "tópicos:", "topics:", "etiquetas:", "temas:",
    "leia mais", "leia também", "lea más", "lea también", "read more", "see also", "veja mais", "veja também", "saiba mais", "mais lid", "mais vist", "más leído", "most read", "últimas", "latest news", "relacionad", "related stor", "you may also", "te puede", "anterior:", "próxima:", "próximo:", "siguiente:", "previous:", "next:",
    "redação", "redacción", "newsroom", "equipe de", "staff report", "plantão", "correspondente em", "corresponsal", "correspondent in", "por redação", "fale conosco", "contact us", "contacto", "trabalhe", "trabaja con", "atendimento ao", "| rua", "| av", "| praça", "| calle", "mapa do site", "quem somos",
]
# Small words of prose, in the same languages.
SMALL = set("o a os as um uma de do da dos das em no na nos nas ao à aos às por pelo pela para com sem que se e ou mas não foi é são era ser está como mais até entre sobre depois segundo disse ele ela seu sua the of to in on at for by with and or but that is was were be has had he she it they his her from after said el la los las un una del al en con sin para por que se y o pero no fue es son era según su sus tras".split())
# Words by which a site speaks to its visitors.
ADDRESS = set("você vocês nós nosso nossa nossos nossas usamos coletamos gente we our us you your nosotros nuestro nuestra nuestros nuestras usted ustedes tu tus te".split())
# Names of sections and pages that menus link to.
SECTIONS = set("início inicio home capa portada política politica politics economia economía business esporte esportes deportes sports cidade cidades saúde salud health educação cultura culture ciência ciencia science tecnologia technology agro mundo world brasil opinião opinión opinion blog blogs coluna colunas vídeo vídeos video videos fotos photos podcast podcasts classificados emprego empregos loterias tempo weather trânsito travel food expediente assine entrar login anuncie contato contacto contact polícia crime sucesos entretenimento concursos news".split())


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for cue in CUES:
        a.add_word(cue, len(cue))
    a.make_automaton()
    return a


_SEPARATOR = re.compile(r"\s[|•›»·>/–—-]\s|\s{2,}|↗|→")
_MARKS = set("| • › » · > / – — - ↗ →".split())
_HEADING = re.compile(r"^(?:leia (?:mais|tamb[ée]m)|veja (?:mais|tamb[ée]m)|mais lidas|mais vistas|[úu]ltimas|relacionad[ao]s|(?:not[íi]cias )?relacionadas|destaques|recomendad[ao]s|em alta|lo m[áa]s le[íi]do|te puede interesar|most read|related (?:stories|news|articles)|you may also like|latest (?:news|stories)|read (?:more|also)|trending|see also)\b(?!\s*:\s*\S)", re.I)
_BULLET = re.compile(r"^\s*(?:[•·*>›»▪–—-]|\d{1,3}[.)ºª°])\s*")
_HEX = re.compile(r"\b(?=[a-f]*\d|[a-f]{6}\b)[0-9a-f]{6,}\b")
_SUBHEAD = re.compile(r"^(?:o que|como|por que|quem|quando|onde|entenda|hist[óo]ric[oa]|pr[óo]xim[ao]s? (?:fase|passo)s?|a (?:vers[ãa]o|resposta)|veja (?:os|as|quem|o que)|confira|servi[çc]o\b|saiba (?:como|o que|quem)|what|how|why|who|qu[ée] |c[óo]mo|por qu[ée])")
_STOP = re.compile(r"[.!?…;:][\"”’'»)\]]*$")
_TRIM = "\"'“”‘’«»()[]¿¡.,;:!?…"

FEATURES = [
    "words", "chars", "cues", "cue_density", "link_density", "separators", "stop", "bullet", "hex", "upper", "small_words", "titles", "link_list", "subhead", "heading", "tabs", "digits", "before_cue", "sections", "commas", "address", "before_colon",
    "words_before", "words_after", "links_before", "links_after", "cues_before", "cues_after", "stop_before", "stop_after", "list_before", "list_after",
]
_OWN = FEATURES.index("words_before")
_AT = {name: i for i, name in enumerate(FEATURES)}
#: Most words of a part between separators that looks like an anchor.
ANCHOR_WORDS = 6
#: Trees that vote.
TREES = 15
#: Blocks up to this many characters recur, so that their features are kept; it changes nothing else.
KEPT = 240


def _block(line: str) -> tuple:
    """Features of one block by itself, its bullet and whether it heads a list of links."""
    return _kept_block(line) if len(line) <= KEPT else _make_block(line)


_DIGITS, _CAPITALS = b"0123456789", bytes(i for i in range(256) if chr(i).isupper())


def _counts(line: str) -> tuple[int, int]:
    """Digits and capitals of a line; by bytes where each character is one."""
    try:
        b = line.encode("latin-1")
    except UnicodeEncodeError:
        return sum(map(str.isdecimal, line)), sum(map(str.isupper, line))
    return len(b) - len(b.translate(None, _DIGITS)), len(b) - len(b.translate(None, _CAPITALS))


def _make_block(line: str) -> tuple:
    parts = line.split()
    n, size = len(parts) - sum(map(_MARKS.__contains__, parts)), len(line)
    w = max(n, 1)
    low = " ".join(parts).lower()
    cues = cue_chars = end = 0
    first = None
    for at, length in _automaton().iter(low):
        begin = at - length + 1
        if begin > 0 and low[begin - 1].isalpha():  # within a word
            continue
        cues += 1
        if first is None:
            first = begin
        if begin >= end:  # overlapping cues count once for the density
            cue_chars += length
            end = at + 1
    words = [w.strip(_TRIM) for w in low.split(" ")]
    small = sum(map(SMALL.__contains__, words))
    sections = sum(map(SECTIONS.__contains__, words))
    titles = sum([p[:1].isupper() for p in parts])
    separators = len(_SEPARATOR.findall(line))
    digits, capitals = _counts(line)
    stop = 1 if _STOP.search(line[-6:]) else 0
    anchors = 0
    if separators:
        for part in _SEPARATOR.split(line):
            k = len(part.split())
            anchors += k if k <= ANCHOR_WORDS and not part.rstrip().endswith((".", "!", "?")) else 0
    elif n <= ANCHOR_WORDS and not stop:
        anchors = n
    m = _BULLET.match(line)
    bullet = m.group().strip()[-1:] if m else ""
    heading = n < 16 and bool(_HEADING.match(low))
    subhead = 1 if _SUBHEAD.match(low) or "foto" in low or "photo" in low else 0
    hexes = 1 if digits and _HEX.search(low) else 0
    upper = capitals / max(size, 1)
    before_cue = n if first is None else low.count(" ", 0, first)
    own = (n, size, cues, min(1.0, cue_chars / max(len(low), 1)), anchors / w, separators / w, stop, 1 if bullet else 0, hexes, upper, small / w, titles / w, 0, subhead, int(heading), line.count("\t"), digits / max(size, 1), before_cue, sections / w, line.count(", "), sum(map(ADDRESS.__contains__, words)), low.count(" ", 0, low.find(":")) + 1 if ":" in low else n)
    return own, bullet, heading


_kept_block = functools.lru_cache(maxsize=50_000)(_make_block)


_NONE = (0,) * _OWN


def page_features(lines: list[str]) -> list[list[float]]:
    """The features of a page's non-blank lines; a list of links runs on while its entries look alike."""
    blocks = [_block(x) for x in lines]
    listed, kind = [], None
    for own, bullet, heading in blocks:
        entry = not own[_AT["stop"]] and own[0] < 20 and not own[_AT["cues"]] and own[_AT["digits"]] < 0.25 and not own[_AT["subhead"]] and own[_AT["commas"]] < 2
        if heading:
            kind = "any"
        elif kind is not None and entry and kind in ("any", bullet):
            kind = bullet
            listed.append(1)
            continue
        else:
            kind = None
        listed.append(0)
    rows = []
    for i, (own, _, _) in enumerate(blocks):
        before = blocks[i - 1][0] if i else _NONE
        after = blocks[i + 1][0] if i + 1 < len(blocks) else _NONE
        f = list(own)
        f[_AT["link_list"]] = listed[i]
        f += [before[0], after[0], before[4], after[4], before[2], after[2], before[6], after[6], listed[i - 1] if i else 0, listed[i + 1] if i + 1 < len(blocks) else 0]
        rows.append(f)
    return rows


def labelled_blocks(table=None) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page in pages() if table is None else table:
        x += page_features([line for line, _ in page])
        y += [furniture for _, furniture in page]
    return np.array(x, dtype=float), np.array(y, dtype=float)


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 14, leaf: int = 2) -> tuple | float:
    """A binary decision tree by Gini impurity: (feature, threshold, left, right) or a leaf's share of furniture."""
    p = y.mean()
    if depth == 0 or len(y) < 2 * leaf or p in (0, 1):
        return float(p)
    best = (p * (1 - p) * len(y) - 1e-9, None, None)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], y[order]
        ones, n = np.cumsum(t), np.arange(1, len(t) + 1)
        cut = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= leaf) & (len(t) - n[:-1] >= leaf))
        if len(cut):
            a, m = ones[cut], n[cut]
            b, k = ones[-1] - a, len(t) - m
            impurity = a * (1 - a / m) + b * (1 - b / k)
            i = int(np.argmin(impurity))
            if impurity[i] < best[0]:
                best = (float(impurity[i]), j, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if best[1] is None:
        return float(p)
    under = x[:, best[1]] <= best[2]
    return (best[1], best[2], fit_tree(x[under], y[under], depth - 1, leaf), fit_tree(x[~under], y[~under], depth - 1, leaf))


def judge(model, f) -> float:
    """The share of furniture that a tree, or several on average, expects of blocks like this one."""
    if isinstance(model, list):
        return sum(judge(t, f) for t in model) / len(model)
    while isinstance(model, tuple):
        model = model[2] if f[model[0]] <= model[1] else model[3]
    return model


def as_arrays(model) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each tree as arrays over its nodes: feature (-1 for a leaf), threshold or share, left and right child."""
    out = []
    for tree in model if isinstance(model, list) else [model]:
        nodes: list[list] = []

        def add(t, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append([-1, t, at, at] if not isinstance(t, tuple) else [t[0], t[1], 0, 0])
            if isinstance(t, tuple):
                nodes[at][2], nodes[at][3] = add(t[2]), add(t[3])
            return at

        add(tree)
        feature, value, left, right = zip(*nodes)
        out.append((np.array(feature), np.array(value, float), np.array(left), np.array(right)))
    return out


def shares(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """What ``judge`` says of each row of x, by all trees of ``as_arrays``, a level at a time."""
    total = np.zeros(len(x))
    for feature, value, left, right in trees:
        at = np.zeros(len(x), np.int64)
        open_ = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
        while len(open_):
            node = at[open_]
            at[open_] = np.where(x[open_, feature[node]] <= value[node], left[node], right[node])
            open_ = open_[feature[at[open_]] >= 0]
        total += value[at]
    return total / len(trees)


def fit_trees(x: np.ndarray, y: np.ndarray, count: int = TREES, share: float = 0.6, seed: int = 3) -> list:
    """Trees fitted on drawn blocks and drawn features each, so that none leans on one accident of the labelled pages."""
    trees = []
    for i in range(count):
        rng = np.random.default_rng([seed, i])
        rows = rng.integers(0, len(y), len(y))
        kept = rng.random(x.shape[1]) < share
        trees.append(fit_tree(np.where(kept, x[rows], 0.0), y[rows]))
    return trees


@functools.lru_cache(maxsize=1)
def default_tree() -> list:
    return fit_trees(*labelled_blocks())


def _python(pattern: str) -> str:
    """A pattern of the residue operator in Python's dialect."""
    upper = "".join(c for c in map(chr, range(0x250)) if c.isupper())
    alone, inside = {"L": r"[^\W\d_]", "Lu": f"[{upper}]"}, {"L": r"\w", "Lu": upper, "M": "\u0300-\u036f", "N": r"\d"}

    def spelt(m: re.Match) -> str:
        names = inside if m[0].startswith("[") else alone
        return re.sub(r"\\p\{(\w+)\}", lambda n: names[n[1]], m[0])

    pattern = re.sub(r"\\p\{\w+\}|\\.|\[\^?(?:\\p\{\w+\}|\\.|[^\]])*\]", spelt, pattern)
    return pattern.replace("(?<w>", "(?P<w>").replace(r"\k<w>", "(?P=w)")


@functools.lru_cache(maxsize=1)
def _residue_pattern() -> re.Pattern:
    phrases = "|".join(_python(p) for p in [*ERROR_PHRASES, *SCRIPT_PHRASES, *FILLER_PHRASES])
    return re.compile(rf"\W*+(?:(?:{phrases})(?!\w)[\W_]*+)++\Z")


def _is_residue(line: str) -> bool:
    """Error messages, script notices, filler and unfilled slots: not furniture, whatever they look like."""
    return _kept_residue(line) if len(line) <= KEPT else _make_residue(line)


@functools.lru_cache(maxsize=1)
def _slot_patterns() -> tuple[re.Pattern, re.Pattern]:
    return re.compile("|".join(f"(?:{_python(p)})" for p in SLOTS)), re.compile("|".join(p.replace(r"\z", r"\Z") for p in DEFAULTS))


def _make_residue(line: str) -> bool:
    t = re.sub(r"\d+", "0", re.sub(r"\b(?=[a-f]*\d)[\da-f]{6,}\b", "h", " ".join(line.lower().split())))
    slots, defaults = _slot_patterns()
    return bool(_residue_pattern().match(t) or slots.fullmatch(line) or defaults.search(line))


_kept_residue = functools.lru_cache(maxsize=10_000)(_make_residue)


def furniture_lines(texts: list[str | None], trees: list[tuple]) -> list[list[int] | None]:
    """For each text the numbers of its lines, from 1 and with blank lines counted, that are not the article."""
    numbered = [[(i, s) for i, line in enumerate(t.split("\n"), 1) if (s := line.strip())] if t is not None else None for t in texts]
    features = [f for lines in numbered if lines for f in page_features([s for _, s in lines])]
    judged = iter(shares(trees, np.array(features, dtype=float)) >= 0.5) if features else iter(())
    return [None if lines is None else [i for (i, s), out in zip(lines, judged) if out and not _is_residue(s)] for lines in numbered]


def furniture_numbers(text: str, model) -> list[int]:
    """The line numbers of one text that are not the article."""
    return furniture_lines([text], as_arrays(model))[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Small batches, so that the features of one stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def furniture(df: DataFrame, key: str, text: str, tree=None) -> DataFrame:
    """(key, line_no) of each non-blank line that is not part of the article."""
    trees = as_arrays(tree or default_tree())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = furniture_lines(batch.column(1).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["_key", "_lines"])

    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("_lines", T.ArrayType(T.IntegerType()))])
    pages = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null").mapInArrow(run, schema)
    return pages.select(F.col("_key").alias(key), F.explode("_lines").alias("line_no"))


def main_text(df: DataFrame, key: str, text: str, tree=None) -> DataFrame:
    """(key, text) with the article alone; null stays null."""
    trees = as_arrays(tree or default_tree())

    def clean(t: str | None, gone: list[int] | None) -> str | None:
        if not gone:
            return t
        out = set(gone)
        return "\n".join(line for i, line in enumerate(t.split("\n"), 1) if i not in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([clean(t, g) for t, g in zip(texts, furniture_lines(texts, trees))], pa.string())], names=["_key", "_text"])

    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("_text", T.StringType())])
    out = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)
    return out.select(F.col("_key").alias(key), F.col("_text").alias(text))
