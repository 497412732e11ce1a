"""Problem 8: template residue, filler, error pages and script notices in place of real content.

Method: normalised lines are counted by host in Spark; lines that recur on a host, and are no evidence themselves, are its
boilerplate. Each document loses its markup and its own host's boilerplate, and what is left is cut into short units. A
document is excluded if the units hold evidence of an error page, a script notice or filler and nearly nothing else, or if
its prose (not its code, quotations or configuration) holds a placeholder that was never filled.

Evidence is found by one automaton over literal phrases; patterns look at what has digits or repeats. Filler that imitates
Latin is told by its form: no function word of a living language, mostly Latin endings, some words of the standard text."""

from __future__ import annotations

import functools
import html
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Stored, ship

# Phrases of error pages, script notices and fillers, by language; {a|b} stands for each of a and b.
ERROR = """
not found; forbidden; unauthorized; bad gateway; gateway time; service {|temporarily }unavailable; internal server error; too many {requests|clients|redirects}; access denied; permission denied; fatal error
{database|db} connection failed; unexpected error; went wrong; error occurred; that's an error; call to undefined; failed to load; timed out; {request|connection} timeout; restricted to members; maintenance
{could not|couldn't|cannot|can't|can not} be {found|loaded|completed|reached|displayed|shown|processed|opened}; {has been|was|have been} {moved|removed|deleted|suspended}; not available {at the moment|right now}; {does not|doesn't} exist; no longer {available|exists}
{can't|cannot} {find|reach|open|connect to}; could not find {the|this|that|your}; session {|has }expired; may not view; sign in to see; log in to; are you a robot; verify you are human; bandwidth limit exceeded; site connection is secure; quota exceeded; connection refused; dns error
{don't|do not} have permission; isn't working; account suspended; temporarily unable; connection was {interrupted|reset|refused}; {isn't|is not} available; {page|site|resource} {has been|was|is} {denied|blocked}; request blocked; could not be satisfied
{database|db} error; error establishing; enable cookies; just a moment
introuvable; n'existe {pas|plus}; accès {refusé|interdit}; erreur interne; erreur est survenue; n'est pas {disponible|accessible}; a été {supprimé|déplacé|retiré}; indisponible; session a expiré; réservé{|e} aux membres; n'a pas pu être; délai d'attente; ne peut {|pas }être affiché
nicht gefunden; existiert nicht; zugriff verweigert; serverfehler; nicht geladen werden; nicht erreichbar; nicht verfügbar; nur für mitglieder; wartungsarbeiten; sitzung ist abgelaufen; schiefgelaufen; schief gelaufen; nicht angezeigt werden
{wurde|ist} {gelöscht|entfernt|verschoben}; zeitüberschreitung; fehler {|ist }aufgetreten
no encontrad{a|o}; no existe; acceso {denegado|prohibido}; error interno; no se pudo; no se ha {encontrado|podido}; fue {eliminad|movid}{a|o}; {no está|no} disponible; ha {caducado|expirado}; algo salió mal; {sólo|solo} para miembros; tiempo de espera
{se ha producido|ocurrió} un error
não encontrad{a|o}; não existe; acesso {negado|proibido}; erro interno; não está disponível; indisponível; foi {removid|movid|excluíd}{a|o}; sessão expirou; algo deu errado; ocorreu um erro
non trovat{a|o}; non esiste; accesso negato; errore interno; non è disponibile; non disponibile; è stat{a|o} {rimoss|spostat|eliminat}{a|o}; sessione scaduta; qualcosa è andato storto; si è verificato un errore
niet gevonden; bestaat niet; toegang geweigerd; interne serverfout; niet beschikbaar; is {verwijderd|verplaatst}; sessie is verlopen; er is {iets misgegaan|een fout opgetreden}
nie znaleziono; nie istnieje; odmowa dostępu; wystąpił błąd; niedostępna; hittades inte; finns inte; åtkomst nekad; ett fel uppstod; ikke funnet; ikke fundet; adgang nægtet
bulunamadı; erişim engellendi; bir hata oluştu; не найден; не существует; доступ {запрещён|запрещен}; произошла ошибка; недоступн; ページが見つかりません; アクセスが拒否; エラーが発生; 页面不存在; 找不到; 无法访问; 拒绝访问; 페이지를 찾을 수 없습니다
"""
SCRIPT = "javascript; java-script; java script; js; script; scripts; scripting; skript; skripte; skripten; secuencias de comandos"
NEED = """
require; requires; required; need; needs; needed; enable; enabled; turn; turned; relies; rely; cannot work; won't work; doesn't work; does not work; stay empty; stays empty; disabled; blocked; switched off; must be; allow; allowed; does not support; without; activate
benötigt; braucht; aktiviere; aktivieren; aktivieren sie; aktiviert; deaktiviert; funktioniert nicht; einschalten; erlauben; ohne; exige; nécessite; active; activez; activé; activer; désactivé; désactivés; fonctionne pas; autorisez; sans
requiere; necesita; desactivado; funciona sin; permita; permítalos; permitir; active; activar; activado; habilite; habilitar; sin; requer; precisa; ative; ativar; desativado; sem; richiede; attivare; attiva; abilita; abilitare; disabilitato; senza; vereist; nodig; inschakelen; uitgeschakeld; zonder; wymaga; włącz; включите; отключен; 有効; 启用
"""
FILLER = """
{goes|go|stands|stand} here; not {|yet }written; pending; will follow; coming soon; to be {added|replaced|filled in|written|determined}; replace me; dummy; placeholder; sample {paragraph|text}; layout purposes; some body text; lorem text; under construction; your {text|content} here
texte de remplissage; à remplacer; à compléter; ici viendra; ici le texte; texto de relleno; sin contenido; por completar; aquí va; blindtext; platzhaltertext; hier steht später; hier kommt; folgt in kürze; text folgt; inhalt folgt; testo segnaposto; texto de preenchimento; em breve; prossimamente
"""
AUX = """
try again; refresh; reload; been notified; administrator; check the address; check your browser; checking your browser; slow down; complete the check; turn it on; administrador; verwaltung; administrateur; bitte später; versuchen sie; réessay; inténtelo; activez-le; actívelo; rechargez; recargue; neu laden; einschalten
contact us; tente novamente; riprova; probeer het
"""
#: Evidence by patterns: numbers of errors, forms to be filled in, messages that are a word alone.
STATUS = re.compile(r"\b(?:error|erreur|fehler|errore|erro|fout|http|código|status)[\s:#-]*[45]\d\d\b|^\[?[45]\d\d\]?\s+\w+(?:\s\w+){0,3}$|\([45]\d\d\)?$|\bgone \(410\)|^(?:40[0-9]|410|429|50[0-4])$", re.I)
ALONE = re.compile(r"^gone\b|\bheading \d+$|^(?:write|enter|insert|add) (?:a|an|your|the)\b.*\bhere$|^(?:(\w)\1{2,}\W*){3,}$")
AUX_FORM = re.compile(r"\b(?:quote )?code(?: \S{1,12})?$|^some features|^won't work$|^(?:vorgang|código|incident) \w{1,12}$|^(?:whoops|oops|ups|oups|vaya|sorry)\W*$|^loading\b|^retry\b")
#: What is typed in place of words.
MASH = {*"asdf asdfgh qwerty qwertz blah bla foo foobar bar baz tbd tba xxx xxxx lala".split()}
#: Furniture that any page may have, whether or not it recurs in the corpus at hand.
FURNITURE = re.compile(r"^(?:home|menu|search|help|browse|contact|imprint|login|skip to content|back to (?:start|top)|zur startseite|accueil|inicio|buscar|base|abstract|methods?|summary|results?|introduction|request id|ref|© ?\w+(?: \w+)?)$")
#: Words of the filler text that imitates Latin, as its usual opening and its usual generators have them.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas vestibulum tortor quam feugiat vitae ultricies eget ante maecenas faucibus mollis interdum vivamus sagittis lacus vel augue laoreet rutrum auctor "
    "curabitur phasellus suspendisse aliquam nullam donec praesent mauris quisque cras fusce integer nunc sollicitudin bibendum pharetra perspiciatis unde omnis iste natus voluptatem accusantium doloremque laudantium".split()
)
#: Words that are not Latin alone: a text needs others as well.
WEAK = {"in", "id", "do", "sit", "non", "et", "ad", "ex", "est", "qui", "sed", "ea", "eu", "ut", "ac", "vel", "integer"}
#: Frequent words of living languages that Latin doesn't have.
LIVING = {
    *"the of to and that for is was with on as by this are be from or have it an which not were has been at its can when all their they we you".split(),
    *"le la les des du un une que dans pour pas sur par avec sont au aux ce cette il elle nous vous qui plus".split(),
    *"der die das den dem und zu mit von auf für ist nicht ein eine einer eines im sich auch wird werden als aus nach bei".split(),
    *"el los las del y en por con para una se su al lo como más pero sus fue son".split(),
    *"il lo gli di che da del della con per sono o os na no em um uma dos das não het een van op te zijn".split(),
} - {"in", "et", "est", "qui", "at", "non", "um", "per", "se", "te", "o"}
OPENING_PAIRS = {("lorem", "ipsum"), ("ipsum", "lorem"), ("ipsum", "dolor"), ("dolor", "sit"), ("sit", "amet")}
#: Frequent endings of Latin words.
ENDING = re.compile(r"(?:us|um|is|am|em|ae|or|ur|it|at|et|ant|ent|unt|que)$")

TAGS = "html head body noscript script style title meta link div span p a b i u em strong br hr ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 img pre code nav header footer main section article aside form input button label select option iframe svg path sub sup small center font blockquote".split()
TAG = re.compile(r"</?(?:" + "|".join(TAGS) + r")\b[^<>]*>|<!--.*?(?:-->|\Z)|<!doctype[^>]*>", re.I | re.S)
BLOCK = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(pre|code|script|style)\b.*?(?:</\1>|\Z)", re.S | re.I)
INLINE = re.compile(r"`[^`\n]*(?:`|$)", re.M)
QUOTED = re.compile(r"“[^”\n]{0,120}”|«[^»\n]{0,120}»|„[^“”\n]{0,120}[“”]|\"[^\"\n]{0,120}\"")
SETTING = re.compile(r"^\s*(?:export\s+)?[A-Za-z_][\w.-]*\s*(?:=|:(?=\s*[\"'{\[$%]))\s*\S.*$|^\s*(?:[$>#]|>>>)\s*(?:cat|cd|cp|mv|rm|python\d?|bash|sh|export|echo|grep|awk|sed|curl|wget|git|make|pip|docker|spark-submit)\b.*$", re.M)
JSON = re.compile(r"\s*(?:\{\s*(?:\"|\}|\Z)|\[\s*(?:\{\s*\"|\"|\d|\]|\Z))")
LOG = re.compile(r"\s*(?:\[(?:#|(?![45]\d\d\])\d{3,})\]|\d{4}-\d\d-\d\d[ t]\d\d:\d\d)", re.I)  # a line of a log speaks about errors
META = re.compile(r"\b(?:placeholders?|platzhalter\w*|marcador(?:es)?|templates?|vorlagen?|plantillas?|modèles?|gabarit|formular\w*|stands? for|denotes?|legend|legende|légende|leyenda|notation|variables?|syntax)\b", re.I)
HOLE = re.compile(
    r"""
    (?=[{\[<$%@_#(X]) (?: \{\{\s*[\w.\ |-]{1,40}\s*\}\} | \{%\s*[\w.\ ]{1,40}\s*%\} | <%=?\s*[\w.\ ]{1,40}\s*%> | <<\s*[\w\ ]{2,40}\s*>> | \[\[\s*[\w\ ]{2,40}\s*\]\]
    | \$\{[a-z]\w*\} | \#\{\w+\} | %\([a-z]\w*\)[sd](?![\w./]) | (?<![\w%])%[A-Z][A-Z_]{2,30}%(?!\w) | @@\w{2,40}@@ | (?<![\w_])__[A-Za-z][A-Za-z_]{1,40}?__(?![\w_(])
    | (?<![\w$])\$[a-z][a-z_]{1,30}\$(?!\w) | (?<![\w$\#{%])\{(?:\d{1,2}|[a-z][a-z_]{1,30})\}(?![\w}]) | \bX{4,}\b
    | \[(?:insert|tbd|tba|tbc|to\ be|todo|fill|add|enter|your|name|value|date|hier|bitte|rellenar|completar|insertar|escriba|insérer|à\ compléter|compléter|saisir|nom|nombre|einfügen|eintragen|ergänzen|object\ object)\b[^\]\n]{0,40}\]
    | \[[^\W\d_a-zß-ÿ][^\W\d_a-zß-ÿ\ ]{1,30}[^\W\d_a-zß-ÿ]\ ?[^\W\d_a-zß-ÿ\ ]*\]
    | \([\w\ ]{2,30}\ (?:goes|go)\ here\)
    | <(?:insert|enter|your|name|nombre|nom|value|hier|bitte|escriba|insérer|saisir|inserte|rellenar)\b[^<>\n]{0,30}> | <(?!(?:%s)\b)[a-z][a-z_]{2,30}> | <(?!(?:%s)\b)[a-z]{2,15}(?:\ [a-z]{2,15}){1,3}> | <title>(?!.*</title)
    )""".replace("%s)\\b", "|".join(TAGS) + ")\\b"),
    re.X | re.S,
)
HOLE_ANY_CASE = re.compile(r"\[(?:insert|tbd|tba|tbc|to be|fill|enter|your|hier|bitte|rellenar|completar|insertar|escriba|insérer|à compléter|saisir|object object)\b[^\]\n]{0,40}\]|<(?:insert|enter|your|hier|bitte|escriba|insérer|saisir|name eintragen)\b[^<>\n]{0,30}>", re.I)
OPENING = re.compile(r"[{\[<$%@#]|__|XXXX|\(\w[\w ]* here\)")  # without one of these there is no placeholder
#: Furniture that stands between other words, too.
BETWEEN = r"skip to (?:main )?content|back to (?:start|top|home)|zur startseite|zum inhalt|retour à l'accueil|aller au contenu|volver al inicio|ir al contenido|terms of use|privacy policy|all rights reserved"
CUT = re.compile(r"[\n\r|]+|(?<=[.!?…:])\s+|\s*[·›»|≡]\s*|\s[–—]\s|\b(?:" + BETWEEN + r")\b")
AGAIN = re.compile(r"\b(\w+)(?:\W+\1\b){3,}")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b")
DECODER = json.JSONDecoder()


def prose(text: str) -> str:
    """The text without code, quotations, settings and commands, and without the JSON it begins with (all of it, if that
    doesn't parse: it is cut off). Entities are resolved."""
    while JSON.match(text):
        try:
            text = text[DECODER.raw_decode(text, len(text) - len(text.lstrip()))[1] :]
        except (ValueError, RecursionError):
            return ""
    text = html.unescape(text)
    for what in (BLOCK, INLINE, QUOTED, SETTING):
        text = what.sub(" ", text)
    return text


def unfilled(text: str) -> bool:
    """Does the prose hold a placeholder, in a sentence that doesn't speak about placeholders?"""
    if not OPENING.search(text) and "&" not in text:
        return False
    p = prose(text)
    for m in (*HOLE.finditer(p), *HOLE_ANY_CASE.finditer(p)):
        lo = max(p.rfind(". ", 0, m.start()), p.rfind("\n", 0, m.start())) + 1
        hi = min((x for x in (p.find(". ", m.end()), p.find("\n", m.end())) if x >= 0), default=len(p))
        if not META.search(p[lo : m.start()] + " " + p[m.end() : hi]):
            return True
    return False


def phrases(table: str) -> Iterator[str]:
    """The phrases of a table: ';' and line ends part them, {a|b} stands for each of a and b."""
    for cell in re.split(r"[;\n]", table):
        parts = re.split(r"[{}]", cell.strip())
        options = [x.split("|") if i % 2 else [x] for i, x in enumerate(parts)]
        yield from filter(None, ("".join(x) for x in itertools.product(*options)))


@functools.cache
def _phrases():
    """The automaton of all phrases: (length, kind, whole), whole where the phrase must end with a word."""
    import ahocorasick

    found: dict[str, list[tuple[int, str, bool]]] = {}
    for kind, table in (("error", ERROR), ("filler", FILLER), ("aux", AUX), ("script", SCRIPT), ("need", NEED)):
        for x in phrases(table):
            found.setdefault(x, []).append((len(x), kind, kind in ("script", "need") or x in ("dummy", "placeholder", "pending", "forbidden", "unauthorized")))
    auto = ahocorasick.Automaton()
    for x, what in found.items():
        auto.add_word(x, what)
    auto.make_automaton()
    return auto


def hits(unit: str) -> dict[str, int]:
    """How often phrases of each kind stand in a unit (lower case); overlapping phrases of a kind count once."""
    count: dict[str, int] = {}
    last: dict[str, int] = {}
    for end, what in _phrases().iter(unit):
        for size, kind, whole in what:
            lo = end + 1 - size
            # Han, kana and Hangul run on without blanks
            if lo and unit[lo - 1].isalnum() and unit[lo] < "\u3000" or whole and end + 1 < len(unit) and unit[end + 1].isalnum() and unit[end] < "\u3000":
                continue
            if lo >= last.get(kind, 0):
                count[kind] = count.get(kind, 0) + 1
            last[kind] = end + 1
    return count


def _mashed(words: list[str]) -> bool:
    return any(a in MASH and b in MASH for a, b in zip(words, words[1:]))


def evidence(unit: str, words: list[str] | None = None, kinds: dict[str, int] | None = None) -> bool:
    """Is a short unit (lower case, repeated words collapsed) a line of an error page, a script notice or filler?"""
    words = WORD.findall(unit) if words is None else words
    n = len(words)
    if n >= 3 and (len(set(words)) == 1 or n >= 6 and len(set(words)) <= n // 3) or n == 2 and tuple(words) in OPENING_PAIRS:
        return True
    latin = [w for w in words if w in LATIN]
    if n >= 3 and len(latin) >= 0.6 * n and sum(w not in WEAK for w in latin) >= n // 8 + 1:
        return True
    if n > 30:
        return False
    kinds = hits(unit) if kinds is None else kinds
    if n > 14:  # a sentence this long tells about an error, unless several messages were run together
        errors = kinds.get("error", 0) + len(STATUS.findall(unit))
        return errors >= 2 and errors >= n / 12
    return bool("error" in kinds or "filler" in kinds or ("script" in kinds and "need" in kinds) or STATUS.search(unit) or ALONE.search(unit) or _mashed(words))


def imitates_latin(words: list[str]) -> bool:
    """Do words, none of which is a function word of a living language, look like the filler text? At least half of them are
    of the standard text or have a Latin ending, and one in ten or more is of the standard text; or three in ten have one, and a pair of words of its
    opening stands there. Names of species have such endings, but not such words."""
    n, strong, ends = len(words), sum(w in LATIN and w not in WEAK for w in words), sum(w in LATIN or bool(ENDING.search(w)) for w in words)
    return n >= 6 and (ends * 2 >= n and strong * 10 >= n or ends * 10 >= 3 * n and any(x in OPENING_PAIRS for x in zip(words, words[1:])))


def segments(text: str) -> Iterator[str]:
    """The lower-case lines without markup and ids, one after the other; code blocks stay: what they hold is content."""
    at = 0
    for m in TAG.finditer(text):
        yield from _lines(text[at : m.start()])
        at = m.end()
    yield from _lines(text[at:] if at else text)


def _lines(part: str) -> Iterator[str]:
    for x in part.splitlines():
        yield HEX.sub("#", html.unescape(x).replace("\u200b", " ").lower())


class Judge:
    """Judges texts of one host, whose recurrent lines are given; those that are evidence themselves are no boilerplate."""

    def __init__(self, boilerplate: Iterable[str]):
        import ahocorasick

        self.auto = None
        lines = sorted({x for x in boilerplate if x and not evidence(x) and "aux" not in hits(x) and not AUX_FORM.search(x) and not HOLE.search(x)})
        if lines:
            self.auto = ahocorasick.Automaton()
            for x in lines:
                self.auto.add_word(x, len(x))
            self.auto.make_automaton()

    def without_boilerplate(self, text: str) -> str:
        """The text without the lines that stand in it as whole words, from left to right, the longest first."""
        if self.auto is None:
            return text
        ends = ((end + 1 - size, end + 1) for end, size in self.auto.iter(text))
        out, at = [], 0
        for lo, hi in sorted(((lo, hi) for lo, hi in ends if (lo == 0 or not text[lo - 1].isalnum()) and (hi == len(text) or not text[hi].isalnum())), key=lambda x: (x[0], -x[1])):
            if lo >= at:
                out.append(text[at:lo])
                at = hi
        return "\n".join([*out, text[at:]])

    def replaced(self, text: str) -> bool:
        """Is the whole text error page, script notice or filler, with or without heading, furniture and markup around it?

        What is no evidence is counted in different words; once there are more than six the text is real, whatever follows."""
        proof, other, latin, sure = 0, set(), [], []
        for line in segments(text):
            if not line or line.isspace():
                continue
            log = LOG.match(line)
            for unit in CUT.split(self.without_boilerplate(line)):
                unit = AGAIN.sub(r"\1 \1 \1", unit.strip(" \t#*_=>-–—.!…?:,;()[]\"'¡¿•"))
                words = WORD.findall(unit)
                if not words:
                    continue
                kinds = hits(unit) if len(words) <= 30 else {}
                if log:
                    other.update(words)
                elif evidence(unit, words, kinds):
                    proof += len(words)
                    sure += words
                elif FURNITURE.match(unit) or len(words) <= 14 and ("aux" in kinds or AUX_FORM.search(unit)):
                    continue
                elif len(words) >= 3 and LIVING.isdisjoint(words) and all(w.isalpha() for w in words):
                    latin.append(words)
                else:
                    other.update(words)
                if len(other) > 6:
                    return False
        pool = [w for x in latin for w in x]
        if imitates_latin([*(w for w in sure if w in LATIN), *pool]):
            proof += len(pool)
        else:
            other.update(pool)
        return proof > 0 and len(other) <= min(6, max(2, proof))

    def __call__(self, text: str | None) -> bool:
        return bool(text and text.strip()) and (self.replaced(text) or unfilled(text))


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def boilerplate(docs: DataFrame, text_col: str, host_col: str, share: float = 0.002, least: int = 3, most_words: int = 14) -> DataFrame:
    """host, line, n: normalised lines of at most most_words words in at least `least` documents and `share` of the host's.

    Longer lines are sentences, which no document loses. A null host is a host. A text of one line has no boilerplate, so
    that copies of a short page don't make it furniture. Each host has fewer than (lines of its average document) / share
    such lines."""
    bare = F.lower(F.regexp_replace(F.col(text_col), r"<[^<>\n]*+>", "\n"))
    line = F.array_distinct(F.filter(F.split(bare, r"[\r\n]+"), lambda x: F.trim(x) != ""))
    short = F.filter(line, lambda x: x.rlike(rf"^[^\S\n\r]*+(?:\S++[^\S\n\r]*+){{1,{most_words}}}+$"))  # a long line is left after its first words
    even = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\b(?=[a-f]*+\d)[0-9a-f]{6,}+\b", "#"), r"\d++", "#"), r"[^\S\n\r]++", " ")
    short = F.array_distinct(F.filter(F.transform(short, lambda x: F.trim(even(x))), lambda x: F.length(x) >= 4))
    d = docs.filter(F.col(text_col).isNotNull())
    n = d.select(_host(host_col).alias("host")).groupBy("host").agg(F.count("*").alias("docs"))
    lines = d.select(_host(host_col).alias("host"), F.explode(F.when(F.size(line) > 1, short)).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    return lines.filter(F.col("n") >= least).join(n, "host").filter(F.col("n") >= share * F.col("docs")).select("host", "line", "n")


#: Recurrent lines are broadcast up to this many characters; beyond it they are brought to their host's documents by a shuffle.
BROADCAST_CHARS = 8_000_000


def residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The ids (distinct) of documents to exclude: see the module's text.

    Null, empty and blank texts, and null ids, are no cases. Texts are judged whole, each with the recurrent lines of its own
    host; a copy of a case, on whatever host, is a case. An empty table gives none; other columns aren't read. Counting lines
    shuffles (host, line) counts after map-side combine; judging shuffles nothing unless the recurrent lines are too many to
    be broadcast (see BROADCAST_CHARS): then texts and lines are sorted by host, large hosts in up to 256 parts. Both ways
    give the same ids. Copies are found by a 128-bit hash of the text."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _host(host_col).alias("host")).filter("id is not null and trim(text) <> ''")
    kind = d.schema["id"].dataType.simpleString()
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"))
    lines = Stored(boilerplate(docs, text_col, host_col).select("host", "line")).df
    if (lines.agg(F.sum(F.length("line"))).first()[0] or 0) <= BROADCAST_CHARS:
        held: dict[str, list[str]] = {}
        for r in lines.collect():
            held.setdefault(r.host, []).append(r.line)
        shared = spark.sparkContext.broadcast(held)

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            judges = functools.cache(lambda h: Judge(shared.value.get(h, ())))
            for b in it:
                yield b.loc[[judges(h)(t) for t, h in zip(b["text"], b["host"])], ["a", "b"]]

        bad = d.select("text", "host", key.alias("k")).select("text", "host", "k.*").mapInPandas(run, "a long, b long")
    else:
        bad = _sorted_by_host(d, lines, key)
    copies = d.select("id", key.alias("k")).select("id", "k.*")
    return copies.join(bad.distinct(), ["a", "b"], "left_semi").select("id").distinct().withColumnRenamed("id", id_col)


def _sorted_by_host(d: DataFrame, lines: DataFrame, key: Column, parts: int = 256) -> DataFrame:
    """(a, b) of the cases: each host's lines go before its texts, in every part of the host. A host has one part for each
    parts-th of all documents that it holds, so that at most `parts` hosts have more than one."""
    sizes = d.groupBy("host").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    several = {r.host: -(-r.n * parts // total) for r in sizes.filter(F.col("n") * parts > total).collect()}
    many = F.coalesce(F.create_map(*[F.lit(x) for kv in several.items() for x in kv])[F.col("host")], F.lit(1)) if several else F.lit(1)
    texts = d.select("host", F.pmod(F.xxhash64("text"), many).cast("int").alias("part"), F.lit(1).alias("o"), "text", key.alias("k"))
    first = lines.select("host", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)).alias("part"), F.lit(0).alias("o"), F.col("line").alias("text"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("k"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, mine, judge = None, [], None
        for b in it:
            good = np.zeros(len(b), dtype=bool)
            for i, (h, p, o, t) in enumerate(zip(b["host"], b["part"], b["o"], b["text"])):
                if at != (h, p):
                    at, mine, judge = (h, p), [], None
                if o == 0:
                    mine.append(t)
                else:
                    judge = judge or Judge(mine)
                    good[i] = judge(t)
            yield b.loc[good, ["a", "b"]]

    both = texts.unionByName(first).select("host", "part", "o", "text", "k.*")
    return both.repartition("host", "part").sortWithinPartitions("host", "part", "o").mapInPandas(run, "a long, b long")
