"""Template residue, filler, error messages and script notices in place of real text.

One multi-pattern automaton holds fixed messages, the states that make a message of a noun (``not
found``, ``could not be loaded``), the nouns of script notices, filler phrases, dummy Latin, keyboard
mash and the openers of unfilled slots, in several languages. The patterns are families put together
by rule, not sentences. A text is brought to its skeleton first (full-width forms, invisible
characters and look-alike letters do not hide a message). Every text is scanned once, whole.

A slot whose full pattern holds at an opener always counts. Everything else counts by coverage: the
share of matched letters among the letters of all words that say anything (numbers and function
words do not). A text is residue when the coverage of the whole text, or of one of its sentences, is
at least ``min_coverage``; the sentence stands in for the document because a message beside real
text would be diluted otherwise, and a requirement that merely quotes a message covers little of its
sentence either way. A message that opens its sentence also covers its tail: a code, the details
behind a colon, what was being done, or what a prompt asks for. A message run together with
a following sentence counts when a new capital follows it. ``coverage`` gives the matched share of the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import product
from operator import eq

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.characters import skeleton

MIN_COVERAGE = 0.6
#: Words that may stand between the two halves of a message.
GAP = 4

# Messages that need no noun, by language.
MESSAGES = """
not found; access denied; access forbidden; permission denied; you do not have permission; you lack permission; not authorized; unauthorized; forbidden; bad gateway; bad request;
gateway timeout; gateway time-out; request timeout; service unavailable; internal server error; server error; too many requests; method not allowed; not acceptable; payload too large; unsupported media type;
something went wrong; an error occurred; an error has occurred; an unexpected error; unexpected error; unknown error; fatal error; runtime error; syntax error; parse error; unhandled exception; uncaught exception;
null pointer exception; nullpointerexception; stack trace; traceback (most recent call last); segmentation fault; object reference not set; out of memory; network error; request failed; rendering failed;
loading failed; failed to load; failed to fetch; failed to open; rate limit exceeded; quota exceeded; try again later; please try again; sign in again; log in again; please log in; please sign in; please wait;
check back soon; check back later; checking your browser; verify you are human; you are being redirected; request id; bookmark missing; link target missing; reference missing; image missing; page missing; [object object];
zugriff verweigert; keine berechtigung; ein fehler ist aufgetreten; unerwarteter fehler; interner serverfehler; bitte warten; wird geladen; versuchen sie es später; bitte versuchen sie es erneut; bitte erneut anmelden; melden sie sich erneut an; zu viele anfragen;
accès refusé; accès interdit; une erreur est survenue; une erreur s'est produite; erreur inattendue; erreur interne du serveur; veuillez patienter; chargement en cours; veuillez réessayer; réessayez plus tard; veuillez vous reconnecter; trop de requêtes;
acceso denegado; acceso prohibido; se produjo un error; se ha producido un error; ha ocurrido un error; ocurrió un error; error inesperado; error interno del servidor; por favor espere; espere por favor; cargando; inténtelo de nuevo; vuelva a intentarlo; inicie sesión de nuevo; demasiadas solicitudes;
доступ запрещён; доступ запрещен; произошла ошибка; возникла ошибка; непредвиденная ошибка; внутренняя ошибка сервера; ошибка сервера; подождите; загрузка; идёт загрузка; идет загрузка; повторите попытку; попробуйте позже; войдите снова; слишком много запросов;
accesso negato; si è verificato un errore; attendere prego; riprova più tardi; acesso negado; ocorreu um erro; aguarde por favor; tente novamente; toegang geweigerd; er is een fout opgetreden; even geduld; probeer het later opnieuw; odmowa dostępu; wystąpił błąd; proszę czekać; spróbuj ponownie
"""
# States that make a message together with a noun that stands near.
STATES = """
could not be found; cannot be found; can not be found; was not found; were not found; not be located; cannot be displayed; could not be displayed; cannot be shown; could not be shown; cannot be opened; could not be opened;
cannot be loaded; could not be loaded; could not be read; could not be reached; could not load; could not open; could not find; cannot open; cannot find; unable to load; unable to open; unable to find; unable to connect; not available; unavailable;
does not exist; no longer exists; has expired; have expired; expired; timed out; did not answer; did not respond; does not respond; not responding; was refused; refused to connect; was reset; was closed; can't be found; couldn't be found; can't be displayed; can't be reached; can't be opened; couldn't be loaded; couldn't load; can't open; isn't available; wasn't found; doesn't exist; didn't respond; could not be processed; could not be completed; has been denied; is restricted; not defined; undefined; under maintenance; down for maintenance; is corrupt;
nicht gefunden; konnte nicht gefunden werden; konnte nicht geladen werden; konnte nicht geöffnet werden; konnte nicht angezeigt werden; kann nicht angezeigt werden; kann nicht geöffnet werden; nicht geladen werden; nicht verfügbar; nicht erreichbar; existiert nicht; existiert nicht mehr; abgelaufen; nicht definiert; nicht vorhanden; fehlgeschlagen; antwortet nicht; unterbrochen; wird gewartet;
introuvable; non trouvé; non trouvée; pas été trouvé; pas été trouvée; pas pu être chargé; pas pu être chargée; pas pu être ouvert; pas pu être ouverte; pas pu être affiché; pas pu être affichée; pas disponible; indisponible; n'existe pas; n'existe plus; a expiré; expirée; expiré; non défini; non définie; ne répond pas; impossible d'ouvrir; impossible de charger; impossible d'afficher; impossible de trouver; en maintenance;
no encontrada; no encontrado; no se encontró; no se encuentra; no se ha encontrado; no se pudo cargar; no se pudo abrir; no se pudo mostrar; no se pudo encontrar; no se puede mostrar; no se puede abrir; no se puede cargar; no está disponible; no disponible; no existe; ya no existe; ha caducado; ha expirado; caducada; no definido; no responde; en mantenimiento;
не найдена; не найден; не найдено; не удалось загрузить; не удалось открыть; не удалось найти; не удаётся открыть; не удается открыть; невозможно открыть; невозможно отобразить; недоступна; недоступен; недоступно; не существует; больше не существует; истекла; истек; истёк; не определена; не отвечает; отсутствует; на обслуживании;
non trovata; non trovato; non disponibile; scaduta; impossibile aprire; impossibile caricare; não encontrada; não encontrado; não disponível; não foi possível carregar; não foi possível abrir; expirou; niet gevonden; niet beschikbaar; verlopen; kon niet worden geladen; kon niet worden geopend; nie znaleziono; nie została znaleziona; nie została odnaleziona; niedostępna; wygasła
"""
# The nouns of such messages.
NOUNS = set("""page file document section image link target bookmark reference source resource content url address site website server service session request connection database viewer app application system account link
seite datei dokument abschnitt bild textmarke verweisquelle verweis inhalt dienst sitzung anfrage verbindung webseite website
fichier lien signet contenu serveur connexion demande requête ressource référence site
página archivo fichero documento sección imagen enlace marcador contenido servidor servicio sesión solicitud conexión sitio recurso referencia
страница страницу страницы файл документ раздел изображение ссылка ссылки закладка содержимое сервер сервис служба сессия сеанс запрос соединение сайт источник
pagina sessione sessão arquivo documento bestand verbinding sessie strona plik dokument sesja""".split())
# What script notices are about, and what they say of it.
SCRIPT_NOUNS = "javascript; java script; scripts; scripting; cookies; skripte; skripten; scripting-funktion; cookie-dateien; сценарии; сценариев; скрипты; скриптов; куки"
SCRIPT_ACTS = set("""turn turned switch switched enable enabled enabling activate activated allow allowed allows allowing require requires required need needs needed disable disabled off blocked support supports supported run runs accept accepts must
aktivieren aktiviert aktiviere einschalten erlauben zulassen deaktiviert ausgeschaltet erforderlich benötigt benötigen notwendig unterstützt
activer activez activé activés autoriser autorisez désactivé désactivés requis nécessaire nécessaires nécessite accepter
active activar activado habilite habilitar habilitado permita permitir acepte desactivado deshabilitado requiere requieren necesario necesarios necesita uso
включите включить включён включен разрешите разрешить отключён отключен отключены выключен требуется требуются необходим необходимы нужен поддерживает
attivare attiva abilita abilitare disattivato richiesto ative ativar habilite desativado necessário inschakelen uitgeschakeld vereist włącz włączyć wyłączony wymagany""".split())
# Words that belong to a message where one stands, and say nothing without it.
COMPANIONS = set("""please sorry oops again later back soon reload refresh retry contact administrator support browser javascript cookies scripts scripting viewer page site website file document section view see continue display show shown read proceed use using login log sign
error code status loading permission open opened opening because turn turned switch switched switched-off answer wait visit return homepage home internet web content full line text heading here your own wording paragraph title only delete remove replace example issue requested asked looking currently now right moment time filler dummy sample placeholder
bitte später erneut seite inhalt browser anzeigen sehen fehler laden neu administrator dokument ersetzen löschen beispiel angeforderte angeforderten gewünschte derzeit momentan
veuillez afficher voir contenu page document navigateur erreur recharger plus tard continuer réessayer remplacer supprimer exemple demandé demandée actuellement moment
favor ver página documento contenido navegador recargar continuar mostrar más tarde reemplazar sustituir eliminar ejemplo usar scripts solicitado solicitada actualmente momento
пожалуйста просмотра страницы страницу документа браузер браузере ошибка позже снова обновите продолжить отображения замените удалите пример работы сайта запрошенный запрошенная запрошенная сейчас
""".split())
# Words for an error that count with a number, a code or an exclamation mark.
ERROR_WORDS = "error; fehler; erreur; ошибка; errore; erro; fout; błąd"
# Error values of spreadsheets.
CELL_ERRORS = "#value!; #name?; #ref!; #div/0!; #null!; #num!; #n/a; #wert!; #bezug!; #zahl!; #valeur!; #nom?; #¡valor!; #¿nombre?; #¡ref!; #знач!; #имя?; #ссылка!"
# Halves of filler phrases; each first half goes with each second one.
FILLER = [
    ("sample; dummy; placeholder; filler; example", "text; copy; paragraph; line; heading; title; sentence; content; wording"),
    ("text; heading; title; content; description; paragraph; name; copy", "goes here; comes here; will go here; to follow"),
    ("enter; insert; type; write; add; put; place; paste", "text here; your text here; your text; your content here; heading here; title here; description here; content here; some text"),
    ("delete; replace; remove; overwrite", "this text; this line; this paragraph; this sentence; this heading"),
    ("to be", "completed; determined; confirmed; decided; supplied later"),
    ("content; text; details; more", "coming soon"),
    ("text hier; titel hier; überschrift hier; inhalt hier", "eingeben; einfügen"),
    ("hier", "text eingeben; text einfügen; klicken"),
    ("diesen text; diesen absatz; diese zeile", "ersetzen; löschen; überschreiben"),
    ("saisir; saisissez; insérer; insérez; entrez; tapez", "le texte ici; votre texte ici; du texte; un titre ici"),
    ("texte", "provisoire; de remplissage; factice; à venir; d'exemple"),
    ("à", "remplacer; compléter; définir"),
    ("escriba; introduzca; inserte; ingrese; añada", "aquí el texto; el texto aquí; su texto aquí; un título aquí"),
    ("texto", "de relleno; de ejemplo; provisional; de muestra; ficticio"),
    ("por", "completar; definir; determinar"),
    ("введите; вставьте; добавьте; напишите", "текст; текст здесь; здесь текст; заголовок"),
    ("образец; пример", "текста; заголовка"),
    ("замените; удалите", "этот текст; этот абзац; эту строку"),
]
# Filler phrases of one part.
FILLER_WORDS = "blah; example only; for example only; blindtext; platzhalter; platzhaltertext; mustertext; beispieltext; fülltext; bitte ersetzen; bitte ausfüllen; faux texte; lorem ipsum; рыба-текст; текст-заполнитель; текст заполнитель; testo segnaposto; texto de preenchimento; voorbeeldtekst; przykładowy tekst"
# The common vocabulary of dummy Latin text.
DUMMY_WORDS = """lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim
minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse
cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum
accumsan aenean aliquam aliquet auctor augue bibendum blandit condimentum congue convallis cras curabitur cursus dapibus diam dictum dictumst dignissim
donec egestas eget eleifend elementum erat eros etiam euismod facilisis faucibus felis fermentum feugiat finibus fringilla fusce gravida habitasse hendrerit
iaculis imperdiet integer interdum justo lacinia lacus laoreet lectus leo libero ligula lobortis luctus maecenas malesuada mattis mauris maximus metus molestie
morbi nam neque nibh nullam nunc odio orci ornare pellentesque pharetra phasellus placerat platea porta porttitor posuere praesent pretium primis proin pulvinar purus
quam quisque rhoncus risus rutrum sagittis sapien scelerisque sem semper sodales sollicitudin suscipit suspendisse tellus tempus tincidunt tortor tristique turpis
ultrices ultricies urna varius vehicula vel venenatis vestibulum vitae vivamus viverra volutpat vulputate""".split()
# Those of them that no living language of the texts uses.
PLAIN_WORDS = set("dolor sit elit sed tempor magna minim culpa enim esse sint sunt anim nulla cras diam erat eros integer justo leo libero metus nam nunc odio porta quam sem semper vel urna varius vitae cursus lacus purus interdum officia commodo".split())
# Prompts that end in the name of what to enter.
PROMPTS = [
    "click or tap here to enter", "click here to enter", "tap here to enter", "click or tap to enter", "click to enter", "choose an item", "click or tap to choose",
    "klicken oder tippen sie hier, um", "klicken sie hier, um", "wählen sie ein element aus", "cliquez ou appuyez ici pour entrer", "cliquez ici pour entrer", "cliquez ici pour taper", "choisissez un élément",
    "haga clic o pulse aquí para escribir", "haga clic aquí para escribir", "elija un elemento", "щелкните здесь, чтобы ввести", "щёлкните здесь, чтобы ввести", "место для ввода текста", "выберите элемент",
]
# Rows of letter keys, and stretches of them that may name a layout or a unit.
KEY_ROWS = ["qwertyuiop", "qwertzuiop", "azertyuiop", "asdfghjkl", "qsdfghjklm", "zxcvbnm", "yxcvbnm", "wxcvbn", "йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю"]
WEAK_MASH = {"qwerty", "qwertz", "azerty", "йцукен", "смит", "мить", "jkl", "uiop", "poiu"}
# Function words, which say nothing either way.
FUNCTION_WORDS = set("""the a an and or of to in on at by for from with is are was were be been being has have had it its this that these those you your we our i my as if so but than then there into over under out up down no shall must will may can would should do does did each any all every both where when which who that
der die das den dem des ein eine einen einer und oder von zu zum zur im in am an auf aus bei mit nach für ist sind war wird werden hat haben sie es er nicht um dass als auch durch über ohne bis kein keine soll muss dieser diese dieses
le la les l un une des du de et ou à au aux en dans sur par pour avec sans est sont était a ont il elle ce cet cette ces qui que ne pas se son sa ses vous votre doit doivent être d s n nur hier ici aquí aqui здесь
el la los las un una unos y o de del al en con por para sin es son está están fue ha han se su sus lo le que no esta este estos debe deben ser
и или в во на с со к по за из от до для не что это как его её их он она они но при о об над под должен должна должны быть я вы ваш""".split())
_LATIN_WORDS = set("a et in de non est ex ad per sed do ut at ac eu id si ab cum la se".split())

# Openers of unfilled slots and the pattern that must hold from there.
SLOTS = {
    "{{": r"\{\{[^{}]*\}\}",
    "${": r"\$\{[^{}]*\}",
    "{%": r"\{%[^{}]*%\}",
    "{": r"\{[A-Za-z_][A-Za-z_ .]+\}",
    "<<": r"<<[^<>]+>>",
    "<%": r"<%[^<>]+%>",
    "<": r"<[A-Za-z][A-Za-z_ -]+>",
    "&lt;": r"&lt;[A-Za-z][A-Za-z_ -]*&gt;",
    "(": r"\((?i:(?:insert|enter)[ _](?!(?:by|at|from|through|via|into|on|in|to|only|before|after|with|when|if)\b))[^()]+\)",
    "«": r"«[A-Za-z_][A-Za-z0-9_]+»",
    "%": r"%[A-Z][A-Z0-9_]+%",
    "@@": r"@@[A-Za-z_]{2,}@@",
    "##": r"##[A-Za-z_]{2,}##",
    "[": r"\[(?:[ _.•…*?-]*|[A-Z]{2}[A-Z_ -]+|(?i:insert|enter|select|choose|specify|fill in|type|your|add|edit|describe|name of|date of|click|tb[dc]|to be)(?:[ _][^\[\]]*)?|X{2,}|[^\[\]]*(?i:\b(?:einfügen|eingeben|ergänzen|ausfüllen|insérer|saisir|compléter|insertar|introducir|completar|rellenar|inserire|inserir|invullen|вставить|ввести|заполнить|указать))\b[^\[\]]*)\]",
    "__": r"_{3,}|__[A-Za-z]+(?:_[A-Za-z]+)*__",
    "xxxx": r"(?<![A-Za-z0-9])[Xx]{4,}(?![A-Za-z0-9])",
    "tbd": r"(?<![A-Za-z0-9])TBD(?![A-Za-z0-9])",
}
# A heading or paragraph that only names itself.
_NAMES = [skeleton(w).lower() for w in "heading paragraph section title überschrift absatz titre título párrafo заголовок абзац".split()]
SELF_NAMED = re.compile(rf"(?:(?:{'|'.join(_NAMES)})e? ?[0-9]{{1,2}}[ ,]*){{2,}}", re.I)

# Texts that are nothing but an unset value.
UNSET = {"undefined", "null", "nan", "[object object]"}

_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"(?<=[.!?;])\s+|\s*\n\s*")
_STRETCH = re.compile(r"[^.!?;\n]{20,}")
_SPACES = str.maketrans("\t\n\v\f\r\u00a0", "      ")
# The end of a message's variable tail: a code, or what was being done.
_CODE = re.compile(r"\b0x[0-9a-f]+\b\)?|\b(?:code|error|fehler|erreur|código|код)\b[ .:#]*[0-9][0-9a-f-]*\b\)?|\((?:status|reference|ref|request|id)\b[^()]*[0-9][^()]*\)")
_DOING = re.compile(r"\s+while \w+ing\b")
_DETAILS = re.compile(r"\s*:\s|\s+[-–—]\s")
_CODED = re.compile(r"\w+\s?!|\w+[ .:#]*(?:[0-9]{3}\b|0x[0-9a-f]+)")
_LABEL = re.compile(r"\s*(?:[A-Za-z]|[0-9]{1,3}(?:\.[0-9]+)*)[.)]\s+")


def _listed(text: str) -> list[str]:
    return [" ".join(x.split()) for x in text.split(";") if x.strip()]


def _shapes(phrase: str) -> list[str]:
    """Skeletons of a phrase; only capitals of some letters look alike, so each letter case has its own."""
    marked = (phrase, phrase.replace("'", "’")) if "'" in phrase else (phrase,)
    return list(dict.fromkeys(skeleton(x).lower() for p in marked for x in (p, p.capitalize(), p.upper())))


def _key_runs(least: int = 4) -> set[str]:
    """All stretches of neighbouring keys, forwards and backwards."""
    return {way[a:b] for row in KEY_ROWS for way in (row, row[::-1]) for a in range(len(row)) for b in range(a + least, len(row) + 1)}


def build_automaton() -> ahocorasick.Automaton:
    """The automaton over the lower-case skeletons of all families and the openers of slots."""
    words = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    families = {
        "error": _listed(MESSAGES) + _listed(CELL_ERRORS),
        "state": _listed(STATES),
        "coded": _listed(ERROR_WORDS),
        "noun": _listed(SCRIPT_NOUNS),
        "filler": [f"{a} {b}" for first, second in FILLER for a, b in product(_listed(first), _listed(second))] + _listed(FILLER_WORDS),
        "prompt": PROMPTS,
        "mash": sorted(_key_runs() - WEAK_MASH),
        "weak": sorted(WEAK_MASH),
    }
    for kind, phrases in families.items():
        for shape in dict.fromkeys(x for p in phrases for x in _shapes(p)):
            entries.setdefault(shape, []).append((kind, None))
    for word in DUMMY_WORDS:
        if word not in PLAIN_WORDS:  # those count beside one of these only
            entries.setdefault(word, []).append(("dummy", None))
    for opener, pattern in SLOTS.items():
        entries.setdefault(opener, []).append(("slot", re.compile(pattern)))
    for text, kinds in entries.items():
        words.add_word(text, (len(text), kinds))
    words.make_automaton()
    return words


def _skeletons(words: set[str]) -> frozenset[str]:
    return frozenset(x for w in words for x in _shapes(w))


_NOUNS, _ACTS, _COMPANIONS, _FUNCTION = map(_skeletons, (NOUNS, SCRIPT_ACTS, COMPANIONS, FUNCTION_WORDS))


def _lower(text: str) -> str:
    """Lower case of the same length, so that positions agree."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def repeats(low: str, start: int) -> int:
    """End of a phrase of one to three words said at least three times in a row from ``start``; 0 if there is none."""
    at = start
    for _ in range(3):
        at = low.find(" ", at + 1)
        if at < 0:
            return 0
        phrase = low[start : at + 1]
        if low.startswith(phrase, at + 1) and any(map(str.isalpha, phrase)):
            n, stop = 2, at + 1 + len(phrase)
            while low.startswith(phrase, stop):
                n, stop = n + 1, stop + len(phrase)
            if low.startswith(phrase.rstrip(), stop) and not low[stop + len(phrase) - 1 : stop + len(phrase)].isalnum():
                n, stop = n + 1, stop + len(phrase) - 1
            if n >= 3:
                return min(stop, len(low))
    return 0


def repeated(low: str, start: int) -> list[tuple[int, int]]:
    """The stretches from any word start behind ``start`` in which :func:`repeats` finds a phrase said over and over."""
    words = low.split()
    # Three phrases of n words agree with what stands n words on in 2n words, the last of which may carry a full stop.
    if not (b"\1" in bytes(map(eq, words, words[1:])) or b"\1\1\1" in bytes(map(eq, words, words[2:])) or b"\1\1\1\1\1" in bytes(map(eq, words, words[3:]))):
        return []
    spaced = low.translate(_SPACES)
    words = spaced[start:].split(" ")
    out, at, done = [], start, 0
    for i, word in enumerate(words):
        if word and at >= done and any(word == x for x in words[i + 1 : i + 4]) and (stop := repeats(spaced, at)):
            out.append((at, stop))
            done = stop
        at += len(word) + 1
    return out


def mash_runs(low: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The runs of neighbouring mash words that hold one beyond doubt, or the same one twice."""
    runs: list[list] = []
    for a, b, kind in sorted(found):
        if runs and not any(map(str.isalnum, low[runs[-1][1] : a])):
            runs[-1][1] = b
        else:
            runs.append([a, b, False, []])
        runs[-1][2] |= kind == "mash" or low[a:b] in runs[-1][3]
        runs[-1][3].append(low[a:b])
    return [(a, b) for a, b, sure, _ in runs if sure]


def _near(words: list[tuple], i: int, j: int, wanted: frozenset[str]) -> int | None:
    """The word of ``wanted`` nearest to the words ``i`` to ``j``, at most GAP words away."""
    for gap in range(1, GAP + 2):
        for at in (i - gap, j + gap):
            if 0 <= at < len(words) and words[at][2] in wanted:
                return at
    return None


def _goes_on(plain: str, low: str, words: list[tuple], i: int, e: int) -> bool:
    """Whether the clause goes on behind word ``i`` with something that no message says."""
    for (_, stop, _), (start, _, word) in zip(words[i:], words[i + 1 :], strict=False):
        if plain[start].isupper() or any(c in ",;:([–—-" for c in plain[stop:start]):
            return False
        if not (word in _FUNCTION or word in _COMPANIONS or word in _NOUNS or word.isdigit()):
            return True
    return False


def _judge(plain: str, low: str, s: int, e: int, spans: list[tuple[int, int, str]], covered: bytearray, min_coverage: float) -> set[str]:
    """The kinds of residue in the sentence ``s`` to ``e``; what counts in it is marked in ``covered``."""
    words = [(m.start(), m.end(), low[m.start() : m.end()]) for m in _WORD.finditer(plain, s, e)]
    if not words:  # error values and the like
        return {k for a, b, k in spans if k == "error" and any(covered[a:b])}
    starts, stops = [w[0] for w in words], [w[1] for w in words]
    kinds, hit = set(), set()
    opening = words[0][0]
    latin = any(kind == "dummy" for *_, kind in spans)
    for a, b, kind in spans:
        inside = range(bisect_right(stops, a), bisect_left(starts, b))
        if not inside and kind not in ("error", "filler"):
            continue
        if kind in ("state", "noun"):
            other = _near(words, inside[0], inside[-1], _NOUNS if kind == "state" else _ACTS)
            if other is None:
                continue
            inside = range(min(other, inside[0]), max(other, inside[-1]) + 1)
            if kind == "state" and _goes_on(plain, low, words, inside[-1], e):
                continue
        elif kind == "coded":
            got = _CODED.match(low, a, e)
            if not got:
                continue
            b = got.end()
        kinds.add({"state": "error", "coded": "error", "noun": "script", "dummy": "filler", "prompt": "filler"}.get(kind, kind))
        hit.update(inside)
        start = min([a, *(words[i][0] for i in inside)])
        stop = max([b, *(words[i][1] for i in inside)])
        covered[start:stop] = b"\1" * (stop - start)
        if kind in ("dummy", "filler"):
            tail = None
        elif start <= opening or all(words[i][2] in _FUNCTION or words[i][2].isdigit() for i in range(min(inside, default=0))):
            tail = kind
        else:
            tail = None
        if tail == "prompt" or (tail in ("error", "coded") and (_DOING.match(low, stop, e) or _DETAILS.match(low, stop, e))):
            # The tail ends where a new capital begins another sentence.
            last = next((i for i in range(bisect_left(starts, stop) + 1, len(words)) if plain[words[i][0]].isupper() and words[i][2] not in _NOUNS), len(words))
            hit.update(range(last))
            covered[s : words[last - 1][1]] = b"\1" * (words[last - 1][1] - s)
        elif tail and (code := _CODE.search(low, stop, e)):
            hit.update(range(bisect_left(starts, code.end())))
            covered[s : code.end()] = b"\1" * (code.end() - s)
    if not kinds:
        return kinds
    if latin:
        for i, w in enumerate(words):
            if w[2] in PLAIN_WORDS:
                hit.add(i)
                covered[w[0] : w[1]] = b"\1" * (w[1] - w[0])
    if latin and len(words) >= 4 and not any(w[2] in _FUNCTION and w[2] not in _LATIN_WORDS for w in words):
        hit.update(range(len(words)))  # dummy Latin with words of its own
        covered[s:e] = b"\1" * (e - s)
    core = set(hit)
    for i, w in enumerate(words):
        if w[2] in _COMPANIONS or w[2] in _NOUNS:
            hit.add(i)
            covered[w[0] : w[1]] = b"\1" * (w[1] - w[0])
    said = [i for i, w in enumerate(words) if not w[2].isdigit() and (i in hit or w[2] not in _FUNCTION)]
    matched = sum(words[i][1] - words[i][0] for i in said if i in hit)
    required = "shall" in (w[2] for w in words) and not kinds & {"filler"}  # a requirement, not a message
    if not required and matched >= min_coverage * max(1, sum(words[i][1] - words[i][0] for i in said)):
        return kinds
    # A message that opens the sentence and is followed by a new capital was run together with it.
    stop = next((i for i, w in enumerate(words) if i not in core and ((i and plain[w[0]].isupper()) or (i not in hit and w[2] not in _FUNCTION and not w[2].isdigit()))), len(words))
    if 0 < stop < len(words) and plain[words[stop][0]].isupper() and sum(words[i][1] - words[i][0] for i in range(stop) if i in hit) >= 12 and stop - 1 in hit:
        return kinds
    return set()


def says_the_same(words: list[str]) -> bool:
    """Whether a sentence of seven words or more without function words has few different ones."""
    return len(words) >= 7 and len(set(words)) <= 0.7 * len(words) and _FUNCTION.isdisjoint(words) and all(map(str.isalpha, words))


def scan(text: str | None, automaton: ahocorasick.Automaton, min_coverage: float = MIN_COVERAGE) -> tuple[str, float] | None:
    """The kinds found and the matched share of the text; None if the text is clean, null or empty."""
    if not text:
        return None
    plain = skeleton(text)
    low = _lower(plain)
    spans: list[tuple[int, int, str]] = []
    mash: list[tuple[int, int, str]] = []
    kinds = set()
    last_slot = -1
    for end, (size, hits) in automaton.iter(low):
        start = end + 1 - size
        for kind, pattern in hits:
            if pattern is None:
                before, after = low[start - 1] if start else " ", low[end + 1] if end + 1 < len(low) else " "
                if not (before.isalnum() and low[start].isalnum()) and not (after.isalnum() and low[end].isalnum()):
                    (mash if kind in ("mash", "weak") else spans).append((start, end + 1, kind))
            elif start >= last_slot and (got := pattern.match(plain, start)):
                kinds.add("slot")
                last_slot = got.end()
                spans.append((start, got.end(), "slot"))
    label = _LABEL.match(plain)
    body = label.end() if label else 0
    if low[body:].strip() in UNSET:
        return "error", 1.0
    every = low[body:].split()
    if len(set(every)) < len(every):
        spans += ((a, b, "filler") for a, b in repeated(low, body))
        if len(set(every)) <= 0.85 * len(every):
            for m in _STRETCH.finditer(low, body):
                if says_the_same(m[0].split()):
                    spans.append((m.start(), m.end(), "filler"))
    if mash:
        spans += ((a, b, "filler") for a, b in mash_runs(low, mash))
    if "1" in low and any(w in low for w in _NAMES):
        spans += ((m.start(), m.end(), "filler") for m in SELF_NAMED.finditer(plain))
    if not spans:
        return None
    spans.sort()
    covered = bytearray(len(plain))
    for a, b, kind in spans:
        if kind in ("slot", "error", "filler", "prompt"):
            covered[a:b] = b"\1" * (b - a)
    bounds = [body, *(m.end() for m in _END.finditer(plain, body)), len(plain)]
    others = [x for x in spans if x[2] != "slot"]
    first = [x[0] for x in others]
    for s, e in zip(bounds, bounds[1:], strict=False):
        if inside := others[bisect_left(first, s) : bisect_left(first, e)]:
            kinds |= _judge(plain, low, s, e, inside, covered, min_coverage)
    words = [m for m in _WORD.finditer(plain, body) if not m[0].isdigit() and low[m.start() : m.end()] not in _FUNCTION]
    whole, matched = sum(m.end() - m.start() for m in words), sum(sum(covered[m.start() : m.end()]) for m in words)
    share = round(matched / whole, 4) if whole else 1.0
    if not kinds and others and whole and share >= min_coverage and any(k in ("error", "filler", "prompt") for *_, k in others):
        kinds = {"filler" if k == "prompt" else k for *_, k in others if k in ("error", "filler", "prompt")}
    return (",".join(sorted(kinds)), share) if kinds else None


def paragraphs(bundles: DataFrame, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """``file_key, paragraph_index`` and ``fields`` of all entries; rows without key or index do not count.

    Zipping single fields lets the scan read only those of the nested column.
    """
    names = ("paragraph_index", *fields)
    rows = F.inline(F.arrays_zip(*(F.col(f"paragraphs.{c}") for c in names))).alias(*names)
    return bundles.where("file_key is not null").select("file_key", rows).where("paragraph_index is not null")


def find_residue(rows: DataFrame, keys: list[str], text: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``keys, kinds, coverage`` of the rows whose ``text`` holds residue; repeats give one row.

    Null and empty texts hold none; an empty table gives an empty result. Only the key columns
    and the text travel to Python, and only found rows are shuffled (to drop repeats).
    """
    picked = rows.select(*keys, F.col(text).alias("__text")).where("__text <> ''")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "__text") + ", kinds string, coverage double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        for batch in batches:
            found = [(i, got) for i, t in enumerate(batch.column("__text").to_pylist()) if (got := scan(t, automaton, min_coverage))]
            if found:
                at = pa.array([i for i, _ in found], pa.int64())
                out = [batch.column(k).take(at) for k in keys]
                yield pa.RecordBatch.from_arrays([*out, pa.array([g[0] for _, g in found]), pa.array([g[1] for _, g in found])], names=[*keys, "kinds", "coverage"])

    return picked.mapInArrow(run, schema).groupBy(*keys).agg(F.min("kinds").alias("kinds"), F.max("coverage").alias("coverage"))


def exclude_residue(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The rows without residue: ``rows`` left-anti-joined with the found keys."""
    return rows.join(find_residue(rows, keys, text).select(*keys), keys, "left_anti")
