"""Residue that the pattern families were not written from, and requirements that look like it."""

import pytest

from docframe.llm import residue

HELD_OUT = [
    'Seite konnte nicht geladen werden',
    'Pagina non trovata',
    'JavaScript muss aktiviert sein',
    'Vivamus pharetra posuere sapien',
    'The requested URL was not found on this server.',
    "This page isn't available right now. Please try again later.",
    "We're sorry, but something went wrong.",
    '404 Not Found',
    'Error 502: Bad Gateway',
    'HTTP 403 Forbidden',
    'Sorry, the file you requested could not be found.',
    'This website requires cookies to be enabled.',
    'You must enable JavaScript in order to use this site.',
    'JavaScript must be enabled to view this content.',
    'Your browser does not support JavaScript.',
    'Please turn on JavaScript and reload.',
    'This content could not be displayed.',
    'The image cannot be displayed. Your computer may not have enough memory to open the image.',
    'Unable to connect to the database.',
    "Oops! That page can't be found.",
    'Connection timed out',
    'Diese Seite ist derzeit nicht verfügbar.',
    'Bitte JavaScript aktivieren, um diese Seite anzuzeigen.',
    'Cookies müssen aktiviert sein.',
    'Die angeforderte Datei wurde nicht gefunden.',
    'Fehler 404: Seite nicht gefunden',
    'Impossible de charger la page.',
    "Cette page n'est pas disponible.",
    "Le document n'a pas pu être ouvert.",
    'Vous devez activer les cookies pour continuer.',
    'JavaScript est désactivé dans votre navigateur.',
    'No se pudo cargar la página.',
    'El archivo solicitado no existe.',
    'Debe habilitar JavaScript para ver esta página.',
    'Esta página requiere JavaScript.',
    'Не удалось загрузить страницу.',
    'Файл не найден',
    'Для работы сайта необходимо включить JavaScript.',
    'Документ недоступен. Попробуйте позже.',
    'Ошибка 500',
    'Morbi leo risus, porta ac consectetur ac, vestibulum at eros.',
    'Nullam quis risus eget urna mollis ornare vel eu leo.',
    'Insert your text here',
    '[Insert company name]',
    'Enter title here',
    'Title goes here',
    'Lorem ipsum',
    'Sample text sample text sample text',
    'Hier Text einfügen',
    'Saisissez votre texte ici',
    'Escriba su texto aquí',
    'Введите текст здесь',
    'To be determined',
    'TBD',
    'Placeholder paragraph',
    'asdf asdf asdf',
    'qwertyuiop asdfghjkl',
    'test test test test',
    'Click here to enter text.',
    '{{project.name}}',
    'Choose an item.',
    'Error! Reference source not found.',
    'Fehler! Verweisquelle konnte nicht gefunden werden.',
    'Erreur ! Source du renvoi introuvable.',
    '¡Error! Marcador no definido.',
    'Ошибка! Источник ссылки не найден.',
    'Access to this page has been denied.',
    'Página não encontrada',
    'Your request could not be processed.',
    'Please log in to view this document.',
    'Page introuvable (404)',
    'Session timed out, please log in again',
    'NullPointerException at line 20',
    'undefined',
    '[object Object]',
    'NaN',
]
GENUINE = [
    'Enable scripting on the operator workstation and record each change.',
    'Controller shall show the text "page not found" when the web module is offline.',
    'Error logs shall be kept for 30 days by the control server.',
    'Access to the plant room is denied to other trades during the flush.',
    'Provide placeholder plates at unused openings in the rack.',
    "A session with the owner's staff shall be held; expired manuals shall be removed.",
    'Insert the sleeve before the concrete is placed.',
    'Replace this section of pipe if damaged.',
    'If the document cannot be opened, the contractor shall send it again in another format.',
    'Submit samples of text for nameplates.',
    'Replace missing or damaged section of duct.',
    'The reference standard is not available for review until award.',
    'Where service is not available, provide a generator.',
    'Documents missing from the submittal shall be supplied within 5 days.',
    'Pump, valve, strainer, gauge and hanger',
    'Sample panels',
    'Connection to the main is not available before phase 2.',
    'Sections',
    'Not used',
    'To be completed by the contractor before handover of the area',
    'Bookmarks in the record file shall match the section titles.',
    'The web server shall support JavaScript and cookies on the operator page.',
    'Use of cookies on the web interface shall be documented.',
    'Der Server ist im Technikraum aufzustellen.',
    'Les documents manquants doivent être fournis.',
    'Integer values only',
    'Provide access for service.',
    'Porta et cras',
    'None',
    'Null Point Station shall be surveyed.',
    'The dummy unit carries no load.',
]
AUTOMATON = residue.build_automaton()


@pytest.mark.parametrize("text", HELD_OUT)
def test_held_out_residue(text):
    assert residue.scan(text, AUTOMATON)
    assert residue.scan(f"B. {text}", AUTOMATON)


@pytest.mark.parametrize("text", GENUINE)
def test_requirements_stay(text):
    assert residue.scan(text, AUTOMATON) is None


def test_residue_beside_real_text():
    real = "The contractor shall check each valve before the pipe is closed."
    for text in ("Page not found.", "Please enable JavaScript.", "Lorem ipsum dolor sit amet.", "asdf asdf qwer.", "Your text goes here."):
        assert residue.scan(f"{real} {text}", AUTOMATON) and residue.scan(f"{text} {real}", AUTOMATON)


def test_dummy_latin_with_words_of_its_own():
    assert residue.scan("Lorem zorbit vanex quillum darent.", AUTOMATON)
    assert residue.scan("Zorbit vanex zorbit zorbit quillum vanex zorbit.", AUTOMATON)
    assert residue.scan("Zorbit vanex quillum darent mefis.", AUTOMATON) is None  # nothing known and nothing repeated: not told from a list


def test_coverage_is_that_of_the_whole_text():
    (_, whole), (_, beside) = (residue.scan(t, AUTOMATON) for t in ("Page not found.", "Page not found. The contractor shall check each valve before the pipe is closed."))
    assert whole == 1.0 and 0.1 < beside < 0.5


def test_long_texts_take_time_in_proportion():
    """A megabyte of residue, of near misses and of real text, each in one paragraph."""
    assert residue.scan("lorem ipsum dolor sit amet " * 40_000, AUTOMATON) == ("filler", 1.0)
    assert residue.scan("The page was not found on the server. " * 20_000, AUTOMATON)[0] == "error"
    assert residue.scan("[insert x] {{y}} " * 30_000, AUTOMATON)[0].endswith("slot")
    assert residue.scan("Provide the pump with care and test it. " * 30_000, AUTOMATON) is None
