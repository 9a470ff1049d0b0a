"""Column functions on plain text: lines, white space, case, markers, roles, boilerplate."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acronyms that title case keeps.
ACRONYMS = [
    "HVAC", "DDC", "VAV", "BAS", "BACNET", "AHU", "RTU", "VFD", "MAU", "ERV", "HRV", "FCU", "WSHP", "DX", "CHW", "HHW", "CW", "TAB", "MEP",
    "ASHRAE", "SMACNA", "NFPA", "UL", "ASTM", "PVC", "CPVC", "HDPE", "FRP", "BTU", "CFM", "GPM", "PSI",
]
# Which roles may stand in for a role, in order of preference.
FALLBACKS = {
    "SectionID": ["SectionID", "SectionTitle"],
    "SectionTitle": ["SectionTitle"],
    "PART": ["PART"],
    "ARTICLE": ["ARTICLE"],
    "PARAGRAPH": ["PARAGRAPH"],
    "SUBPARAGRAPH": ["SUBPARAGRAPH", "PARAGRAPH"],
    "SUBSUBPARAGRAPH": ["SUBSUBPARAGRAPH", "SUBPARAGRAPH", "PARAGRAPH"],
    "END_OF_SECTION": ["END_OF_SECTION"],
}
ROLES = ["SectionID", "SectionTitle", "PART", "ARTICLE", "PARAGRAPH", "SUBPARAGRAPH", "SUBSUBPARAGRAPH"]

# Patterns of section numbers, headings and outline labels, in a form that Java and RE2 read alike.
SECTION_ID = r"^\s*(?i:SECTION)\s+[0-9]{2}(\s+[0-9]{2}){2,}([^0-9A-Za-z_]|$)"
END_OF_SECTION = r"^\s*(?i:END\s+OF\s+SECTION)"
PART = r"^\s*(?i:PART)\s+[123]([^0-9A-Za-z_]|$)"
ARTICLE = r"^\s*[0-9]+\.[0-9]{2}([^0-9A-Za-z_]|$)"
ALL_CAPS = r"^[^a-z]*[A-Z][^a-z]*$"
# White space and letters with case in any script, for Java.
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"
CASED = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]"
MARKERS = [("upper_alpha", r"^\s*[A-Z]\.\s+"), ("number", r"^\s*[0-9]+\.\s+"), ("lower_alpha", r"^\s*[a-z]\.\s+")]


def lines(text: Column) -> Column:
    """The lines of a text; any of CR LF, CR and LF ends a line. Null gives null."""
    return F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n")


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def nullif_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def marker_type(text: Column, num_id: Column | None = None) -> Column:
    """Kind of outline label: upper_alpha, number, lower_alpha, else list_numpr if numbered, else null."""
    kind = F.lit(None).cast("string") if num_id is None else F.when(F.coalesce(num_id, F.lit("")) != "", "list_numpr")
    for name, pattern in reversed(MARKERS):
        kind = F.when(text.rlike(pattern), name).otherwise(kind)
    return kind


def rule_role(text: Column, marker: Column, previous: Column, in_table: Column) -> Column:
    """Role by rule, the first that holds; null inside tables, for empty texts, and where no rule holds.

    A title is an all-capitals text right after a section number.
    """
    return (
        F.when(in_table | (F.coalesce(text, F.lit("")) == ""), F.lit(None))
        .when(text.rlike(SECTION_ID), "SectionID")
        .when(text.rlike(END_OF_SECTION), "END_OF_SECTION")
        .when(text.rlike(PART), "PART")
        .when(text.rlike(ARTICLE), "ARTICLE")
        .when(F.coalesce(previous.rlike(SECTION_ID), F.lit(False)) & text.rlike(ALL_CAPS), "SectionTitle")
        .when(marker == "upper_alpha", "PARAGRAPH")
        .when(marker.isin("number", "list_numpr"), "SUBPARAGRAPH")
        .when(marker == "lower_alpha", "SUBSUBPARAGRAPH")
    )


def available_role(role: Column, available: Column) -> Column:
    """The first stand-in of ``role`` among the ``available`` ones; an unknown role stands for itself."""
    chain = F.create_map(*(x for k, v in FALLBACKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    chain = F.coalesce(F.element_at(chain, role), F.array(role))
    return F.when(role.isNotNull(), F.get(F.filter(chain, lambda r: F.array_contains(available, r)), F.lit(0)))


def _words(text: Column) -> Column:
    """The words of a text between white space of any script."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _title_run(run: Column) -> Column:
    first, low = F.substring(run, 1, 1), F.lower(run)
    return F.concat(F.translate(F.upper(first), "ǄǇǊǱ", "ǅǈǋǲ"), low.substr(F.length(F.lower(first)) + 1, F.length(low)))


def _title_part(part: Column) -> Column:
    letters = F.upper(F.regexp_replace(part, "[^A-Za-z]", ""))
    # The comparison alone settles most words, and only the rest meets the patterns.
    is_upper = (F.upper(part) == part) & part.rlike(r"\p{IsUppercase}") & ~part.rlike(r"[\p{IsLowercase}\p{Lt}]")
    # Capitals start after every sign without case, as in "O'BRIEN" to "O'Brien".
    runs = F.regexp_extract_all(part, F.lit(f"({CASED}+|[^{CASED[1:-1]}]+)"), F.lit(1))
    titled = F.array_join(F.transform(runs, _title_run), "")
    return F.when(~is_upper, part).when(letters.isin(ACRONYMS), part).otherwise(titled)


def title_case(text: Column) -> Column:
    """All-capital words in title case, hyphen parts each on their own; acronyms and mixed words stay.

    Letters of any script count, acronyms are ASCII; white space runs become one blank.
    """
    parts = lambda w: F.array_join(F.transform(F.split(w, "-"), _title_part), "-")
    return F.array_join(F.transform(_words(text), lambda w: F.when(w.contains("-"), parts(w)).otherwise(_title_part(w))), " ")


def case_pattern(text: Column) -> Column:
    """unknown (no text), upper, title (at least 70 % of the words capitalised) or mixed."""
    words = _words(text)
    capital = F.filter(words, lambda w: w.rlike(r"^\p{IsUppercase}"))
    stripped = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return (
        F.when(stripped == "", "unknown")
        .when(stripped == F.upper(stripped), "upper")
        .when(F.size(capital) * 10 >= F.size(words) * 7, "title")
        .otherwise("mixed")
    )


def apply_case(text: Column, pattern: Column) -> Column:
    """``text`` in the case pattern of another text."""
    return F.when(pattern == "upper", F.upper(text)).when(pattern == "title", title_case(text)).otherwise(text)


def section_number(text: Column) -> Column:
    """The digits after the word section, else all digit groups, joined by blanks."""
    text = F.coalesce(text, F.lit(""))
    named = F.regexp_extract(text, rf"(?iu)section{SPACES}(\p{{Nd}}[\p{{Nd}}{SPACES[1:-2]}]*)", 1)
    groups = F.array_join(F.regexp_extract_all(text, F.lit(r"(\p{Nd}+)"), F.lit(1)), " ")
    return F.trim(F.regexp_replace(F.coalesce(nullif_empty(named), groups), SPACES, " "))


# Own rules for text that does not belong to the specification: pattern and tag, applied in order. Java and RE2 read them alike.
_PART_NOUN = r"(?:sub)?paragraphs?|articles?|options?|definitions?|sentences?|terms?|lists?|requirements?|schedules?"
BOILERPLATE = [
    (r"(?i)[\[(<*]*\s*\b(?:notes? to (?:the )?(?:specifier|editor|designer|spec writer)|(?:specifier|designer|editor|spec writer)(?:'s|s')? notes?)\b[^\n]*", "specifier_note"),
    (r"(?i)\[\s*(?:retain|delete|revise|edit|select|coordinate|insert|verify|specify|indicate)\s[^\]\n]*\b(?:" + _PART_NOUN + r"|below|above)\b[^\]\n]*\]", "masterspec_instruction"),
    (r"(?im)^\s*(?:retain|delete|revise|edit|insert|verify|specify|select|indicate|coordinate|consult|expand)\s[^\n]*\b(?:" + _PART_NOUN + r")\b[^\n]*\b(?:below|above|remaining|if|when|for)\b[^\n]*$", "masterspec_instruction"),
    (r"(?im)^\s*(?:" + _PART_NOUN + r")\s+(?:below|above)\s+(?:is|are|requires?|lists?|applies|apply|may|assumes?|describes?|includes?|specif(?:y|ies))\b[^\n]*$", "masterspec_instruction"),
    (r"(?im)^[^\n]*\bin (?:the )?(?:(?:first|second|third|last|next|two|three|four|both|this|these)\s)*(?:sub)?(?:paragraphs?|articles?) (?:below|above)\b[^\n]*$", "masterspec_instruction"),
    (r"(?im)^\s*options?:\s[^\n]*\bmay be (?:used|specified|included|omitted|deleted|retained)\b[^\n]*$", "masterspec_instruction"),
    (r"(?im)^\s*manufacturers'? (?:catalogs?|catalogues?|literature|data|websites?) (?:indicates?|shows?|states?|lists?)\b[^\n]*$", "masterspec_instruction"),
    (r"(?im)^[^\n]*\bmay permit (?:the )?use of\b[^\n]*$", "masterspec_instruction"),
    (r"(?im)^\s*this section (?:uses|assumes|is based on|does not specify)\b[^\n]*$", "masterspec_instruction"),
    (r"(?im)^\s*see\s[^\n]*\b(?:evaluations?|section text|supporting documents?)\b[^\n]*$", "masterspec_instruction"),
    (r"(?im)^\s*do not (?:duplicate|repeat)\b[^\n]*$", "masterspec_instruction"),
    (r"(?im)^[^\n]*(?:\bcopyright\b|\(c\)|©)[^\n]*[0-9]{4}[^\n]*$", "copyright"),
    (r"(?i)\ball rights reserved\b\.?", "copyright"),
    (r"(?im)^[^\n]*\bunauthori[sz]ed (?:reproduction|copying|use|distribution)\b[^\n]*$", "copyright"),
    (r"(?m)^\s*(?:[-=_*~#]\s?){3,}\s*$", "separator"),
    (r"(?im)^\s*(?:page\s+[0-9]+(?:\s+of\s+[0-9]+)?|-\s*[0-9]+\s*-|[0-9]+ of [0-9]+)\s*$", "page_number"),
    (r"(?im)^\s*(?:rev(?:ision)?\.?\s*[0-9A-Z]{1,3}|revised:?\s[0-9./-]+)\s*$", "revision_mark"),
    (r"(?i)\{[^{}\n]*\brevision\b[^{}\n]*\}", "revision_mark"),
    (r"(?i)<<[^<>\n]*\bhidden\b[^<>\n]*>>", "hidden_text"),
    (r"(?i)\[?\bhidden text\b\]?:?[^\n]*", "hidden_text"),
]

# Per rule, texts of which one stands in whatever the rule hits, in lower case.
_NOUNS = ("paragraph", "article", "option", "definition", "sentence", "term", "list", "requirement", "schedule")
NEEDED = [
    ("note",), ("[",), _NOUNS, ("below", "above"), ("below", "above"), ("option",), ("manufacturer",), ("may permit",), ("this section",), ("see",), ("do not",), ("copyright", "(c)", "©"), ("all rights reserved",),
    ("unauthori",), tuple("-=_*~#"), ("page", "-", " of "), ("rev",), ("{",), ("<<",), ("hidden text",),
]


def strip_boilerplate(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """``struct<text, tags>``: the text without boilerplate and the tags of the rules that hit.

    Rules apply in order, each to what the ones before it left; tags come once, in order of their
    first hit. Only texts that any rule may hit are rewritten, so the fold costs one test for
    all others; a pattern is only tried where one of the texts that it needs stands. Blank line runs and blanks at line ends are tidied.
    """
    needed = NEEDED if rules is None else [()] * len(rules)
    rules = BOILERPLATE if rules is None else rules
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("tags"))
    for pattern, tag in rules:
        state = let(state, _rule_step(pattern, tag))

    def hit(low: Column) -> Column:
        found = F.lit(False)
        for (pattern, _), marks in zip(rules, needed, strict=True):
            may = reduce(or_, (F.contains(low, F.lit(m)) for m in marks)) if marks else F.lit(True)
            found = found | (may & text.rlike(pattern))
        return found

    return let(F.when(let(F.lower(text), hit), state).otherwise(F.struct(text.alias("text"), F.array().cast("array<string>").alias("tags"))), _tidy)


def _rule_step(pattern: str, tag: str) -> Callable[[Column], Column]:
    def step(state: Column) -> Column:
        hit = F.struct(F.regexp_replace(state["text"], pattern, "").alias("text"), F.array_append(state["tags"], F.lit(tag)).alias("tags"))
        return F.when(state["text"].rlike(pattern), hit).otherwise(state)

    return step


def _tidy(folded: Column) -> Column:
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(folded["text"], r"\n{3,}", "\n\n"), r"[ \t]+\n", "\n"), r"^\s+|\s+$", ""))
    return F.struct(tidy.alias("text"), F.array_distinct(folded["tags"]).alias("tags"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
