"""Character classes and look-alike letters shared by the text operators."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of Latin, Cyrillic and Greek that look alike, aligned by position.
LATIN_OF_CYRILLIC = "ABCEHIJKMOPSTXYaceijopsxyhdqwvY"
CYRILLIC = "АВСЕНІЈКМОРЅТХУасеіјорѕхуһԁԛԝѵҮ"
LATIN_OF_GREEK = "ABEZHIKMNOPTYXovpaiukxy"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονραιυκχγ"

TO_LATIN = dict(zip(map(ord, CYRILLIC + GREEK), LATIN_OF_CYRILLIC + LATIN_OF_GREEK, strict=True))

# Compatibility characters that are signs of their own and stay as they are.
KEPT_SIGNS = "…‥·™℠℡№″‴⁗´¨¯¸ªº℃℉"
#: Decompositions that only change the look of a character; others (fractions, super- and subscripts) change its meaning.
FOLDED_TAGS = ("<wide>", "<narrow>", "<small>", "<vertical>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<square>", "<compat>")
# Default-ignorable characters outside the categories Cf and Cc.
OTHER_INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))


@lru_cache(maxsize=1 << 16)
def fold_char(ch: str) -> tuple[str, str]:
    """The plain form of one character and why it changed: width, space, invisible or nothing."""
    kind = unicodedata.category(ch)
    if ch in "\t\n\r":
        return ch, ""
    if kind in ("Cf", "Cc") or ch in OTHER_INVISIBLE:
        return "", "invisible"
    if kind in ("Zs", "Zl", "Zp"):
        return " ", "" if ch == " " else "space"
    if ch == "μ":
        return "µ", ""
    parts = unicodedata.decomposition(ch)
    if parts.startswith(FOLDED_TAGS) and ch not in KEPT_SIGNS:
        plain = unicodedata.normalize("NFKC", ch)
        return ("µ", "") if ch == "µ" else (plain, "width" if any(map(str.isalnum, plain)) or parts.startswith(("<wide>", "<narrow>", "<small>")) else "")
    return ch, ""


COMBINING = re.compile("[̀-ͯ]")


def fold(text: str) -> tuple[str, set[str]]:
    """Compatibility form of ``text`` without ignorable characters, canonically composed.

    The reasons are a subset of width, space, invisible and combining; the text may change
    without a reason where a sign only has another code (such as the ohm sign).
    """
    plain, why = [], set()
    for ch in text:
        if ch < "\x7f" and ch >= " ":
            plain.append(ch)
            continue
        got, reason = fold_char(ch)
        plain.append(got)
        if reason:
            why.add(reason)
    joined = "".join(plain)
    composed = unicodedata.normalize("NFC", joined)
    if len(composed) < len(joined) and COMBINING.search(text):
        why.add("combining")
    return composed, why


class _Plain(dict):
    """A translation table that folds each character once and remembers it."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        self[code] = plain = ch if " " <= ch < "\x7f" else fold_char(ch)[0]
        return plain


class _Latin(dict):
    """Look-alike letters as Latin ones, everything else as it is."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


_PLAIN, _LATIN = _Plain(), _Latin({k: ord(v) for k, v in TO_LATIN.items()})


def skeleton(text: str) -> str:
    """``text`` folded, with look-alike letters as Latin ones; equal for texts that look equal."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_PLAIN)).translate(_LATIN)
