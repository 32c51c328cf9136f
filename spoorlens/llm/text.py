"""Text normal forms shared by the text operators; plain Python, used inside Arrow batches."""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from functools import lru_cache

_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|mark|s|small|span|strong|sub|sup|u)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z!][^<>]*>", re.S)
_TARGET = re.compile(r"\]\([^()\s]*\)")
_BROKEN = re.compile(r"(?<=[^\W\d_]{2})[-‐‑­][ \t ]*\r?\n[ \t >]*(?=[^\W\d_])")
_MOJIBAKE = re.compile(r"[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{1,3}")
WORD = re.compile(r"[^\W_]+")


@lru_cache(1)
def _dropped() -> dict[int, None]:
    """Marks and invisible format characters, by the Unicode category of each code point."""
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf")}


def _mended(m: re.Match) -> str:
    """UTF-8 that was read as a one-byte code page, read again; unchanged if it isn't that."""
    try:
        return b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in m[0]).decode("utf-8")
    except UnicodeError:
        return m[0]


def plain(text: str) -> str:
    """Lower case without markup, accents, invisible characters and line-end hyphens; spacing kept."""
    if not text.isascii():
        text = _MOJIBAKE.sub(_mended, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "](" in text:
        text = _TARGET.sub("] ", text)
    text = _BROKEN.sub("", text)
    text = text.casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_dropped())
    return text.replace("*", "").replace("_", "") if "*" in text or "_" in text else text


def words(text: str | None) -> tuple[list[str], list[int]]:
    """Tokens (runs of letters and digits) of the plain text, and the number of the spaced word of each."""
    tokens, of = [], []
    for k, w in enumerate(plain(text or "").split()):
        if w.isalnum():
            tokens.append(w)
            of.append(k)
            continue
        for t in WORD.findall(w):
            tokens.append(t)
            of.append(k)
    return tokens, of
