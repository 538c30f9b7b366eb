"""Words of a text for comparison: lower case, without accents, whatever separates them."""

from __future__ import annotations

import re
import unicodedata

_BREAK = re.compile(r"(?<=\w)[-\u00ad\u2010]\s*\n\s*(?=\w)")
_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200d\ufeff]+")
_OTHER = re.compile(r"[^\x00-\x7f\w]+")
# ASCII letters and digits and all bytes beyond ASCII are parts of words.
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words in UTF-8. A word broken at the end of a line is one word; soft hyphens don't count."""
    if not text:
        return []
    if "-\n" in text or "- \n" in text or "\u00ad\n" in text or "\u2010\n" in text:
        text = _BREAK.sub("", text)
    if text.isascii():
        return text.lower().encode().translate(_TABLE).split()
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold())).replace("\u00b0", " ").replace("\u03bc", "u")
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    return text.encode("utf-8", "ignore").translate(_TABLE).split()
