"""Places where byte-level BPE pre-splitting can cut a text without changing its tokens.

No match of the pattern holds white space after anything else, and none looks behind itself.
So a cut right before white space that follows something else leaves both sides' matches
as they were: the left side's last match ended there anyway, the right side's first began.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex

FIRST_CUT = regex.compile(r"(?<=\S)(?=\s)")
LAST_CUT = regex.compile(r"(?r)(?<=\S)(?=\s)")


def pieces(text: str, size: int) -> Iterator[str]:
    """Cut text at the last safe place before each multiple of size, or the next one after it."""
    at = 0
    while len(text) - at > size:
        cut = LAST_CUT.search(text, at + 1, at + size + 1) or FIRST_CUT.search(text, at + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]
