"""Long texts in blocks, so that memory follows the block and not the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Code points of a text handled at once.
BLOCK_CHARS = 1 << 20


def blocks(text: str, separator: re.Pattern, size: int = BLOCK_CHARS) -> Iterator[str]:
    """Consecutive pieces of ``text`` of about ``size`` code points; a cut falls only where ``separator`` matches.

    ``separator`` matches one code point that no token holds, so the tokens of
    the pieces are those of the text.  A piece is longer where no separator
    comes for a while.
    """
    at, n = 0, len(text)
    while n - at > size:
        found = separator.search(text, at + size)
        if found is None:
            break
        yield text[at: found.end()]
        at = found.end()
    yield text[at:] if at else text


def ascii_lower(text: str) -> str:
    """``text`` with A-Z lower-cased and nothing else (lone surrogates stay)."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
