"""Splits texts as the public byte-level tokenizers do, with arrays instead of a regex.

The pattern is ``public_tokenizers.PATTERN``: contractions, then a letter,
number or other run with at most one space before it, then white space.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
#: The code points with the Unicode property White_Space.
WHITE_SPACE = (
    [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680]
    + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
        np.uint8,
        sys.maxunicode + 1,
    )
    out[WHITE_SPACE] = SPACE
    return out


def split(text: str) -> list[str]:
    """The matches of the pattern; together they are the whole text."""
    n = len(text)
    if n < 2:
        return [text] if text else []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[code]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    space = kind == SPACE
    # the last white space before something else is a token of its own, or,
    # if it is U+0020, the beginning of what follows
    last = np.flatnonzero(space[:-1] & ~space[1:])
    start[last] = True
    start[last[code[last] == 0x20] + 1] = False
    # 's 't 'm 'd 're 've 'll where a token begins with the apostrophe alone
    quote = np.flatnonzero((code[:-1] == 0x27) & (kind[1:] == LETTER) & start[:-1])
    for i in quote.tolist():
        size = 2 if text[i + 1] in "stmd" else 3 if text[i + 1 : i + 3] in ("re", "ve", "ll") else 0
        if size:
            start[i + 1] = False
            if i + size < n:
                start[i + size] = True
    at = np.flatnonzero(start).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], n])]
