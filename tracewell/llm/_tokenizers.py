"""Whether a tokenizer parts texts at white space, so that words can be taken one by one."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

SPACES = " \t\n\r\x0b\x0c"
#: One of each kind of character that rules tell apart, and endings with an apostrophe.
KINDS = ("a", "B", "1", "!", "'", "'s", "'re", "\u00e9", "e\u0301", "\u0301", "\u6f22", "\u00a0", "\u200b", "<", "_", "\U0001f600")


def parts_at_space(pieces: Callable[[str], list], specials: list[str]) -> bool:
    """True where no special string has white space and all pairs of kinds of characters are cut at each white space as alone."""
    if any(c.isspace() for s in specials for c in s):
        return False
    alone = {k: pieces(k) for k in KINDS}
    return all(pieces(a + s + b) == alone[a] + alone[b] for a, s, b in product(KINDS, SPACES, KINDS))
