"""Small helpers for building regular expressions on the driver."""

from __future__ import annotations

import re
from collections.abc import Sequence


def any_of(words: Sequence[str], head: bool = False, tail: bool = False) -> str:
    """Pattern that matches any of the literal ``words``."""
    if not words:
        raise ValueError("an empty word list matches nothing; handle it before building a pattern")
    body = "|".join(re.escape(w) for w in words)
    return ("^" if head else "") + f"(?:{body})" + (r"\z" if tail else "")
