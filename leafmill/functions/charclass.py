"""Character classes as regular-expression sets that Java and RE2 read alike.

Every class is the inside of a bracket expression, so classes can be joined: f"[{WS}{LATIN}]". A character belongs to
the first of: white space, joiners (counted as Indic), bad, Indic, Arabic, Latin, common; what is left is foreign.
"""

from __future__ import annotations

import unicodedata
from functools import cache

# Code point ranges of the scripts and symbols that text layers are judged by.
INDIC_RANGES = [(0x0900, 0x0D7F), (0x1C50, 0x1C7F), (0x1CD0, 0x1CFF), (0xA8E0, 0xA8FF), (0xAAE0, 0xAAFF), (0xABC0, 0xABFF)]
ARABIC_RANGES = [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]
COMMON_RANGES = [(0x00A1, 0x00BF), (0x00D7, 0x00D7), (0x00F7, 0x00F7), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2100, 0x214F), (0x2190, 0x22FF), (0x25A0, 0x25FF), (0x2700, 0x27BF)]
PRIVATE_RANGES = [(0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)]
JOINER_RANGES = [(0x200C, 0x200D)]
# White space as Python's str.split() has it.
SPACE_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
REPLACEMENT = 0xFFFD

Ranges = list[tuple[int, int]]


def without(ranges: Ranges, *others: Ranges) -> Ranges:
    """The ranges less all code points of the others."""
    out = list(ranges)
    for low, high in (r for o in others for r in o):
        out = [piece for a, b in out for piece in ((a, min(b, low - 1)), (max(a, high + 1), b)) if piece[0] <= piece[1]]
    return out


def inside(ranges: Ranges) -> str:
    """Ranges as the inside of a bracket expression."""
    return "".join(f"\\x{{{a:04X}}}" if a == b else f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges)


@cache
def _of_category(*categories: str) -> Ranges:
    """Runs of Indic code points whose general category begins with one of these."""
    out: Ranges = []
    for low, high in INDIC_RANGES:
        for cp in range(low, high + 1):
            if unicodedata.category(chr(cp)).startswith(categories):
                if out and out[-1][1] == cp - 1:
                    out[-1] = (out[-1][0], cp)
                else:
                    out.append((cp, cp))
    return out


#: Control characters that aren't white space, what is for private use, U+FFFD and the two that are never characters.
BAD_RANGES = [*without([(0x00, 0x1F), (0x7F, 0x9F)], SPACE_RANGES), *PRIVATE_RANGES, (REPLACEMENT, 0xFFFF)]

WS = inside(SPACE_RANGES)
#: The same by Java's name for most of it, which is faster than ten ranges. RE2 has no such name.
SPACE = r"\p{IsWhite_Space}\x{1C}-\x{1F}"
LATIN = inside([(0x21, 0x7E)])
INDIC = inside([*INDIC_RANGES, *JOINER_RANGES])
ARABIC = inside(ARABIC_RANGES)
COMMON = inside(without(COMMON_RANGES, SPACE_RANGES, JOINER_RANGES))
BAD = inside(BAD_RANGES)
PRIVATE = inside(PRIVATE_RANGES)
#: Marks that need a base letter before them, and what may stand before them.
MARK = inside(_of_category("Mn", "Mc"))
BASE = inside([*_of_category("L", "M"), *JOINER_RANGES])
#: Not white space and of none of the classes above.
FOREIGN = f"^{WS}{BAD}{INDIC}{ARABIC}{LATIN}{COMMON}"

# Code points without a character are bad as well. Java knows them by category; RE2 has no such name.
UNASSIGNED = r"\p{Cn}"
