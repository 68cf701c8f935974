"""Text folding: visually identical text in one form, and vectorised substrings.

`unify` brings look-alike text to one stored form and keeps case and layout; `fold` also lowers
the case and makes each run of white space one space. Both are pure Python functions over one
string; `Grams` holds the substrings of a batch of strings in numpy arrays.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np

# Letters of other scripts that look like Latin ones.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "о": "o", "р": "p",
    "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
}
LOOKALIKES = {**CYRILLIC, **GREEK}
# Marks that look alike.
HYPHENS = "‐‑‒–−﹣－"
MIDDLE_DOTS = "·•‧∙⋅・ㆍ･"
# Ranges of characters that show nothing.
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F),
    (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE007F), (0xE0100, 0xE01EF),
)
#: Ranges whose compatibility form looks the same: full-width forms, Roman numerals, CJK compatibility ideographs,
#: ligatures, letters and digits of mathematical text.
SAME_LOOK = ((0x2160, 0x217F), (0x2F00, 0x2FD5), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x2F800, 0x2FA1F))


def _safe_table() -> dict[int, str | None]:
    """Code point -> replacement, without the letters of other scripts."""
    table: dict[int, str | None] = {}
    for first, last in SAME_LOOK:
        for c in range(first, last + 1):
            n = unicodedata.normalize("NFKC", chr(c))
            if n != chr(c):
                table[c] = n
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Zs" and c != 0x20:
            table[c] = " "
    for first, last in INVISIBLE:
        table.update(dict.fromkeys(range(first, last + 1)))
    table.update({ord(c): "-" for c in HYPHENS} | {ord(c): "·" for c in MIDDLE_DOTS if c != "•"})
    table.update({0x2028: "\n", 0x2029: "\n"})
    return table


SAFE = _safe_table()
FULL = {**SAFE, **{ord(k): v for k, v in LOOKALIKES.items()}}
#: What plain ASCII and composed Hangul do not cover; a short class, since it is tested on every text.
_NEEDS = re.compile("[^\\x00-\\x7e가-힣·※▶○]")
_SPACES = re.compile(r"\s\s+|[^\S ]")
_FOREIGN = re.compile("[" + "".join(LOOKALIKES) + "]")


def needs_unify(s: str) -> bool:
    """Whether s holds any character that unify might change."""
    return not s.isascii() and _NEEDS.search(s) is not None


def unify_marks(s: str) -> str:
    """Everything of `unify` but the letters of other scripts."""
    if not needs_unify(s):
        return s
    return unicodedata.normalize("NFC", s.translate(SAFE))


def unify(s: str) -> str:
    """Invisible characters dropped, look-alike characters made one, composed (NFC)."""
    if not needs_unify(s):
        return s
    return unicodedata.normalize("NFC", s.translate(FULL))


def fold(s: str) -> str:
    """`unify`, lower case, each run of white space one space."""
    return _SPACES.sub(" ", unify(s).lower())


def has_foreign(s: str) -> bool:
    """Whether s holds letters of other scripts that look like Latin ones."""
    return _FOREIGN.search(s) is not None


ALNUM = np.zeros(sys.maxunicode + 1, dtype=bool)
ALNUM[[c for c in range(sys.maxunicode + 1) if chr(c).isalnum()]] = True
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M2
        h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def code_points(texts: list[str], alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after the other, and the length of each.

    alnum keeps only letters and digits.
    """
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    if alnum:
        keep = ALNUM[cp]
        ends = np.concatenate([[0], np.cumsum(keep)])
        stops = np.cumsum(lens)
        lens = ends[stops] - ends[stops - lens]
        cp = cp[keep]
    return cp, lens


def gram_hashes(cp: np.ndarray, lens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, position) of each k-character substring that lies within one text."""
    n = len(cp) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h, width, power = cp.astype(np.uint64) + np.uint64(1), 1, _M1
        done, have = None, 0  # binary powers: the hash of k characters from hashes of 1, 2, 4 ... characters
        bits = k
        while bits:
            if bits & 1:
                if done is None:
                    done, have = h, width
                else:
                    m = min(len(done), len(h) - have)
                    done = done[:m] * power + h[have : have + m]
                    have += width
            bits >>= 1
            if bits:
                h = h[: len(h) - width] * power + h[width:]
                power = power * power
                width *= 2
    starts = np.cumsum(lens) - lens
    doc = np.repeat(np.arange(len(lens)), lens)
    pos = np.arange(len(cp)) - starts[doc] if len(doc) else np.empty(0, np.int64)
    ok = (pos + k <= lens[doc])[:n]
    return mix(done[:n][ok]), doc[:n][ok], pos[:n][ok]


def batches_by_size(texts: list[str | None], limit: int = 1_000_000):
    """Ranges (from, to) of texts that hold about `limit` characters together, one text at least."""
    at, size = 0, 0
    for i, s in enumerate(texts):
        size += len(s or "")
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
