"""Statistics of a whole text, for the quality operators."""

from __future__ import annotations

import math

import numpy as np

from .common import BLANKS

SYMBOLS = "#*$%&|<>"
#: Names of what `ratios` returns.
RATIOS = ("log_words", "word_length", "symbols_a_word", "upper", "digits", "punctuation", "bangs_a_word", "distinct", "log_guiraud", "repeated_windows", "equal_neighbours", "dup_lines", "log_words_a_line", "top_word", "letters", "log_chars")


def counts(text: str | None) -> tuple[dict, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the ratios need; and the words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if x in seen:
            dup += 1
        elif x.strip(BLANKS):
            seen.add(x)
    ids: dict[bytes, int] = {}
    put = ids.setdefault
    w = np.fromiter((put(x, len(ids)) for x in words), dtype=np.int64, count=n)
    repeat = 0
    if n >= 6 and len(ids) < n:
        k = len(ids)
        g = w
        for shift in range(1, 5):  # the windows' ids from those of one word less: exact, no hash
            g = np.unique(g[: n - shift] * k + w[shift:], return_inverse=True)[1]
        often = np.bincount(g)[g] > 1
        if often.any():
            cover = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(often)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            repeat = int((np.cumsum(cover[:-1]) > 0).sum())
    out = {
        "n_words": n, "word_chars": len(text) - sum(text.count(c) for c in BLANKS), "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": dup, "n_repeat_words": repeat, "distinct": len(ids), "lines": len(seen) + dup,
        "neighbours": int((w[1:] == w[:-1]).sum()), "top": int(np.bincount(w).max()) if n else 0,
    }
    return out, words


_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[c for c in range(65, 91)]] = 1
_CLASS[[c for c in range(97, 123)]] = 2
_CLASS[[c for c in range(48, 58)]] = 3
_CLASS[[ord(c) for c in "!?"]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5


def ratios(text: str | None, c: dict) -> list[float]:
    """The numbers named in RATIOS, all finite."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    by = np.bincount(_CLASS[raw], minlength=6) if len(raw) else np.zeros(6, dtype=np.int64)
    n, chars, size = max(c["n_words"], 1), max(c["word_chars"], 1), max(len(raw), 1)
    return [
        math.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / n, by[1] / max(by[1] + by[2], 1), by[3] / chars, by[5] / chars, by[4] / n,
        c["distinct"] / n, math.log1p(c["distinct"] / math.sqrt(n)), c["n_repeat_words"] / n, c["neighbours"] / n, c["n_dup_lines"] / max(c["lines"], 1),
        math.log1p(c["n_words"] / max(c["lines"], 1)), c["top"] / n, (by[1] + by[2]) / size, math.log1p(len(text)),
    ]
