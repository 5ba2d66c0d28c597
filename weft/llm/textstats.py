"""Counts over one text that several operators use; words are runs outside [\\x20\\x09-\\x0D]."""

from __future__ import annotations

from collections import Counter

import numpy as np

SYMBOLS = "#*$%&|<>"


def words_of(text: str) -> list[bytes]:
    """The words, as UTF-8; bytes.split() parts at exactly [\\x20\\x09-\\x0D]."""
    return text.encode("utf-8", "surrogatepass").split()


def count_of(text: str, chars: str) -> int:
    return sum(map(text.count, chars))


def repeated_window_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found at least twice in the text, first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(size))))
    if len(set(windows)) == n:
        return 0
    found = Counter(windows)
    starts = np.fromiter((found[w] > 1 for w in windows), np.bool_, n)
    edge = np.zeros(len(words) + 1, np.int32)
    edge[:n] += starts
    edge[size : size + n] -= starts
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(lines: list[str]) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)."""
    seen: set[str] = set()
    duplicates = filled = 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            filled += 1
            duplicates += line in seen
            seen.add(line)
    return duplicates, filled
