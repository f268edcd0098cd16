"""Weighted string similarity of two short texts, 0 to 100.

Built from the published definition: similarity from the longest common subsequence; word-order
and word-set variants count 0.95; when lengths differ by half or more, the best window of the
longer text counts 0.9 (0.6 beyond a factor of 8). Runs on distinct category values only.
"""

from __future__ import annotations

import re

_NOT_WORD = re.compile(r"\W")


def _plain(s: str) -> str:
    return _NOT_WORD.sub(" ", s).lower().strip()


def _ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the summed lengths."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    row = (1 << len(a)) - 1
    full = row
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def _window_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against any window of the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0 if long else 100.0
    n = len(short)
    spans = [long[max(0, i):i + n] for i in range(1 - n, len(long))]
    return max(_ratio(short, s) for s in spans)


def _word_sets(a: str, b: str):
    wa, wb = set(a.split()), set(b.split())
    both = " ".join(sorted(wa & wb))
    return both, " ".join(sorted(wa - wb)), " ".join(sorted(wb - wa))


def _token_ratio(a: str, b: str) -> float:
    """Better of the word-order-free and the word-set ratio."""
    ordered = _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    both, left, right = _word_sets(a, b)
    if both and (not left or not right):
        return 100.0
    la, lb = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = max(ordered, _ratio(la, lb))
    return max(best, _ratio(both, la), _ratio(both, lb)) if both else best


def _token_window_ratio(a: str, b: str) -> float:
    both, left, right = _word_sets(a, b)
    if both:
        return 100.0
    ordered = _window_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(ordered, _window_ratio(left, right))


def weighted_ratio(raw: str, term: str) -> int:
    a, b = _plain(raw), _plain(term)
    if not a or not b:
        return 0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best = _ratio(a, b)
    if spread < 1.5:
        return round(max(best, 0.95 * _token_ratio(a, b)))
    scale = 0.9 if spread <= 8 else 0.6
    best = max(best, scale * _window_ratio(a, b))
    return round(max(best, 0.95 * scale * _token_window_ratio(a, b)))
