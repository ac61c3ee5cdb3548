"""Greedy choice of terms that differ from those chosen before."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from scholark.constants import SHORT_LIST, SIMILAR_ANY, TERMS_KEPT


def diversified(terms: Sequence[str], similarity: Callable[[str, str], float], last: float, any_before: float | None = SIMILAR_ANY, keep: int = TERMS_KEPT) -> list[str]:
    """Up to ``keep`` terms in order, trimmed; one chosen before, more similar to the last chosen than ``last``, or to any
    chosen than ``any_before`` (None: not asked), is passed over. Lists under SHORT_LIST terms come back as they are."""
    if len(terms) < SHORT_LIST:
        return list(terms)
    chosen: list[str] = []
    for term in (t.strip() for t in terms):
        if len(chosen) >= keep:
            break
        if term in chosen:
            continue
        if chosen and similarity(term, chosen[-1]) > last:
            continue
        if any_before is not None and any(similarity(term, c) > any_before for c in chosen):
            continue
        chosen.append(term)
    return chosen
