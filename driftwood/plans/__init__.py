"""Registered queries: the operators applied to the given tables, each beside its SQL."""

from __future__ import annotations


def registered() -> dict:
    """name -> (function, SQL or None) of every query here."""
    from . import announcing, clocking, contents, following, governing, guarding, matching, normalized, operations, pairing, payloads, registry, reporting, resolving, searching, sourcing, streams, summing, texts, validating  # noqa: F401

    return dict(registry.REGISTERED)
