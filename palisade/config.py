"""Tunable values, passed explicitly to operators instead of read from the environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    anomaly_threshold: float = 0.7
    cooldown_seconds: int = 60
    ml_weight: float = 0.6
    rule_weight: float = 0.4
    ewma_alpha: float = 0.1
    # Time slices that a source address is cut into before a shuffle, so that no single
    # address ends up in one task. The window slice must be at least the longest frame.
    window_slice_seconds: int = 900
    # Reputation is summed up in slices of these lengths, each a multiple of the one before.
    fold_seconds: tuple[int, ...] = (1, 60, 3600)
    # A cooldown slice passes through a task in batches; two integers are held per candidate of its
    # first minute.
    cooldown_slice_seconds: int = 3600
    # Addresses with more events than this in a window slice are split further, by the second.
    busy_rows: int | None = 5_000_000


DEFAULTS = Settings()
