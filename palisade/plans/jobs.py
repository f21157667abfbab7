"""Whole-table jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from palisade.config import DEFAULTS, Settings
from palisade.operators.alerts import fire_alerts
from palisade.operators.features import with_features
from palisade.operators.reputation import reputation
from palisade.session import stored


@dataclass(frozen=True)
class Processed:
    events: DataFrame
    alerts: DataFrame
    reputation: DataFrame


def process_log(
    log: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    settings: Settings = DEFAULTS,
) -> Processed:
    """Features, scores, alerts and reputation of a log table.

    ``log`` is a stored table: busy addresses are looked up in a pass of its own. The scored
    events are stored once; alerts and reputation read the columns they need.
    """
    featured = with_features(
        log, slice_seconds=settings.window_slice_seconds, busy_rows=settings.busy_rows
    )
    events = stored(score(featured), "events")
    return Processed(
        events,
        fire_alerts(events, settings=settings, in_storage=True),
        reputation(events, settings=settings),
    )
