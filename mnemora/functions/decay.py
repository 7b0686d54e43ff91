"""Strength over time: exponential decay by stability, reinforcement, dormancy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora import config


def elapsed_days(since: Column, now: Column) -> Column:
    """Days between two instants, never negative."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(since)) / 86400e6)


def decay_rate(stability: Column) -> Column:
    """Decay per day of a stability class; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in config.DECAY_PER_DAY.items() for x in pair]), stability)


def decayed(strength: Column, stability: Column, days: Column) -> Column:
    return strength * F.exp(-decay_rate(stability) * days)


def reinforced(strength: Column, times: Column, boost: float = config.REINFORCE_BOOST) -> Column:
    """Closed form of ``times`` capped additions."""
    return F.least(strength + times * boost, F.lit(config.MAX_STRENGTH))


def is_dormant(strength: Column) -> Column:
    return strength < config.DORMANT_BELOW
