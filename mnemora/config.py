"""Tunables of retrieval, resolution and decay. All are plain parameters; the defaults are fixed values to match."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Kinds, stabilities, cardinalities.
NODE_KINDS = ("PERSON", "ORG", "PLACE", "TOPIC", "THING", "EVENT", "PREFERENCE", "OTHER")
STABILITIES = ("immutable", "stable", "mutable", "time_bound", "ephemeral")
TTL_STABILITIES = ("time_bound", "ephemeral")
CARDINALITIES = ("one_to_one", "one_to_many")
#: Decay per day by stability.
DECAY_PER_DAY = {"immutable": 0.0, "stable": 0.005, "mutable": 0.020, "time_bound": 0.050, "ephemeral": 0.200}
RELATION_SHAPE = "^[A-Z]+(?:_[A-Z]+){0,3}$"
INITIAL_STRENGTH = MAX_STRENGTH = 100.0
DORMANT_BELOW = 2.0
REINFORCE_BOOST = 15.0
DEMOTED_STRENGTH = 1.0
FUZZY_ABOVE, JACCARD_FROM = 0.80, 0.5
AUTO_ABOVE, FLAG_FROM = 0.90, 0.70
DEFAULT_CONFIDENCE = 0.85
SESSION_MAX_CALLS, SESSION_MAX_MINUTES, DECAY_GATE_HOURS = 80, 30, 24
HASH_DIMENSIONS = 256
#: Property of a node that was made up for a relationship's end.
PROVISIONAL = "provisional_from_relationship"
SELF_PLACEHOLDERS = ("user", "the_user", "me", "myself")


@dataclass(frozen=True)
class RetrievalConfig:
    """Parameters of one read; every stage takes them as literals of the plan."""

    hop_decay: float = 0.6
    max_depth: int = 2
    primary_threshold: float = 0.30
    secondary_threshold: float = 0.60
    node_budget: int = 8
    forward_ratio: float = 0.70
    seed_similarity: float = 0.30
    seed_margin: float = 0.15
    seed_margin_floor: float = 0.15
    seed_top_k: int = 3
    co_episode_boost: float = 0.15
    max_snippets: int = 4
    min_contribution: float = 0.0
    embed_dimensions: int = field(default=HASH_DIMENSIONS)

    @property
    def forward_budget(self) -> int:
        """Places for forward and seed nodes (half-even rounding)."""
        return round(self.node_budget * self.forward_ratio)
