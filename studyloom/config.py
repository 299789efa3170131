"""Parameters of the analytics and retrieval operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Defaults of every tunable value; pass a changed copy (``dataclasses.replace``) to an operator."""

    # profile
    decay_alpha: float = 0.5
    recent_limit: int = 100
    event_limit: int = 300
    persistence_window: int = 12
    persistence_threshold: int = 3
    persistence_multiplier: float = 1.5
    cross_pollination: float = 0.3
    accuracy_low: float = 0.3
    accuracy_mid: float = 0.6
    stored_text: int = 500
    # frontier
    frontier_threshold: float = 0.2
    frontier_prereq_weight: float = 0.5
    frontier_predicted_weight: float = 0.15
    frontier_per_task: int = 2
    hop_factor: float = 0.7
    # retrieval
    rrf_k: int = 10
    dense_weight: float = 0.5
    sparse_weight: float = 0.5
    late_weight: float = 0.5
    sparse_on: bool = False
    late_on: bool = True
    fetch_least: int = 48
    fetch_factor: int = 4
    profile_weight: float = 0.30
    skill_factor: float = 0.3
    mastery_threshold: float = 0.8
    mastery_penalty: float = 0.15
    prereq_bonus: float = 0.05
    prereq_tag_bonus: float = 0.03
    dependent_bonus: float = 0.03
    cross_task_factor: float = 0.5
    mmr_lambda: float = 0.6
    # monitoring
    store_limit: int = 500
    throughput_seconds: int = 60
    # judging
    judge_relevant: float = 0.2


DEFAULT = Settings()
#: Task numbers with their own classifier, tags and pools.
SUPPORTED_TASKS = (6, 10, 12, 13, 16)
#: Task numbers that tool arguments may name.
TOOL_TASKS = (6, 10, 12)
#: Scores that a judge may give.
JUDGE_SCORES = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Tag of an error whose cause isn't known.
UNKNOWN = "unknown"
