"""What a survey scores and ranks. Nothing branches on a version name; everything reads a SurveySpec."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SurveySpec:
    """axes: scored axes with weights; lists: ranked lists with the axis that each orders by; adjusted: axes that a place moves."""

    weights: tuple[tuple[str, float], ...]
    lists: tuple[tuple[str, str], ...]
    adjusted: tuple[str, ...]
    prior: int = 10
    max_adjustment: float = 5.0
    z: float = 1.645
    list_length: int = 100
    works: tuple[int, int] = (100, 400)
    match_agent_id: bool = True

    @property
    def axes(self) -> tuple[str, ...]:
        return tuple(a for a, _ in self.weights)

    @property
    def list_names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.lists)

    def list_of(self, axis: str) -> str | None:
        return next((n for n, a in self.lists if a == axis), None)


# The two public surveys.
FIVE_AXES = SurveySpec(
    weights=(("influence", 0.10), ("ambition", 0.35), ("fairness", 0.25), ("traditionality", 0.10), ("originality", 0.20)),
    lists=(("ambition", "ambition"), ("fairness", "fairness"), ("traditional_mystery", "traditionality"), ("originality", "originality")),
    adjusted=("ambition", "fairness", "originality"),
)
FOUR_AXES = SurveySpec(
    weights=(("influence", 0.10), ("ambition", 0.40), ("fairness", 0.25), ("originality", 0.25)),
    lists=(("ambition", "ambition"), ("fairness", "fairness"), ("originality", "originality")),
    adjusted=("ambition", "fairness", "originality"),
    works=(100, 300),
    match_agent_id=False,
)
#: Public names and their aliases; any other name means the default.
DATASETS = {"v1": FOUR_AXES, "v2": FIVE_AXES}
ALIASES = {"v1": "v1", "v3": "v1"}
DEFAULT_DATASET = "v2"


def dataset(name: str | None) -> SurveySpec:
    return DATASETS[ALIASES.get(name or "", DEFAULT_DATASET)]
