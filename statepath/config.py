"""Constants of the engine, in one frozen dataclass."""

from __future__ import annotations

from dataclasses import dataclass

KEY_COLUMNS = ("ID", "TIME")
RESERVED_COLUMNS = ("ID", "TIME", "ACTION", "RISK", "CLUSTER", "NEXT_CLUSTER")
OUTPUT_COLUMNS = ("ACTION", "RISK", "CLUSTER", "NEXT_CLUSTER")

# TIME is a non-negative 32-bit integer and (ID, TIME) is a key. Cutting a
# subject into slices of 2^16 time steps therefore bounds both the rows of a
# slice (65,536) and the slices of a subject (32,768), whatever the data.
SLICE_WIDTH = 65_536


@dataclass(frozen=True)
class Config:
    # state refinement
    initial_states: int = 3
    max_states: int = 8
    min_obs: int = 5_000
    min_splitoff: int = 300
    forest_trees: int = 20
    forest_depth: int = 5
    split_trees: int = 20
    split_depth: int = 7
    seed: int = 0
    risk_terms: tuple[str, ...] = ("total_sofa",)
    # solver
    gamma: float = 0.9
    epsilon: float = 1e-10
    # rollout
    max_steps: int = 5_000
    rollout_seed: int = 42
    steps_per_job: int = 250
