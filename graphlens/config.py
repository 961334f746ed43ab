"""Protocol constants, as parameters so that small populations can use smaller grids."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Protocol:
    """Ranges, sizes and levels of the benchmark protocol."""

    nodes: int = 100
    edges: int = 495
    grid: int = 50
    replicates: int = 10
    eta_range: tuple[float, float] = (-8.0, 3.0)
    gamma_range: tuple[float, float] = (-0.1, 1.0)
    trajectories: int = 200
    steps: int = 100
    noise_levels: tuple[int, ...] = (1, 2, 5, 10, 20, 50, 100, 200)
    noise_repeats: int = 20
    noise_repeats_slow: int = 10
    noise_cutoff: float = 1.0
    slow_ms: float = 10.0
    slow_window: int = 10
    slow_full_until: int = 50
    censored_drift: float = 10.0
    best_cells: tuple[int, int] = (100, 20)
    hard_cases: int = 500
    long_mm: float = 90.0
    swap_tries: int = 100
    degeneration_seed: int = 1
    noise_seed: int = 2


#: The protocol on the 25-node populations that the tests and queries derive from the trade tables.
SMALL = Protocol(nodes=25, edges=60, grid=12, replicates=3, eta_range=(-3.0, 2.0), gamma_range=(0.0, 1.0), noise_levels=(1, 2, 5, 10, 20, 40), noise_repeats=5, noise_repeats_slow=3, slow_window=2, trajectories=20, steps=12, best_cells=(30, 10), hard_cases=20)

CRITERIA = ("agreement", "plausibility", "efficiency", "sensitivity", "accuracy")
# Fixed values of the published benchmark: key, criterion, label, direction (+1 higher is better, -1 lower, 0 neither).
READOUTS = [
    ("agreement", "agreement", "Mean r with the selected landscapes", 1),
    ("max_abs_r", "agreement", "Largest |r| with a published landscape", 0),
    ("best_eta", "plausibility", "Best-fitting eta", 0),
    ("best_gamma", "plausibility", "Best-fitting gamma", 0),
    ("eta_positive_of_100", "plausibility", "Combinations at eta > 0, of the 100 best", -1),
    ("eta_positive_of_20", "plausibility", "Combinations at eta > 0, of the 20 best", -1),
    ("total_variation", "plausibility", "Total variation of the 20 best combinations", -1),
    ("connection_length_mm", "plausibility", "Mean connection length of the 20 best networks, mm", 0),
    ("percent_beyond_90mm", "plausibility", "Connections beyond 90 mm, %", 0),
    ("degree_sd", "plausibility", "Degree SD of the 20 best networks", 0),
    ("runtime_ms", "efficiency", "Runtime per comparison, ms", -1),
    ("mae", "sensitivity", "MAE against the linear response", -1),
    ("cv", "sensitivity", "CV across the 200 rewiring trajectories", -1),
    ("noise_tolerance", "sensitivity", "Noise tolerance N*", 1),
    ("isnr_db", "sensitivity", "Intrinsic signal-to-noise ratio, dB", 1),
    ("recovery_wide", "accuracy", "Recovery error, whole morphospace, grid steps", -1),
    ("recovery_window", "accuracy", "Recovery error, plausible window, grid steps", -1),
    ("r_eta_wide", "accuracy", "r(true eta, recovered eta), whole morphospace", 1),
    ("r_eta_window", "accuracy", "r(true eta, recovered eta), plausible window", 1),
    ("auc", "accuracy", "AUC real vs the full GNM population", 1),
    ("auc_hard", "accuracy", "AUC real vs the own 500 best networks", 1),
]
