"""Run parameters. Plain values only; every operator takes one of these."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RunParams:
    """Parameters of one feature build.

    window:       look-back length in days
    end_day:      the day the build is made for
    fixed_ending: last day whose infections may enter the cohort
    look_forward: forecast horizon in days
    """

    window: int = 5
    end_day: int = 56
    fixed_ending: int = 49
    is_training: bool = True
    look_forward: int = 5

    def __post_init__(self) -> None:
        if self.window < 1:
            raise ValueError("window must be at least one day")
        if self.look_forward < 0:
            raise ValueError("look_forward must not be negative")

    @property
    def training_window_end(self) -> int:
        """Last look-back day of people who are not infected, when labels are known."""
        return self.end_day - self.look_forward

    @property
    def inference_window_end(self) -> int:
        """Last look-back day of people who are not infected, when forecasting."""
        return self.end_day


# The parameter sets used by the published fit / predict entry points.
FIT_PARAMS = RunParams(window=1, end_day=49, fixed_ending=49, is_training=True)
PREDICT_PARAMS = RunParams(window=1, end_day=56, fixed_ending=55, is_training=False)
FLAT_TRAIN_PARAMS = RunParams(window=2, end_day=49, fixed_ending=49, is_training=True)
FLAT_TEST_PARAMS = RunParams(window=2, end_day=50, fixed_ending=49, is_training=False)


@dataclass(frozen=True)
class FederatedParams:
    """Hyper-parameters of federated training.

    mode="textbook" follows the published definitions (cross-entropy gradient,
    proximal term and clipping applied); mode="parity" reproduces the numbers
    of the original training loop, where a second sigmoid is applied by the
    loss and the proximal term and the clipping have no effect on the update.

    seed=None draws a secret seed for each training run, as the privacy of the
    noise needs. A given seed is for tests. Seeds are never stored.
    """

    epochs: int = 5
    rounds: int = 1
    learning_rate: float = 0.001
    epsilon: float = 3.0
    mu: float = 0.01
    max_grad_norm: float = 10.0
    batch_size: int = 128
    threshold: float = 0.5
    mode: str = "textbook"
    noise: bool = True
    seed: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("textbook", "parity"):
            raise ValueError(f"unknown mode {self.mode!r}")


# The three published privacy presets.
FEDERATED_PRESETS = {
    "live": FederatedParams(epsilon=3.0, threshold=0.5),
    "old": FederatedParams(epsilon=0.003, threshold=3.0),
    "utils": FederatedParams(epsilon=9.0, threshold=0.5),
}
