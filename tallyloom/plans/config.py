"""Settings of an evaluation, and constants that all operators share."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field

EPS = 1e-9
DAYS_A_YEAR = 365.25
#: The profit factor is cut here.
MOST_PROFIT_FACTOR = 50.0


@dataclass(frozen=True)
class EvalConfig:
    """Scalars that the operators of one evaluation share."""

    start_balance: float = 10_000.0
    rf_annual: float = 0.04
    mad_cap_factor: float = 10.0
    cusum_k: float = 0.5
    cusum_h: float = 4.0
    mc_iterations: int = 1000
    block_length: int | None = None
    n_trials: int = 2
    sr_trials: tuple[float, ...] = (0.0, 1.0)
    #: Strategies of more trades than this have theirs in chunks of this size, each a task's work.
    chunk_rows: int = 1 << 20
    #: "counter": a draw is a hash of what it is for; "numpy": draws follow one sequential generator for each strategy.
    rng: str = "counter"
    #: Decimal text, so that 128-bit seeds survive every format.
    seed: str = field(default_factory=lambda: str(secrets.randbits(128)))

    def __post_init__(self):
        if self.n_trials < 2:
            raise ValueError("n_trials must be 2 or more")
        if len(self.sr_trials) < 2:
            raise ValueError("sr_trials must hold 2 or more Sharpe ratios")
        if not self.seed.isdecimal():
            raise ValueError("seed must be a decimal number, as text")
        if self.rng not in ("counter", "numpy"):
            raise ValueError("rng must be counter or numpy")
        if self.chunk_rows < 1:
            raise ValueError("chunk_rows must be 1 or more")
        if self.start_balance <= 0 or self.mc_iterations < 0:
            raise ValueError("start_balance must be above 0 and mc_iterations 0 or more")
