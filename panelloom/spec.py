"""The panel contract: column roles and geometry, passed explicitly to every operator."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Series up to this many rows are windowed in one partition; longer ones are cut into chunks.
CHUNK_ROWS = 65_536


@dataclass(frozen=True)
class PanelSpec:
    id: str = "unique_id"
    time: str = "ds"
    target: str = "y"
    index: str = "hidx"
    capacity: str = "capacity"
    zone: str = "zone"
    signals: tuple[str, ...] = ()
    nullable: tuple[str, ...] = ()
    statics: tuple[str, ...] = ()
    step_seconds: int = 3600
    season: int = 168
    score_len: int = 336
    train_end: int = 3648
    late_from: int = 224
    lags: tuple[int, ...] = (1, 24, 48, 168, 336, 504)
    rolls: tuple[int, ...] = (24, 168)
    # Upper bound on rows per series when the calendar is known; None means unknown.
    series_len: int | None = None
    chunk_rows: int = CHUNK_ROWS

    @property
    def full_horizon(self) -> int:
        return 2 * self.score_len

    @property
    def bounded(self) -> bool:
        """True when a whole series provably fits one window partition."""
        return self.series_len is not None and self.series_len <= self.chunk_rows

    def with_(self, **changes) -> "PanelSpec":
        return replace(self, **changes)

    def cutoffs(self, n: int = 3, step: int | None = None) -> list[int]:
        """Train ends rolled back from ``train_end``, one scored block apart by default."""
        back = self.score_len if step is None else step
        return [self.train_end - i * back for i in range(n)]
