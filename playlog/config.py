"""Parameters of the analyses, with their defaults and bounds."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EngineConfig:
    top: int = 20
    session_gap: int = 30  # minutes
    pair_window: int = 30  # minutes
    transition_window: int | None = None  # minutes; None: the session gap
    resurrection_days: int = 180
    album_complete: float = 0.80
    thread_hours: float = 48.0
    resume_slack: int = 2

    def clamped(self) -> EngineConfig:
        """Every value within its bounds."""
        return replace(
            self,
            top=max(1, self.top),
            session_gap=max(1, self.session_gap),
            pair_window=max(1, self.pair_window),
            resurrection_days=max(1, self.resurrection_days),
            album_complete=min(1.0, max(0.50, self.album_complete)),
            thread_hours=max(1.0, self.thread_hours),
            resume_slack=max(0, self.resume_slack),
        )
