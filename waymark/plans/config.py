"""Settings of a site, as plain values that become literals in plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class VisitParams:
    """split_gap: a longer silence (strictly) starts a new visit. flip_s, flip_obs: the longest and fullest visit that may be
    a flipped label. rounds: simultaneous repairs at most."""

    split_gap: float = 300.0
    flip_s: float = 12.0
    flip_obs: int = 3
    rounds: int = 5


@dataclass(frozen=True)
class SiteParams:
    """hidden: the path nobody films. v_min, v_max: walking speed bounds in m/s. slack: seconds. jitter: clock error."""

    hidden: str = "P4"
    v_min: float = 0.4
    v_max: float = 3.0
    slack: float = 15.0
    jitter: float = 2.0
