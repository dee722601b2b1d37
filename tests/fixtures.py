"""The solved events and sites of FIXTURES.md as rows."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np

TEXT = (Path(__file__).resolve().parent.parent / "FIXTURES.md").read_text()


def table(first: str) -> list[list[str]]:
    lines = TEXT[TEXT.index(first) :].splitlines()[2:]
    out = []
    for line in lines:
        if not line.startswith("|"):
            break
        out.append([c.strip() for c in line.strip("|").split("|")])
    return out


def sites() -> dict[int, tuple[float, ...]]:
    """site_id: detections, locations, easting, northing, lon, lat."""
    return {int(r[0]): tuple(map(float, r[1:])) for r in table("| site_id | n_detections")}


def solved() -> list[dict]:
    out = []
    for r in table("| event_id | line | sites"):
        ids = [int(x) for x in r[2].split(",")]
        k = np.array([int(x) for x in r[3].split(",")])
        tau = k / 768000
        phi = np.degrees(np.arccos(np.clip(343 * tau / 0.15, -1, 1)))
        out.append(
            {
                "event_id": int(r[0]), "sites": ids, "abs_tdoa_ms": np.abs(tau * 1000), "b1": (90 - phi) % 360, "b2": (90 + phi) % 360, "bits": r[4],
                "objective": float(r[5]), "rms": float(r[6]), "geometry": float(r[7]), "margin": float(r[8]), "quality": r[9] == "True",
            }
        )
    assert len(out) == 58 and re.fullmatch("[01]+", out[0]["bits"])
    return out
