"""Settings of a comparison, and the integer bounds that follow from them."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

#: Bits of a fingerprint, and fixed similarities of the funnel.
HASH_BITS = 64
COARSE, STRICT, RESCUED = 0.70, 0.93, 0.95
TARGET_FLOOR = 0.40
WHASH_STRICTEST, WHASH_LOOSEST = 0.90, 0.70
#: The largest distances of the coarse stage, of a rescue, of a strict match, of grid cells.
COARSE_D, RESCUE_D, STRICT_D, CELL_D = 19, 38, 4, 3
RESCUE_CELLS, GRID_CELLS = 12, 16
#: Limits of the grid vote.
VOTE_BUCKET, VOTE_PER_AD, VOTE_TOTAL = 1000, 200, 5000
#: Statuses that mean a catalogue record was deleted, the first one being written.
DELETED_STATUSES = ("file_deleted", "檔案已被刪除", "已刪除", "deleted")
#: Names of files that don't count as content, and image extensions.
JUNK_NAMES = ("thumbs.db", ".ds_store", "desktop.ini", ".picasa.ini")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp")


def most_distance(similarity: float) -> int:
    """The largest Hamming distance whose similarity ``1 - d / 64`` reaches ``similarity``."""
    return max(d for d in range(HASH_BITS + 1) if 1 - d / HASH_BITS >= similarity - 1e-9)


def _lerp(percent: float, start: float, limit: float) -> float:
    share = min(1.0, max(0.0, (100.0 - percent) / 30.0))
    return start + (limit - start) * share


@dataclass(frozen=True)
class Gate:
    """Tolerances of the colour gate: hue in degrees, the rest as shares."""

    hue: float
    saturation: float
    value: float
    achroma: float
    low_saturation: float = 0.18
    low_saturation_step: float = 0.15
    rescue_value: float = 0.6


@dataclass(frozen=True)
class Settings:
    """What a user sets; thresholds in percent."""

    similarity_threshold: float = 95.0
    extract_count: int = 10
    first_scan_extract_count: int = 0
    excluded_folders: tuple[str, ...] = ()
    start_date: str | None = None
    end_date: str | None = None
    folder_time_mode: str = "mtime"
    inter_folder_only: bool = True
    use_color_filter: bool = True
    use_whash: bool = True
    use_quick_digest: bool = True
    rotation_matching: bool = False
    image_extensions: tuple[str, ...] = field(default=IMAGE_EXTENSIONS)

    @property
    def similarity(self) -> float:
        return self.similarity_threshold / 100.0

    @property
    def distance(self) -> int:
        return most_distance(self.similarity)

    @property
    def gate(self) -> Gate:
        p = self.similarity_threshold
        return Gate(_lerp(p, 18.0, 35.0), _lerp(p, 0.18, 0.40), _lerp(p, 0.10, 0.30), _lerp(p, 0.12, 0.30))


def settings_from(path: str, defaults: dict | None = None) -> Settings:
    """Settings of a JSON file over ``defaults``; what it lacks keeps its default, what isn't known is left out."""
    try:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
    except FileNotFoundError:
        found = {}
    known = {f.name for f in fields(Settings)}
    merged = {k: tuple(v) if isinstance(v, list) else v for k, v in ((defaults or {}) | found).items() if k in known}
    return Settings(**merged)


def save_settings(settings: Settings, path: str) -> None:
    """Write settings as JSON, whole or not at all."""
    with open(f"{path}.new", "w", encoding="utf-8") as file:
        json.dump(asdict(settings), file, ensure_ascii=False, indent=2)
    os.replace(f"{path}.new", path)


def whash_bounds() -> list[int]:
    """For each coarse distance the largest wavelet-hash distance that still accepts.

    The required wavelet similarity falls linearly from 0.90 to 0.70 while the coarse similarity rises
    from 0.70 to 0.93.
    """
    out = []
    for d in range(COARSE_D + 1):
        share = min(1.0, max(0.0, (1 - d / HASH_BITS - COARSE) / (STRICT - COARSE)))
        out.append(most_distance(WHASH_STRICTEST - share * (WHASH_STRICTEST - WHASH_LOOSEST)))
    return out
