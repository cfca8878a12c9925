"""Constants that a user may want to look up."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    dataset_id: str = "msi_dataset"
    output_format: str = "lake"
    tolerance_da: float = 1e-6
    ppm: float = 5.0
    tile: int = 64
    rows_per_file: int = 1_000_000
    log_bytes: int = 10 * 1024 * 1024
    log_files: int = 5
    batch_spectra: int = 50
    batch_frames: int = 100
    memory_limit_mb: int = 1024


SETTINGS = Settings()
