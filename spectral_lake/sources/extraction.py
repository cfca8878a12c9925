"""Metadata of a file in two steps, each read once and kept: what processing needs, then all it says of itself."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..errors import ConfigurationError
from ..operators import extract
from . import frames, imzml, registry

MODULES = {"imzml": imzml, "frames": frames}


class Extraction:
    """``essential()`` reads header or database only; ``comprehensive()`` adds the sections.  Neither decodes a spectrum."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.kind = spark, path, registry.detect(path)
        if self.kind not in MODULES:
            raise ConfigurationError(f"no metadata for files of kind {self.kind!r}")
        self.clear()

    def clear(self) -> None:
        self._essential: dict | None = None
        self._comprehensive: dict | None = None

    def essential(self) -> dict:
        if self._essential is None:
            self._essential = MODULES[self.kind].essential(self.spark, self.path).first().asDict() | {"source_path": self.path}
        return self._essential

    def comprehensive(self) -> dict:
        if self._comprehensive is None:
            document = extract.as_json(MODULES[self.kind].sections(self.spark, self.path)).first()["document"]
            self._comprehensive = {"essential": self.essential(), **json.loads(document or "{}")}
        return self._comprehensive

    def summary(self) -> dict:
        """The few figures that tell data sets apart."""
        e = self.essential()
        return {"kind": self.kind, "dimensions": (e["nx"], e["ny"], e["nz"]), "n_spectra": e["n_spectra"], "pixel_size": e["pixel_size_x"], "is_3d": e["is_3d"], "memory_gb": e["memory_gb"]}
