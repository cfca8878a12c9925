"""Logging to the console and, if asked, to a file that turns over."""

from __future__ import annotations

import logging
import logging.handlers

from .config import SETTINGS


def setup(level: str = "INFO", file: str | None = None) -> logging.Logger:
    log = logging.getLogger("spectral_lake")
    log.setLevel(level.upper())
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        handlers.append(logging.handlers.RotatingFileHandler(file, maxBytes=SETTINGS.log_bytes, backupCount=SETTINGS.log_files))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    return log
