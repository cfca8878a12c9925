"""Readers by the kind of a file and converters by the name of an output format.

A reader is ``read(spark, path, **options) -> spectra``; a converter is
``write(output, tables, **options)``.  Both are plain functions; registering one replaces none.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from threading import RLock

from .. import storage
from ..errors import ConfigurationError, FormatError

_lock = RLock()
_readers: dict[str, Callable] = {}
_converters: dict[str, Callable] = {}
_suffixes: dict[str, tuple[str, Callable[[str], None]]] = {}


def _register(table: dict[str, Callable], name: str) -> Callable[[Callable], Callable]:
    def keep(f: Callable) -> Callable:
        with _lock:
            if name in table:
                raise ConfigurationError(f"{name} is registered already")
            table[name] = f
        return f

    return keep


def register_reader(kind: str, suffix: str | None = None, check: Callable[[str], None] = lambda path: None):
    """Decorator for the reader of ``kind``; paths with ``suffix`` (any case) are of it, if ``check`` raises nothing."""
    if suffix is not None:
        with _lock:
            _suffixes[suffix.lower()] = (kind, check)
    return _register(_readers, kind)


def register_converter(name: str):
    return _register(_converters, name)


def _get(table: dict[str, Callable], name: str, what: str) -> Callable:
    with _lock:
        if name not in table:
            raise ConfigurationError(f"no {what} for {name!r}; there are {', '.join(sorted(table)) or 'none'}")
        return table[name]


def reader(kind: str) -> Callable:
    return _get(_readers, kind, "reader")


def converter(name: str) -> Callable:
    return _get(_converters, name, "converter")


def detect(path: str) -> str:
    """The kind of a file or folder, from its suffix and what stands beside or in it."""
    if not storage.there(path):
        raise FormatError(f"{path}: does not exist")
    ext = os.path.splitext(path.rstrip("/"))[1]
    with _lock:
        found = _suffixes.get(ext.lower())
    if found is None:
        raise FormatError(f"{path}: unknown kind {ext!r}")
    kind, check = found
    check(path)
    return kind
