"""Files and services beyond Spark's reach: font downloads, a cache of parsed fonts, health of recognition services, temporary folders."""

from __future__ import annotations

import contextlib
import os
import shutil
import struct
import threading
import urllib.request
from collections.abc import Callable, Iterable
from pathlib import Path

from quire.operators.fonts import FONTS
from quire.sources.ttf import Font

MOST_FONT = 100 << 20
FETCH_TIMEOUT = 120.0
PIECE = 1 << 16


def healthy(url: str, timeout: float = 5.0) -> None:
    """Asks a recognition service for its health; anything but status 200 is an error."""
    with urllib.request.urlopen(url.rstrip("/") + "/health", timeout=timeout) as r:
        if r.status != 200:
            raise ValueError(f"service answered {r.status}")


def fetched(url: str, target: str | Path, most: int = MOST_FONT, timeout: float = FETCH_TIMEOUT) -> Path:
    """Downloads one file. A download that fails or exceeds `most` bytes leaves nothing behind, and an older file as it was."""
    target = Path(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{os.getpid()}.part")
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r, open(part, "wb") as out:
            size = 0
            while piece := r.read(PIECE):
                size += len(piece)
                if size > most:
                    raise ValueError(f"{url} exceeds {most} bytes")
                out.write(piece)
        part.replace(target)
    finally:
        part.unlink(missing_ok=True)
    return target


def fetch_missing(base: str, folder: str | Path, names: Iterable[str] | None = None, most: int = MOST_FONT) -> dict[str, str]:
    """Downloads the catalogue's fonts that a folder lacks; name to error, empty where it went well. One failure doesn't stop others."""
    out = {}
    for name in sorted(set(FONTS.values() if names is None else names)):
        if not (Path(folder) / name).is_file():
            try:
                fetched(f"{base.rstrip('/')}/{name}", Path(folder) / name, most)
                out[name] = ""
            except (OSError, ValueError) as e:
                out[name] = f"{type(e).__name__}: {e}"
    return out


class FontCache:
    """Parsed fonts by script. A script whose font can't be had is remembered too, so it is tried once.

    Loading runs outside the lock; of two that load the same script at once, the first to finish is kept.
    """

    def __init__(self, load: Callable[[str], bytes]) -> None:
        self._load, self._lock, self._known = load, threading.Lock(), {}

    def get(self, script: str) -> Font | None:
        with self._lock:
            if script in self._known:
                return self._known[script]
        font = None
        with contextlib.suppress(OSError, ValueError, KeyError, IndexError, struct.error):
            font = Font.of(self._load(script))
        with self._lock:
            return self._known.setdefault(script, font)


def fresh_folder(path: str | Path, *roots: str | Path) -> Path:
    """An empty folder in place of what was there; refused unless it lies strictly below one of the roots, links resolved."""
    own = Path(path).resolve()
    if not any(Path(r).resolve() in own.parents for r in roots):
        raise ValueError(f"{path} is not below {', '.join(map(str, roots))}")
    shutil.rmtree(own, ignore_errors=True)
    own.mkdir(parents=True)
    return own
