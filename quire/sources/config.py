"""Settings: defaults, then a .env file, then the environment, then a request's own values."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from quire.functions.text import ENGINES
from quire.operators.fonts import FONTS


def default_data_dir() -> str:
    return str(Path(os.environ.get("XDG_DATA_HOME", Path.home() / ".local/share")) / "quire")


@dataclass(frozen=True)
class Config:
    api_key: str = ""
    model: str = ""
    ocr_engine: str = "paddleocr"
    ocr_url: str = "http://localhost:8080"
    workers: int = 4
    dpi: int = 300
    timeout: float = 120.0
    data_dir: str = ""
    #: Own font files by script, of scripts that have one (settings FONT_LATIN, FONT_ARABIC and so on).
    fonts: Mapping[str, str] = field(default_factory=dict)

    def violations(self) -> list[str]:
        """Names of the settings in effect that aren't valid."""
        checks = {"api_key": bool(self.api_key), "ocr_engine": self.ocr_engine in ENGINES, "workers": self.workers >= 1, "dpi": 72 <= self.dpi <= 600}
        return [name for name, fine in checks.items() if not fine]


def env_file(path: str | Path) -> dict[str, str]:
    """KEY=value lines; quotes around a value, blank lines and comments are dropped."""
    out = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, eq, value = line.strip().partition("=")
            if eq and not key.startswith("#"):
                out[key.strip().removeprefix("export ")] = value.strip().strip("\"'")
    return out


def load(file: str | Path = ".env", environ: Mapping[str, str] | None = None, prefix: str = "QUIRE_") -> Config:
    """The settings; a value that isn't a number where one is needed is an error."""
    found = {**env_file(file), **(os.environ if environ is None else environ)}
    values = {}
    for f in fields(Config):
        if f.name == "fonts":
            values["fonts"] = {script: path for script in FONTS if (path := found.get(f"{prefix}FONT_{script.upper()}"))}
            continue
        raw = found.get(prefix + f.name.upper())
        if raw:
            values[f.name] = {"int": int, "float": float}.get(str(f.type), str)(raw)
    config = Config(**values)
    return config if config.data_dir else replace(config, data_dir=default_data_dir())


def overridden(config: Config, **request: object) -> Config:
    """With a request's values in place of the settings'; 0, empty and None leave a setting as it is."""
    return replace(config, **{k: v for k, v in request.items() if v})
