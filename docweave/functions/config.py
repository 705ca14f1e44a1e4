"""Settings: defaults, a small YAML reader, validation against defaults."""

from __future__ import annotations

import copy
import os
from typing import Any

# Default settings.
DEFAULTS: dict[str, Any] = {
    "ocr": {"tesseract_path": "/usr/bin/tesseract", "default_dpi": 300},
    "chunking": {"chunk_size": 500, "overlap": 100, "min_chunk_size": 100},
    "embedding": {"model_name": "all-MiniLM-L6-v2", "batch_size": 32},
}


def validate(settings: dict, defaults: dict = DEFAULTS, at: str = "") -> dict:
    """``settings`` with missing keys filled from a copy of ``defaults``.

    TypeError where a mapping or a leaf type of the defaults isn't met; a bool
    passes as an int, an int doesn't pass as a float. Unknown keys stay.
    """
    for key, default in defaults.items():
        name = f"{at}{key}"
        if key not in settings:
            settings[key] = copy.deepcopy(default)
        elif isinstance(default, dict):
            if not isinstance(settings[key], dict):
                raise TypeError(f"{name} must be a mapping")
            validate(settings[key], default, f"{name}.")
        elif not isinstance(settings[key], type(default)):
            raise TypeError(f"{name} must be {type(default).__name__}, not {type(settings[key]).__name__}")
    return settings


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse(text: str) -> dict:
    """Nested mappings of scalars, the subset of YAML that settings use; empty is {}."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        key, mark, value = body.strip().partition(":")
        if not mark:
            raise ValueError(f"not a mapping: {line!r}")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][key.strip()] = _scalar(value)
        else:
            stack[-1][1][key.strip()] = child = {}
            stack.append((depth, child))
    return root


def load(path: str) -> dict:
    """Validated settings of a file on the driver."""
    with open(path, encoding="utf-8") as f:
        return validate(parse(f.read()))


def require_key(name: str) -> str:
    """An environment variable that an online model needs; ValueError if unset."""
    value = os.environ.get(name)
    if not value:
        raise ValueError(f"{name} is not set")
    return value
