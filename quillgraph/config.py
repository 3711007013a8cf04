"""Settings of a user: where workspaces are remembered. One JSON file; an unreadable one counts as empty."""

from __future__ import annotations

import json
import os

FOLDER = os.path.expanduser("~/.quillgraph")


def _read(folder: str) -> dict:
    try:
        with open(os.path.join(folder, "config.json"), encoding="utf-8") as f:
            got = json.load(f)
        return got if isinstance(got, dict) else {}
    except (OSError, ValueError):
        return {}


def memory_path(folder: str = FOLDER) -> str:
    return _read(folder).get("memoryPath") or folder


def set_memory_path(path: str, folder: str = FOLDER) -> None:
    """Remember ``path``, keep other settings, and create it."""
    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, "config.json.part")
    with open(part, "w", encoding="utf-8") as f:
        json.dump(_read(folder) | {"memoryPath": path}, f, indent=2)
    os.replace(part, os.path.join(folder, "config.json"))
    os.makedirs(path, exist_ok=True)
