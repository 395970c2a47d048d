"""A workspace's settings (TOML), read and changed on the driver."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.redaction import NEVER_CAPTURE, SPAN_BYTES


@dataclass
class Settings:
    embedder: dict = field(default_factory=lambda: {"provider": "bag-of-words", "dim": 32, "precision": ""})
    capture: dict = field(default_factory=lambda: {"enabled": True, "never_capture": list(NEVER_CAPTURE), "max_span_bytes": SPAN_BYTES, "extra_patterns": []})
    redaction: dict = field(default_factory=lambda: {"ruleset": "builtin@1"})
    index: dict = field(default_factory=lambda: {"hybrid": True})


TYPES = {"embedder.provider": str, "embedder.dim": int, "embedder.precision": str, "capture.enabled": bool, "capture.never_capture": list, "capture.max_span_bytes": int, "capture.extra_patterns": list, "redaction.ruleset": str, "index.hybrid": bool}
#: Embedders that send text to another machine need consent in these words.
REMOTE, CONSENT = {"voyage"}, "i accept"


def read_settings(path: str | Path) -> Settings:
    """The file's values over the defaults; a missing file gives the defaults; a value of another type is an error."""
    s = Settings()
    p = Path(path)
    if p.exists():
        for table, values in tomllib.loads(p.read_text(encoding="utf-8")).items():
            if not hasattr(s, table) or not isinstance(values, dict):
                continue
            for k, v in values.items():
                want = TYPES.get(f"{table}.{k}")
                if want and (not isinstance(v, want) or want is int and isinstance(v, bool)):
                    raise ValueError(f"{table}.{k} isn't of type {want.__name__}")
                getattr(s, table)[k] = v
    return s


def _literal(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return str(v) if isinstance(v, int | float) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'


def coerced(key: str, text: str):
    want = TYPES.get(key)
    if want is None:
        raise KeyError(f"no setting {key}")
    if want is bool:
        if text not in ("true", "false"):
            raise ValueError(f"{key} is true or false")
        return text == "true"
    return int(text) if want is int else [x.strip() for x in text.split(",") if x.strip()] if want is list else text


def set_value(path: str | Path, key: str, text: str, consent: str = "") -> Settings:
    """Sets one value, leaves all other lines as they are, and writes only what can be read again."""
    value = coerced(key, text)
    if key == "embedder.provider" and value in REMOTE and consent != CONSENT:
        raise PermissionError("this embedder sends text to another machine")
    p = Path(path)
    table, name = key.split(".")
    old = p.read_text(encoding="utf-8") if p.exists() else ""
    lines, line = old.split("\n"), f"{name} = {_literal(value)}"
    head = next((k for k, x in enumerate(lines) if x.strip() == f"[{table}]"), None)
    if head is None:
        lines = [*(x for x in [old.rstrip("\n")] if x), f"[{table}]", line, ""]
    else:
        end = next((k for k in range(head + 1, len(lines)) if lines[k].startswith("[")), len(lines))
        at = next((k for k in range(head + 1, end) if re.match(rf"\s*{name}\s*=", lines[k])), None)
        lines[at if at is not None else head + 1 : (at if at is not None else head) + 1] = [line]
    new = "\n".join(lines)
    tomllib.loads(new)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(new, encoding="utf-8")
    return read_settings(p)
