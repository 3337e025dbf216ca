"""Settings of the outside services and of the store: a file of KEY=value lines, under the environment's variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Services without a token or credentials are not asked. The OCR key is the one for trials."""

    store: str = "store"
    gazetteer_token: str | None = None
    gazetteer_secret: str | None = None
    model_credentials: str | None = None
    model_verify_certificates: bool = False
    ocr_key: str = "helloworld"

    def __repr__(self) -> str:
        return f"Settings(store={self.store!r})"  # no secrets in logs


def lines_of(text: str) -> dict[str, str]:
    """KEY=value lines; blank lines, comments and quotes around values aside."""
    out = {}
    for line in text.splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        value = value.strip()
        if eq and not key.startswith("#"):
            out[key.strip().upper()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def load(path: str | os.PathLike = ".env", environ: Mapping[str, str] = os.environ) -> Settings:
    """Settings by the names of their fields in capitals; unknown names are passed over.

    A store without a scheme that is a relative path is taken from the file's folder, not from where the process runs.
    """
    file = Path(path).resolve()
    given = lines_of(file.read_text(encoding="utf-8")) if file.is_file() else {}
    given |= {k.upper(): v for k, v in environ.items()}
    values = {k: given[k.upper()] for k in Settings.__dataclass_fields__ if k.upper() in given}
    if "model_verify_certificates" in values:
        values["model_verify_certificates"] = values["model_verify_certificates"].strip().lower() in ("1", "true", "yes", "on")
    store = values.get("store", Settings.store)
    return Settings(**values | {"store": store if ":" in store else str(file.parent / store)})
