"""Policies and provenance: small control files that the driver reads."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from typing import Any

from siftwork.errors import DataIntegrityError, UserInputError


def load(path: str, kind: type) -> Any:
    """A dataclass from a JSON or YAML mapping; unknown keys are refused."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        raw = yaml.safe_load(text)
    else:
        raw = json.loads(text)
    if not isinstance(raw, dict):
        raise UserInputError(f"{path} isn't a mapping")
    known = {f.name for f in dataclasses.fields(kind)}
    extra = sorted(set(raw) - known)
    if extra:
        raise UserInputError(f"{path} has unknown keys: {', '.join(extra)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def file_sha256(path: str, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            digest.update(block)
    return digest.hexdigest()


def check_provenance(selection: dict[str, Any], run: dict[str, Any], sidecar: dict[str, Any], checkpoint: str) -> None:
    """Selection, run and split sidecar must name the same split, and the checkpoint must be the selected file."""
    splits = {"selection": selection.get("split_sha256"), "run": run.get("split_sha256"), "sidecar": sidecar.get("split_sha256")}
    if None in splits.values() or len(set(splits.values())) != 1:
        raise DataIntegrityError(f"split digests differ: {splits}")
    found = file_sha256(checkpoint)
    if found != selection.get("checkpoint_sha256"):
        raise DataIntegrityError(f"{checkpoint} isn't the selected checkpoint")
