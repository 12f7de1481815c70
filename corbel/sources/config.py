"""The workspace configuration: which systems there are, and where their files lie."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ADAPTERS = {"catalog": ("catalog-json", "custom-elements-manifest", "react-docgen"), "tokens": ("css-vars", "dtcg")}
SYSTEMS = "id string, name string, root string, data_dir string, catalog_adapter string, tokens_adapter string, token_files array<string>, docs_include array<string>, docs_exclude array<string>"


class ConfigError(ValueError):
    """The configuration can't be used, with the reason."""


def read_config(path: str) -> dict:
    """The checked configuration; a missing file, bad JSON, a bad shape and no systems are told apart."""
    try:
        config = json.loads(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise ConfigError(f"no configuration at {path}: {e.strerror}") from e
    except ValueError as e:
        raise ConfigError(f"{path} is not valid JSON: {e}") from e
    systems = config.get("systems") if isinstance(config, dict) else None
    if not isinstance(systems, dict):
        raise ConfigError(f"{path}: `systems` must be an object")
    if not systems:
        raise ConfigError(f"{path}: there are no systems")
    for name, system in systems.items():
        for part, known in ADAPTERS.items():
            told = system.get(part) if isinstance(system, dict) else None
            if (told or part == "catalog") and (not isinstance(told, dict) or told.get("adapter") not in known):
                raise ConfigError(f"{path}: systems.{name}.{part}.adapter must be one of {', '.join(known)}")
    return config


def root_of(system_id: str, system: dict, folder: str) -> str | None:
    """A variable that is set beats the root that is told; both count from the configuration's folder."""
    name = system.get("rootEnv") or "".join(c if c.isalnum() else "_" for c in system_id).upper() + "_DIR"
    root = os.environ.get(name) or system.get("root")
    return os.path.normpath(os.path.join(folder, root)) if root else None


def systems(spark: SparkSession, path: str) -> DataFrame:
    """One row per configured system."""
    folder, rows = os.path.dirname(os.path.abspath(path)), []
    for sid, s in read_config(path)["systems"].items():
        tokens, docs = s.get("tokens") or {}, s.get("docs") or {}
        data = os.path.normpath(os.path.join(folder, s.get("dataDir") or f"data/{sid}"))
        rows.append((sid, s.get("name"), root_of(sid, s, folder), data, s["catalog"]["adapter"], tokens.get("adapter"), tokens.get("files"), docs.get("include"), docs.get("exclude")))
    return spark.createDataFrame(rows, SYSTEMS)
