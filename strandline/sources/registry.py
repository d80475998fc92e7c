"""Source providers: how a named format with options becomes a dataset."""

from __future__ import annotations

import importlib
import inspect
import json
import os
import tomllib
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass, fields, is_dataclass
from importlib import metadata
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from ..model import Dataset

ENTRY_POINTS = "strandline.sources"
ENVIRONMENT = "STRANDLINE_SOURCES"


class SourceProvider(ABC):
    """A format: its name, aliases, configuration and how to open it."""

    name: str
    aliases: tuple[str, ...] = ()
    api_version = 1
    config_type: type | None = None

    @abstractmethod
    def open(self, spark: SparkSession, root: str, config: Any = None) -> Dataset: ...

    def config_to_dict(self, config: Any) -> dict[str, Any]:
        """A configuration as JSON-safe values."""
        raw = {} if config is None else asdict(config) if is_dataclass(config) else dict(config)
        return json.loads(json.dumps(raw))

    def config_from_dict(self, raw: dict[str, Any]) -> Any:
        if self.config_type is None:
            if raw:
                raise ValueError(f"{self.name} takes no options")
            return None
        known = {f.name for f in fields(self.config_type)}
        if unknown := sorted(set(raw) - known):
            raise ValueError(f"unknown options of {self.name}: {', '.join(unknown)}")
        return self.config_type(**raw)

    def spec(self, root: str, config: Any = None) -> dict[str, Any]:
        """A portable description that ``Registry.open_spec`` opens anywhere."""
        return {"provider": self.name, "api_version": self.api_version, "root": str(root), "config": self.config_to_dict(config)}


@dataclass(frozen=True)
class ProviderInfo:
    name: str
    aliases: tuple[str, ...]
    origin: str


class Registry:
    """Providers by name and alias."""

    def __init__(self) -> None:
        self._by_name: dict[str, SourceProvider] = {}
        self._info: dict[str, ProviderInfo] = {}
        self._seen: set[str] = set()

    def register(self, provider: SourceProvider, origin: str = "code") -> None:
        names = (provider.name, *provider.aliases)
        if taken := [n for n in names if n in self._by_name]:
            raise ValueError(f"source names already in use: {', '.join(taken)}")
        for n in names:
            self._by_name[n] = provider
        self._info[provider.name] = ProviderInfo(provider.name, tuple(provider.aliases), origin)

    def get(self, name: str) -> SourceProvider:
        if name not in self._by_name:
            raise KeyError(f"no source named {name!r}; there are {', '.join(self.choices())}")
        return self._by_name[name]

    def choices(self) -> list[str]:
        return sorted(self._by_name)

    def infos(self) -> list[ProviderInfo]:
        return [self._info[k] for k in sorted(self._info)]

    def info(self, name: str) -> ProviderInfo:
        return self._info[self.get(name).name]

    def register_module(self, reference: str, origin: str | None = None) -> None:
        """Registers ``module:object``: a provider, its class, or a function that makes one."""
        if reference in self._seen:
            return
        module, colon, attribute = reference.partition(":")
        if not colon or not attribute:
            raise ValueError(f"not of the form module:object: {reference!r}")
        found = importlib.import_module(module)
        for part in attribute.split("."):
            found = getattr(found, part)
        provider = found() if inspect.isclass(found) or (callable(found) and not isinstance(found, SourceProvider)) else found
        if not isinstance(provider, SourceProvider):
            raise TypeError(f"{reference} is not a source provider")
        self.register(provider, origin or reference)
        self._seen.add(reference)

    def discover(self, local_file: str | Path | None = None) -> None:
        """Registers what entry points, a TOML file (``sources = [...]``) and the environment name; each once."""
        for point in metadata.entry_points(group=ENTRY_POINTS):
            self.register_module(point.value, f"entry point {point.name}")
        if local_file and Path(local_file).is_file():
            for reference in tomllib.loads(Path(local_file).read_text()).get("sources", []):
                self.register_module(reference, str(local_file))
        for reference in filter(None, os.environ.get(ENVIRONMENT, "").split(",")):
            self.register_module(reference.strip(), ENVIRONMENT)

    def open_spec(self, spark: SparkSession, spec: dict[str, Any]) -> Dataset:
        provider = self.get(spec["provider"])
        if spec.get("api_version", 1) != provider.api_version:
            raise ValueError(f"{provider.name} speaks version {provider.api_version}, not {spec.get('api_version')}")
        return provider.open(spark, spec["root"], provider.config_from_dict(spec.get("config") or {}))
