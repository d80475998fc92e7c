"""Sources of episodic datasets."""

from __future__ import annotations

from .registry import Registry, SourceProvider

__all__ = ["Registry", "SourceProvider", "default_registry"]


def default_registry() -> Registry:
    """A registry with the formats of this library."""
    from .hdf5 import Hdf5Provider
    from .layouts import LayoutProvider
    from .timestamped import TimestampedProvider

    registry = Registry()
    for provider in (LayoutProvider(), TimestampedProvider(), Hdf5Provider()):
        registry.register(provider, "built in")
    return registry
