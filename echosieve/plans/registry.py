"""The modes a user runs, each a function of tables and settings to a result table; plugins add theirs."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from ..conf import Settings
from . import modes

Run = Callable[[dict[str, DataFrame], Settings], DataFrame]
KINDS = ("mode", "preprocessor", "secondary_mode", "script")


@dataclass(frozen=True)
class Plugin:
    """A named plan. ``needs`` names the tables it reads; ``defaults`` the settings it starts from."""

    name: str
    title: str
    run: Run
    needs: tuple[str, ...]
    kind: str = "mode"
    strategy: str | None = None
    defaults: dict = field(default_factory=dict)


class Registry:
    """Plugins by name; a name is taken once."""

    def __init__(self) -> None:
        self._plugins: dict[str, Plugin] = {}

    def add(self, plugin: Plugin) -> Plugin:
        if plugin.name in self._plugins or plugin.kind not in KINDS:
            raise ValueError(f"{plugin.name} is known already, or {plugin.kind} isn't a kind")
        self._plugins[plugin.name] = plugin
        return plugin

    def discover(self, folder: str) -> list[str]:
        """Add the plugins of every module in a folder, which it lists as ``PLUGINS``; the names added.

        A module that can't be imported or whose plugins are known is an error with its name.
        """
        added = []
        for path in sorted(Path(folder).glob("*.py")):
            spec = importlib.util.spec_from_file_location(f"echosieve_plugin_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            try:
                spec.loader.exec_module(module)
                added += [self.add(p).name for p in getattr(module, "PLUGINS", ())]
            except Exception as x:
                raise ImportError(f"plugin {path.name}: {x}") from x
        return added

    def settings(self, name: str, own: dict) -> Settings:
        """A plugin's defaults under a user's own settings."""
        return Settings(**(self._plugins[name].defaults | own))

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(n for n, p in self._plugins.items() if kind in (None, p.kind))

    def run(self, name: str, tables: dict[str, DataFrame], settings: Settings | None = None) -> DataFrame:
        """Run a plan after its preprocessors' settings; missing tables are named."""
        plugin = self._plugins[name]
        if missing := set(plugin.needs) - set(tables):
            raise KeyError(f"{name} needs {', '.join(sorted(missing))}")
        return plugin.run(tables, settings or Settings(**plugin.defaults))


def built_in() -> Registry:
    """A registry of the engine's own modes."""
    out = Registry()
    out.add(Plugin("mutual_comparison", "Pages against each other", modes.mutual, ("images",), strategy="mutual_comparison"))
    out.add(Plugin("ad_comparison", "Pages against known ads", modes.ad, ("images", "ads"), strategy="ad_comparison"))
    out.add(Plugin("targeted_search", "The nearest page of each ad", modes.targeted, ("images", "ads")))
    out.add(Plugin("qr_detection", "Pages with codes", modes.qr, ("images",), strategy="qr_detection"))
    out.add(Plugin("qr_hybrid", "Pages with codes that known ads explain", modes.qr_hybrid, ("images", "ads"), strategy="qr_detection"))
    out.add(Plugin("volume_duplicates", "Volumes that repeat", modes.volumes, ("images",), "secondary_mode", "volume_duplicates"))
    out.add(Plugin("ghost_records", "Catalogue records without a file", modes.ghosts, ("catalogue", "inventory"), "secondary_mode"))
    out.add(Plugin("catalogue_sync", "Catalogue in step with the listing", modes.sync, ("catalogue", "inventory"), "preprocessor"))
    return out
