"""Where an engine keeps its zones."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Zones by name; the value is a path below the root.
ZONES = {"bronze": "bronze", "gold_texts": "gold/texts", "gold_tables": "gold/tables", "gold_images": "gold/images", "gold_metadata": "gold/metadata", "silver": "silver/chunks", "index": "index", "manifest": "manifest", "metrics": "metrics"}


@dataclass(frozen=True)
class EngineConfig:
    """Paths of the zones below any Hadoop path; unknown names give the root itself."""

    root: str
    zones: dict[str, str] = field(default_factory=lambda: dict(ZONES))

    def path(self, zone: str, *parts: str) -> str:
        base = f"{self.root}/{self.zones[zone]}" if zone in self.zones else self.root
        return "/".join([base, *parts])

    def _fs(self, spark, path: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where

    def create(self, spark) -> None:
        for zone in self.zones:
            fs, where = self._fs(spark, self.path(zone))
            fs.mkdirs(where)

    def missing(self, spark) -> list[str]:
        """Zones whose folder does not exist."""
        out = []
        for zone in self.zones:
            fs, where = self._fs(spark, self.path(zone))
            if not fs.exists(where):
                out.append(zone)
        return out

    def drop(self, spark, zone: str, confirm: bool = False) -> bool:
        """Delete a known zone; only where confirm is true."""
        if not confirm or zone not in self.zones:
            return False
        fs, where = self._fs(spark, self.path(zone))
        return bool(fs.delete(where, True))
