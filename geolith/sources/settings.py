"""Settings files: ``key: value`` lines, indented lists, ``//`` comments."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from geolith.functions import tags, text


@dataclass
class Settings:
    """Names, defaults and ranges of the build settings."""

    max_tiles: int = 64000
    min_tile_density: int = 75000
    tile_zoom_levels: tuple[int, ...] = (0, 3, 6, 9, 12)
    max_strings: int = 32000
    min_string_usage: int = 300
    rtree_bucket_size: int = 16
    max_key_indexes: int = 6
    key_index_min_features: int = 300
    indexed_keys: tuple[str, ...] = tags.INDEXED_KEYS
    excluded_keys: tuple[str, ...] = ()
    id_indexing: bool | None = None
    tag_duplicate_nodes: bool = False
    tag_orphan_nodes: bool = False
    updatable: bool = False
    source: str = ""
    properties: dict[str, str] = field(default_factory=dict)

    RANGES = {"max_tiles": (1, 8 << 20), "min_tile_density": (1, 10_000_000), "max_strings": (256, 65536), "rtree_bucket_size": (4, 256), "max_key_indexes": (0, 32)}

    def set(self, name: str, value: str, strict: bool = True) -> None:
        """``strict``: an unknown name is an error, as on a command line; in a file it is passed over."""
        key = name.replace("-", "_")
        kinds = {f.name: f.type for f in fields(self)}
        if key not in kinds or key == "properties":
            if strict:
                raise ValueError(f"unknown setting: {name}")
            return
        if key == "tile_zoom_levels":
            self.tile_zoom_levels = tuple(sorted({0, *(int(x) for x in value.replace(",", " ").split())}))
        elif key in ("indexed_keys", "excluded_keys"):
            setattr(self, key, tuple(value.replace(",", " ").split()))
            tags.categories(list(self.indexed_keys))
        elif "bool" in kinds[key]:
            setattr(self, key, text.parse_boolean(value or None))
        elif "int" in kinds[key]:
            low, high = self.RANGES.get(key, (0, 1 << 62))
            setattr(self, key, int(text.in_range(text.parse_size(value), low, high, name)))
        else:
            setattr(self, key, value)

    @property
    def has_id_index(self) -> bool:
        return self.updatable if self.id_indexing is None else self.id_indexing


def parse(content: str) -> Settings:
    """Top-level keys are settings; the section ``properties`` is kept; other sections are passed over."""
    out, section, items = Settings(), None, []

    def close() -> None:
        if section and items:
            if section == "properties":
                out.properties.update((k.strip(), v.strip()) for k, _, v in (i.partition(":") for i in items))
            else:
                out.set(section, " ".join(items), strict=False)

    for raw in content.splitlines():
        line = raw.split("//")[0].rstrip() if "://" not in raw else raw.rstrip()
        if not line.strip():
            continue
        if line[0] in " \t":
            items.append(line.strip())
            continue
        close()
        key, _, value = line.partition(":")
        section, items = key.strip(), []
        if value.strip():
            out.set(section, value.strip(), strict=False)
            section = None
    close()
    return out
