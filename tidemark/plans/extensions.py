"""Descriptors of extensions: what selectors, comparators and metadata keys a package adds.  They describe and run nothing."""

from __future__ import annotations

from dataclasses import dataclass, replace


def _named(*texts: str) -> None:
    if any(not t or not t.strip() for t in texts):
        raise ValueError("an extension's texts are not blank")


@dataclass(frozen=True)
class Extension:
    """Built up by adding; every step gives a new descriptor."""

    id: str
    display_name: str
    selectors: tuple[tuple[str, str], ...] = ()
    comparators: tuple[tuple[str, str], ...] = ()
    metadata_keys: tuple[str, ...] = ()

    def __post_init__(self):
        _named(self.id, self.display_name)

    def with_selector(self, name: str, description: str) -> Extension:
        _named(name, description)
        return replace(self, selectors=(*self.selectors, (name, description)))

    def with_comparator(self, declaration: str, description: str) -> Extension:
        _named(declaration, description)
        return replace(self, comparators=(*self.comparators, (declaration, description)))

    def with_metadata_key(self, key: str) -> Extension:
        _named(key)
        return replace(self, metadata_keys=(*self.metadata_keys, key))
