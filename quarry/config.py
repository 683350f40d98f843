"""Settings of an engine over one source tree: defaults, a TOML file that overrides some, checks."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path, PurePosixPath

from quarry import schemas
from quarry.sources import files


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    target: str
    store: str = ".quarry/index"
    watch_extensions: tuple[str, ...] = field(default_factory=lambda: tuple(sorted(files.EXTENSIONS)))
    debounce_seconds: float = schemas.DEBOUNCE_MS / 1000
    embedding_dimensions: int = 64
    max_file_bytes: int = schemas.MAX_FILE_BYTES
    structural_weight: float = schemas.WEIGHTS["structural"]
    semantic_weight: float = schemas.WEIGHTS["semantic"]
    evolutionary_weight: float = schemas.WEIGHTS["evolutionary"]
    coupling_threshold: float = schemas.COUPLING_THRESHOLD
    top_coupled: int = 0
    history: bool = True
    max_commits: int = schemas.MAX_COMMITS
    max_files_per_commit: int = schemas.MAX_FILES_PER_COMMIT

    @classmethod
    def load(cls, target: str, name: str = ".quarry/config.toml") -> Config:
        """The defaults, with what the tree's file sets; a key it does not know is an error."""
        path = Path(target) / name
        if not path.exists():
            return cls(target).checked()
        try:
            given = tomllib.loads(path.read_text())
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{path}: {e}") from e
        if unknown := set(given) - {f.name for f in fields(cls)} | set(given) & {"target"}:
            raise ConfigError(f"{path}: unknown {', '.join(sorted(unknown))}")
        return replace(cls(target), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}).checked()

    @property
    def weights(self) -> dict[str, float]:
        return {"structural": self.structural_weight, "semantic": self.semantic_weight, "evolutionary": self.evolutionary_weight}

    def checked(self) -> Config:
        for name, w in self.weights.items():
            if not math.isfinite(w) or w < 0:
                raise ConfigError(f"{name}_weight must be finite and not negative")
        if sum(self.weights.values()) <= 0:
            raise ConfigError("one weight must be positive")
        if not 0 <= self.coupling_threshold <= 1:
            raise ConfigError("coupling_threshold must be within 0 and 1")
        if self.embedding_dimensions <= 0:
            raise ConfigError("embedding_dimensions must be positive")
        path = PurePosixPath(self.store)
        if not self.store or path.is_absolute() or ".." in path.parts:
            raise ConfigError("store must be a path within the tree")
        return self
