"""Settings in TOML: [embedding] and [build]. A file that cannot be read gives the defaults and a warning."""

from __future__ import annotations

import os
import tomllib
import warnings
from dataclasses import dataclass, field, fields


@dataclass
class Embedding:
    provider: str = "ollama"
    model: str = "nomic-embed-text"
    host: str | None = None
    base_url: str | None = None
    api_key: str | None = None
    prompt_template: str | None = None
    batch_size: int | None = None


@dataclass
class Build:
    chunk_size: int = 256
    chunk_overlap: int = 128
    max_file_size_kb: int = 1024
    file_types: list[str] | None = None
    exclude_types: list[str] | None = None


@dataclass
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    build: Build = field(default_factory=Build)

    @classmethod
    def parse(cls, text: str) -> Config:
        data = tomllib.loads(text)
        pick = lambda kind, d: kind(**{f.name: d[f.name] for f in fields(kind) if f.name in d})
        return cls(pick(Embedding, data.get("embedding", {})), pick(Build, data.get("build", {})))

    @classmethod
    def load(cls, path: str) -> Config:
        try:
            with open(path, encoding="utf-8") as f:
                return cls.parse(f.read())
        except FileNotFoundError:
            return cls()
        except (OSError, tomllib.TOMLDecodeError, TypeError) as e:
            warnings.warn(f"{path}: {e}; defaults are used", stacklevel=2)
            return cls()

    def to_toml(self) -> str:
        def line(k, v):
            return f"{k} = {v}" if isinstance(v, int) else f"{k} = [{', '.join(repr(x) for x in v)}]" if isinstance(v, list) else f'{k} = "{v}"'

        parts = [f"[{name}]\n" + "\n".join(line(f.name, getattr(s, f.name)) for f in fields(s) if getattr(s, f.name) is not None) for name, s in (("embedding", self.embedding), ("build", self.build))]
        return "\n\n".join(parts) + "\n"

    def shown(self) -> str:
        """As TOML with the API key masked."""
        own = Config(Embedding(**{**self.embedding.__dict__, "api_key": "****" if self.embedding.api_key else None}), self.build)
        return own.to_toml()


def default_path() -> str:
    return os.path.join(os.path.expanduser("~"), ".plumbline", "config.toml")


def init(path: str, force: bool = False) -> bool:
    """Writes the defaults; an existing file is kept unless forced."""
    if os.path.exists(path) and not force:
        return False
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(Config().to_toml())
    return True
