"""Configuration: frozen dataclasses with range checks, presets, overrides and JSON.

Only what the engine reads has an effect (mode, filters, transformation, output, policy); the other fields are kept so that
configurations can be written, checked and exchanged.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


class ConfigError(ValueError):
    """A configuration that cannot be used; field says where."""

    def __init__(self, message: str, where: str | None = None):
        super().__init__(message)
        self.field = where


def _check(obj: Any, **rules: tuple[float | None, float | None]) -> None:
    for name, (low, high) in rules.items():
        value = getattr(obj, name)
        if value is not None and ((low is not None and value < low) or (high is not None and value > high)):
            raise ConfigError(f"{name} must be in [{low}, {high}], not {value}", name)


def _one_of(obj: Any, name: str, allowed: tuple[str, ...]) -> None:
    if getattr(obj, name) not in allowed:
        raise ConfigError(f"{name} must be one of {', '.join(allowed)}", name)


@dataclass(frozen=True)
class Recovery:
    strategy: str = "balanced"
    max_recovery_attempts: int = 10
    confidence_threshold: float = 0.3
    severity_escalation_threshold: int = 5

    def __post_init__(self) -> None:
        _one_of(self, "strategy", ("conservative", "balanced", "aggressive", "custom"))
        _check(self, max_recovery_attempts=(0, None), confidence_threshold=(0, 1))


@dataclass(frozen=True)
class Assembly:
    strict_mode: bool = False
    max_assembly_depth: int = 100
    repair_confidence_threshold: float = 0.5
    cache_size_limit: int = 1000

    def __post_init__(self) -> None:
        _check(self, max_assembly_depth=(0, None), repair_confidence_threshold=(0, 1), cache_size_limit=(0, None))


@dataclass(frozen=True)
class Filtering:
    mode: str = "include"
    token_types: tuple[str, ...] | None = None
    confidence_threshold: float = 0.0
    content_pattern: str | None = None
    case_sensitive: bool = True
    max_results: int | None = None

    def __post_init__(self) -> None:
        _one_of(self, "mode", ("include", "exclude", "transform"))
        _check(self, confidence_threshold=(0, 1), max_results=(0, None))


@dataclass(frozen=True)
class Streaming:
    buffer_size: int = 8192
    chunk_size: int = 1024
    memory_limit_bytes: int | None = None

    def __post_init__(self) -> None:
        _check(self, buffer_size=(1, None), chunk_size=(1, None), memory_limit_bytes=(1, None))


@dataclass(frozen=True)
class Performance:
    enable_fast_path: bool = True
    fast_path_threshold: float = 0.7
    cache_size_limit: int = 10_000

    def __post_init__(self) -> None:
        _check(self, fast_path_threshold=(0, 1), cache_size_limit=(0, None))


@dataclass(frozen=True)
class Tokenization:
    recovery: Recovery = field(default_factory=Recovery)
    assembly: Assembly = field(default_factory=Assembly)
    filtering: Filtering = field(default_factory=Filtering)
    streaming: Streaming = field(default_factory=Streaming)
    performance: Performance = field(default_factory=Performance)

    @classmethod
    def conservative(cls) -> Tokenization:
        return cls(Recovery("conservative"), Assembly(strict_mode=True, repair_confidence_threshold=0.8), performance=Performance(False))

    @classmethod
    def balanced(cls) -> Tokenization:
        return cls()

    @classmethod
    def aggressive(cls) -> Tokenization:
        return cls(Recovery("aggressive", 20))


@dataclass(frozen=True)
class Character:
    encoding_confidence_threshold: float = 0.7
    fallback_encoding: str = "utf-8"
    transformation: str = "lenient"
    memory_limit_bytes: int | None = None

    def __post_init__(self) -> None:
        _one_of(self, "transformation", ("strict", "lenient", "data_recovery"))
        _check(self, encoding_confidence_threshold=(0, 1), memory_limit_bytes=(1, None))


@dataclass(frozen=True)
class Tree:
    mode: str = "contract"
    max_repair_depth: int = 50
    repair_confidence_threshold: float = 0.6
    validation_strictness: str = "balanced"
    max_tree_depth: int = 1000
    cache_size_limit: int = 1000

    def __post_init__(self) -> None:
        _one_of(self, "mode", ("contract", "observed"))
        _one_of(self, "validation_strictness", ("strict", "balanced", "lenient"))
        _check(self, max_repair_depth=(0, None), repair_confidence_threshold=(0, 1), max_tree_depth=(1, None), cache_size_limit=(0, None))


@dataclass(frozen=True)
class Global:
    logging_level: str = "INFO"
    diagnostic_detail_level: str = "standard"
    security_level: str = "strict"
    max_input_size_bytes: int | None = None
    cache_size_limit: int = 15_000

    def __post_init__(self) -> None:
        _one_of(self, "logging_level", ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"))
        _one_of(self, "diagnostic_detail_level", ("minimal", "standard", "detailed", "comprehensive"))
        _one_of(self, "security_level", ("paranoid", "strict", "permissive"))
        _check(self, max_input_size_bytes=(1, None), cache_size_limit=(0, None))


@dataclass(frozen=True)
class Config:
    """All components; immutable. override(tree__mode="observed") gives a changed copy."""

    character: Character = field(default_factory=Character)
    tokenization: Tokenization = field(default_factory=Tokenization)
    tree: Tree = field(default_factory=Tree)
    global_: Global = field(default_factory=Global)
    name: str = "default"

    def __post_init__(self) -> None:
        caches = self.tokenization.assembly.cache_size_limit + self.tokenization.performance.cache_size_limit + self.tree.cache_size_limit
        if caches > self.global_.cache_size_limit:
            raise ConfigError(f"component caches ({caches}) exceed the global limit ({self.global_.cache_size_limit})", "cache_size_limit")
        limit = self.global_.max_input_size_bytes
        if limit and self.character.memory_limit_bytes and self.character.memory_limit_bytes > limit:
            raise ConfigError("the character stage may use more memory than an input may have", "memory_limit_bytes")

    def override(self, **changes: Any) -> Config:
        out = self
        for path, value in changes.items():
            out = _replaced(out, path.split("__"), value)
        return out

    def to_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Config:
        return _built(cls, data)

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls.from_dict(json.loads(text))

    @classmethod
    def preset(cls, name: str) -> Config:
        if name not in PRESETS:
            raise ConfigError(f"unknown preset: {name}", "name")
        return PRESETS[name]


def _replaced(obj: Any, path: list[str], value: Any) -> Any:
    if path[0] == "global" and hasattr(obj, "global_"):
        path = ["global_", *path[1:]]
    if not any(f.name == path[0] for f in fields(obj)):
        raise ConfigError(f"no such field: {path[0]}", path[0])
    return dataclasses.replace(obj, **{path[0]: value if len(path) == 1 else _replaced(getattr(obj, path[0]), path[1:], value)})


def _built(kind: Any, data: dict[str, Any]) -> Any:
    default = kind()
    known = {f.name for f in fields(kind)}
    if extra := set(data) - known:
        raise ConfigError(f"no such field: {sorted(extra)[0]}", sorted(extra)[0])
    made = {}
    for k, v in data.items():
        now = getattr(default, k)
        made[k] = _built(type(now), v) if is_dataclass(now) else tuple(v) if isinstance(v, list) else v
    return kind(**made)


PRESETS = {
    "default": Config(),
    "maximum_robustness": Config(Character(0.5), Tokenization.aggressive(), Tree(max_repair_depth=100, repair_confidence_threshold=0.3, validation_strictness="lenient"), Global(diagnostic_detail_level="comprehensive"), "maximum_robustness"),
    "web_scraping": Config(Character(), Tokenization.balanced(), Tree(validation_strictness="lenient"), Global(), "web_scraping"),
    "data_recovery": Config(Character(transformation="data_recovery"), Tokenization.aggressive(), Tree(max_repair_depth=200, repair_confidence_threshold=0.1, validation_strictness="lenient"), Global(diagnostic_detail_level="comprehensive"), "data_recovery"),
    "performance_optimized": Config(Character(), Tokenization(), Tree(validation_strictness="strict"), Global(diagnostic_detail_level="minimal"), "performance_optimized"),
}


#: What is said of odd settings of chunked reading, and the smallest and largest buffer that are not told (fixed values).
STREAM_WARNINGS = {
    "positive": "Buffer size must be positive",
    "exceeds": "Buffer size exceeds maximum memory limit",
    "memory": "Maximum memory must be positive",
    "strict": "Strict XML mode with streaming disabled may cause memory issues with large files",
    "small": "Very small buffer size may impact performance",
    "large": "Very large buffer size may impact memory usage",
}
MIN_BUFFER, MAX_BUFFER = 1024, 1 << 20


def stream_warnings(buffer_size: int, max_memory: int | None = None, strict: bool = False, streaming: bool = True) -> list[str]:
    """What is odd about the settings of chunked reading."""
    holds = {
        "positive": buffer_size <= 0, "exceeds": max_memory is not None and 0 < buffer_size and buffer_size > max_memory, "memory": max_memory is not None and max_memory <= 0,
        "strict": strict and not streaming, "small": buffer_size < MIN_BUFFER, "large": buffer_size > MAX_BUFFER,
    }
    return [text for k, text in STREAM_WARNINGS.items() if holds[k]]
