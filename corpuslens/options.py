"""Options that plan builders take; no process-wide state, so plans are reproducible."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SearchOptions:
    """How patterns match and what a search returns."""

    ignore_case: bool = False
    word: bool = False
    whole_line: bool = False
    fixed: bool = False
    invert: bool = False
    look_around: bool = False  # look-around and back references, which a linear-time engine refuses
    ascii: bool = False  # ASCII classes and boundaries only
    max_results: int | None = None
    before: int = 0
    after: int = 0

    #: spellings of the flags on a command line
    FLAGS = {"-i": "ignore_case", "--ignore-case": "ignore_case", "-w": "word", "--word-regexp": "word", "-x": "whole_line", "--line-regexp": "whole_line", "-F": "fixed", "--fixed-strings": "fixed", "-v": "invert", "--invert-match": "invert", "-P": "look_around", "--pcre2": "look_around"}

    @classmethod
    def from_flags(cls, flags: list[str], **more) -> SearchOptions:
        """Options from command line flags; ``--case-sensitive`` undoes ``-i`` before it."""
        found: dict = {}
        for f in flags:
            if f in ("-s", "--case-sensitive"):
                found["ignore_case"] = False
            elif f in cls.FLAGS:
                found[cls.FLAGS[f]] = True
            else:
                raise ValueError(f"unsupported search flag: {f}")
        return cls(**found, **more)

    def cache_key(self) -> list[str]:
        """The flags that change what matches."""
        return sorted(k for k in ("ignore_case", "word", "whole_line", "fixed", "invert", "look_around", "ascii") if getattr(self, k))


@dataclass(frozen=True)
class EngineOptions:
    """Sizes and limits; the defaults are those of the service this engine stands in for."""

    max_files: int = 1_000
    large_file_mb: int = 100
    compressed_cache_bytes: int = 1 << 20
    frame_bytes: int = 4 << 20
    frames_per_batch: int = 100
    compression_level: int = 3
    sample_interval_compressed: int = 1_000
    sample_interval_seekable: int = 10_000
    hook_timeout_s: float = 3.0
    store_limit: int = 100_000
    ttl_s: int = 3_600
    search_roots: tuple[str, ...] = field(default=())
    cache_dir: str = "corpuslens-cache"

    @property
    def large_file_bytes(self) -> int:
        return self.large_file_mb << 20

    @property
    def index_step_bytes(self) -> int:
        return self.large_file_bytes // 50

    @classmethod
    def from_env(cls, env: dict[str, str]) -> EngineOptions:
        """Options from environment variables CORPUSLENS_<NAME>; bad numbers are ignored."""
        found: dict = {}
        for name, kind in cls.__annotations__.items():
            raw = env.get(f"CORPUSLENS_{name.upper()}")
            if raw is None:
                continue
            if name == "search_roots":
                found[name] = tuple(dict.fromkeys(x for x in raw.split(":") if x))
            else:
                try:
                    found[name] = {"int": int, "float": float, "str": str}[kind](raw)
                except ValueError:
                    continue
        return cls(**found)
