"""Configuration: validated settings, presets, files and environment."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace

METRICS = ("braycurtis", "jaccard", "cosine", "euclidean", "hamming", "manhattan", "weighted_jaccard")
SAMPLING = ("reservoir", "frequency", "adaptive")


@dataclass(frozen=True)
class ProfileConfig:
    k: int = 21
    max_reads: int | None = None
    min_kmer_freq: int = 1
    packed: bool = True
    sketch: bool = False
    sketch_size: int = 1000
    sampling: str = "frequency"
    common_share: float = 0.0  # leave out k-mers that a smaller share of the samples has; 0 keeps all


@dataclass(frozen=True)
class SimilarityConfig:
    metric: str = "braycurtis"
    threshold: float = 0.1
    method: str = "exact"  # or "lsh": estimated Jaccard, pairs at or below the threshold count as unlike


@dataclass(frozen=True)
class StatisticsConfig:
    sample_id_column: str = "sample_id"
    variables: tuple[str, ...] | None = None
    permutations: int = 999
    min_clusters: int = 2
    max_clusters: int = 8
    variant: str = "simple"


@dataclass(frozen=True)
class GroupingConfig:
    min_group_size: int = 2
    max_group_size: int = 10
    max_distance: float = 0.30
    tools: tuple[str, ...] = ("megahit", "spades", "flye")


@dataclass(frozen=True)
class Config:
    profile: ProfileConfig = field(default_factory=ProfileConfig)
    similarity: SimilarityConfig = field(default_factory=SimilarityConfig)
    statistics: StatisticsConfig = field(default_factory=StatisticsConfig)
    grouping: GroupingConfig = field(default_factory=GroupingConfig)

    def problems(self) -> list[str]:
        """What is wrong with the settings, in words."""
        p, s, t, g = self.profile, self.similarity, self.statistics, self.grouping
        tests = [
            (1 <= p.k <= 32, "k must be from 1 to 32"), (p.max_reads is None or p.max_reads > 0, "max_reads must be positive"), (p.min_kmer_freq >= 1, "min_kmer_freq must be positive"),
            (p.sketch_size > 0, "sketch_size must be positive"), (p.sampling in SAMPLING, f"sampling must be one of {', '.join(SAMPLING)}"),
            (s.metric in METRICS, f"metric must be one of {', '.join(METRICS)}"), (0 <= s.threshold <= 1, "threshold must be from 0 to 1"), (s.method in ("exact", "lsh"), "method must be exact or lsh"),
            (s.method == "exact" or s.metric == "jaccard", "lsh estimates the jaccard metric only"), (0 <= p.common_share <= 1, "common_share must be from 0 to 1"),
            (0 <= t.permutations <= 99999, "permutations must be from 0 to 99999"), (2 <= t.min_clusters <= t.max_clusters, "cluster range must start at 2 and not be empty"),
            (t.variant in ("standard", "simple"), "variant must be standard or simple"),
            (1 <= g.min_group_size <= g.max_group_size, "group sizes must be positive and in order"), (0 <= g.max_distance <= 1, "max_distance must be from 0 to 1"),
        ]
        return [text for good, text in tests if not good]

    def advice(self) -> list[str]:
        """Settings that work but are unusual: even k, k outside 11 to 31, fewer than 99 permutations."""
        tests = [(self.profile.k % 2 == 1, "an odd k has no k-mers that equal their reverse complement"), (11 <= self.profile.k <= 31, "k is usually from 11 to 31"), (self.statistics.permutations >= 99, "fewer than 99 permutations give coarse p-values")]
        return [text for good, text in tests if not good]

    def checked(self) -> Config:
        if wrong := self.problems():
            raise ValueError("; ".join(wrong))
        return self

    def updated(self, **changes) -> Config:
        """A copy with settings replaced by name, in whichever section has them; ``ValueError`` for unknown names."""
        out, left = self, dict(changes)
        for section in fields(self):
            own = getattr(out, section.name)
            mine = {f.name: left.pop(f.name) for f in fields(own) if f.name in left}
            out = replace(out, **{section.name: replace(own, **mine)})
        if left:
            raise ValueError(f"unknown settings: {', '.join(left)}")
        return out

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    def summary(self) -> str:
        return "\n".join(f"{s}: " + ", ".join(f"{k}={v}" for k, v in own.items()) for s, own in self.to_dict().items())


def merge(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, section by section."""
    return {k: merge(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}


def from_dict(data: dict) -> Config:
    merged, out = merge(Config().to_dict(), data), {}
    for f in fields(Config):
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in merged[f.name].items()}
        out[f.name] = type(f.default_factory())(**own)
    return Config(**out)


def load(path: str) -> Config:
    """From JSON, or YAML where that library is installed; missing settings are the defaults."""
    with open(path) as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML is not available here; use JSON") from e
        return from_dict(yaml.safe_load(text) or {}).checked()
    return from_dict(json.loads(text)).checked()


def save(config: Config, path: str) -> None:
    with open(path, "w") as f:
        f.write(config.to_json())


def from_environment(prefix: str = "HELIXSPARK_", env: dict[str, str] | None = None) -> Config:
    """Settings from variables such as ``HELIXSPARK_K`` and ``HELIXSPARK_METRIC``."""
    env = dict(os.environ) if env is None else env
    kinds = {f.name: type(getattr(getattr(Config(), s.name), f.name)) for s in fields(Config) for f in fields(getattr(Config(), s.name))}
    found = {}
    for name, kind in kinds.items():
        raw = env.get(prefix + name.upper())
        if raw is not None:
            found[name] = raw.lower() in ("1", "true", "yes") if kind is bool else int(raw) if name == "max_reads" else tuple(raw.split(",")) if kind in (tuple, type(None)) else kind(raw)
    return Config().updated(**found).checked()


PRESETS = {
    "quick": {"k": 15, "max_reads": 1000, "permutations": 99},
    "default": {},
    "high_quality": {"k": 25, "permutations": 9999},
    "large_dataset": {"k": 17, "max_reads": 5000, "permutations": 499, "sketch": True, "min_kmer_freq": 2},
}


def preset(name: str) -> Config:
    if name not in PRESETS:
        raise ValueError(f"unknown preset: {name}; one of {', '.join(PRESETS)}")
    return Config().updated(**PRESETS[name])


def recommended(n_samples: int, memory_gb: float) -> Config:
    return preset("large_dataset" if n_samples > 100 or memory_gb < 8 else "default" if n_samples > 20 else "high_quality")
