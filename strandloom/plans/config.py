"""Options of the pipelines: defaults, then preset, then what is given; unknown names are an error."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: What each preset changes, and the defaults of the options below.
PRESETS: dict[str, dict] = {
    "pe": {},
    "nanopore-r9": {"pl": "nanopore", "min_support": "auto", "dist_norm": 900, "max_cov": 150, "clip_length": -1, "trust_ins_len": False, "sd": 0.6, "divergence": "auto"},
    "nanopore-r10": {"pl": "nanopore", "min_support": "auto", "dist_norm": 600, "max_cov": 150, "clip_length": -1, "trust_ins_len": False, "sd": 0.35, "thresholds": (0.35,) * 5},
    "pacbio-sequel2": {"pl": "pacbio", "min_support": "auto", "dist_norm": 600, "max_cov": 150, "clip_length": -1, "trust_ins_len": True, "sd": 0.45},
    "pacbio-revio": {"pl": "pacbio", "min_support": "auto", "dist_norm": 600, "max_cov": 150, "clip_length": -1, "trust_ins_len": True, "sd": 0.35, "thresholds": (0.25,) * 5},
}


@dataclass(frozen=True)
class Options:
    pl: str = "pe"
    mq: int = 1
    clip_length: int = 15
    max_cov: int = 200
    max_tlen: int = 1000
    min_support: int | str = 3
    min_size: int = 30
    dist_norm: float = 100
    spd: float = 0.3
    sd: float = 0.8
    search_depth: int = 100
    trust_ins_len: bool = True
    drop_gaps: bool = True
    contigs: bool = True
    diploid: bool = True
    regions_only: bool = False
    symbolic_sv_size: int = 50_000
    thresholds: tuple[float, ...] = (0.45,) * 5
    divergence: float | str = 0.02
    merge_dist: int = 500
    merge_within: bool = False
    merge_across: bool = True
    max_comparisons: int = 0
    sites_prob: float = 0.6
    sites_pass_only: bool = True
    all_sites: bool = False
    support_fraction: float = 0.1
    min_prob: float = 0.1
    pass_prob: float = 1.0
    min_mapq: float = 10
    min_af: float = 0.05
    max_divergence: float = 0.1
    interval_size: int = 1000
    keep_all: bool = False
    verbosity: int = 1

    @staticmethod
    def of(preset: str = "pe", **given) -> Options:
        if preset not in PRESETS:
            raise ValueError(f"unknown preset {preset}; there are {', '.join(PRESETS)}")
        known = {f.name for f in fields(Options)}
        if bad := set(given) - known:
            raise ValueError(f"unknown options: {', '.join(sorted(bad))}")
        return replace(Options(), **(PRESETS[preset] | given))

    @property
    def paired(self) -> bool:
        return self.pl == "pe"

    def shown(self) -> list[tuple[str, object]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]
