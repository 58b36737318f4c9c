"""Typed configuration: defaults, presets, TOML files and their merge."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class General:
    log_level: str = "info"
    bp_merge: int = 5_000
    bp_wg_window: int = 10_000_000
    ignore_boundaries: bool = False


@dataclass(frozen=True)
class Coverage:
    n_zscores_low: float = 3.5
    n_zscores_high: float = 3.5
    ratio_collapse: float = 1.5
    ratio_misjoin: float = 0.1
    ratio_false_dupe: float = 0.5
    baseline: int | None = None
    rolling_mean_window: int | None = None


@dataclass(frozen=True)
class Mapq:
    n_zscores_low: float = 1.0
    mapq_agg_fn: str = "Mean"


@dataclass(frozen=True)
class Mismatch:
    n_zscores_high: float = 3.5
    ratio_het: float = 0.1
    rolling_mean_window: int | None = None


@dataclass(frozen=True)
class Indel:
    n_zscores_high: float = 5.0
    ratio_indel: float = 0.2
    min_ins_size: int = 2
    min_del_size: int = 2
    rolling_mean_window: int | None = 3


@dataclass(frozen=True)
class Softclip:
    n_zscores_high: float = 3.5
    ratio_softclip: float = 0.5


@dataclass(frozen=True)
class GroupByIdentity:
    window_size: int = 5_000
    min_grp_size: int = 100_000
    min_ident: float = 80.0


@dataclass(frozen=True)
class Repeats:
    check_types: tuple[str, ...] = ("misjoin", "indel", "false_dupe")
    ratio_repeat: float = 0.5
    bp_extend: int = 5


@dataclass(frozen=True)
class MinimumSize:
    null: int = 1
    low_quality: int = 1
    indel: int = 1
    softclip: int = 1
    collapse: int = 500
    misjoin: int = 1
    false_dupe: int = 500
    scaffold: int = 1
    homopolymer: int = 1
    repeat: int = 1


#: Names of types as a configuration file writes them.
TYPE_NAMES = {"LowQuality": "low_quality", "Indel": "indel", "SoftClip": "softclip", "Collapse": "collapse", "Misjoin": "misjoin", "FalseDupe": "false_dupe"}


@dataclass(frozen=True)
class Config:
    general: General = field(default_factory=General)
    cov: Coverage = field(default_factory=Coverage)
    mapq: Mapq = field(default_factory=Mapq)
    mismatch: Mismatch = field(default_factory=Mismatch)
    indel: Indel = field(default_factory=Indel)
    softclip: Softclip = field(default_factory=Softclip)
    repeat: Repeats | None = field(default_factory=Repeats)
    group_by_ani: GroupByIdentity | None = field(default_factory=GroupByIdentity)
    minimum_size: MinimumSize = field(default_factory=MinimumSize)
    #: Peaks and thresholds in 32-bit floats instead of doubles.
    compat_single: bool = False
    #: Labels of a region that starts at 0 are one less than the bases' positions, and one base without reads follows the last.
    compat_zero_start: bool = False

    @classmethod
    def from_toml(cls, text: str) -> Config:
        """A file must have every section but repeat, group_by_ani and minimum_size, and every
        field there that has no "none"; leaving out the first two turns those features off.  The two
        choices without a section may stand at the top."""
        spec = tomllib.loads(text)
        parts: dict = {"repeat": None, "group_by_ani": None}
        for f in fields(cls):
            if f.name not in SECTIONS:
                parts[f.name] = bool(spec.get(f.name, False))
                continue
            kind = SECTIONS[f.name]
            if f.name not in spec:
                if f.name in ("repeat", "group_by_ani", "minimum_size"):
                    continue
                raise ValueError(f"section [{f.name}] is missing")
            section = dict(spec[f.name])
            optional = {x.name for x in fields(kind) if x.name in ("baseline", "rolling_mean_window")} | ({x.name for x in fields(kind)} if f.name == "minimum_size" else set())
            missing = {x.name for x in fields(kind)} - optional - section.keys()
            if missing:
                raise ValueError(f"[{f.name}] lacks {', '.join(sorted(missing))}")
            if unknown := section.keys() - {x.name for x in fields(kind)}:
                raise ValueError(f"[{f.name}] has unknown {', '.join(sorted(unknown))}")
            for x in optional - section.keys():
                if f.name != "minimum_size":
                    section[x] = None
            if "check_types" in section:
                section["check_types"] = tuple(TYPE_NAMES[t] for t in section["check_types"])
            parts[f.name] = kind(**section)
        return cls(**parts)

    def merge(self, preset: Config) -> Config:
        """This (file) configuration with what a preset decides taken from it."""
        pick = lambda own, other, *names: replace(own, **{n: getattr(other, n) for n in names})
        return replace(
            self,
            cov=pick(self.cov, preset.cov, "n_zscores_low", "rolling_mean_window", "ratio_collapse", "ratio_misjoin"),
            mismatch=pick(self.mismatch, preset.mismatch, "rolling_mean_window"),
            indel=pick(self.indel, preset.indel, "rolling_mean_window", "min_ins_size", "min_del_size"),
            minimum_size=preset.minimum_size,
        )

    def describe(self) -> dict:
        return asdict(self)


SECTIONS = {"general": General, "cov": Coverage, "mapq": Mapq, "mismatch": Mismatch, "indel": Indel, "softclip": Softclip, "repeat": Repeats, "group_by_ani": GroupByIdentity, "minimum_size": MinimumSize}

#: Other spellings of the presets, in lower case.
ALIASES = {"pacbio": "hifi", "hifi": "hifi", "pacbiohifi": "hifi", "pacbio_hifi": "hifi", "ont": "ont_r9", "ontr9": "ont_r9", "ont_r9": "ont_r9", "r9": "ont_r9", "ontr10": "ont_r10", "ont_r10": "ont_r10", "r10": "ont_r10"}


def preset(name: str) -> Config:
    """Configuration of a sequencing technology."""
    kind = ALIASES.get(name.lower())
    if kind is None:
        raise ValueError(f"unknown preset {name!r}; one of hifi, ont_r9, ont_r10")
    if kind == "hifi":
        return Config()
    small = MinimumSize(false_dupe=2)
    if kind == "ont_r9":
        return Config(cov=Coverage(n_zscores_low=1.0, ratio_misjoin=0.2, rolling_mean_window=11), mismatch=Mismatch(rolling_mean_window=25), indel=Indel(rolling_mean_window=None, min_ins_size=20, min_del_size=20), minimum_size=small)
    return Config(cov=Coverage(n_zscores_low=1.0, ratio_misjoin=0.2, rolling_mean_window=5), indel=Indel(rolling_mean_window=None, min_ins_size=10, min_del_size=10), minimum_size=small)


def read_config(path: str | None = None, preset_name: str | None = None) -> Config:
    """Defaults, a preset, a file, or a file with a preset over it."""
    base = preset(preset_name) if preset_name else None
    if path is None:
        return base or Config()
    with open(path, encoding="utf-8") as f:
        own = Config.from_toml(f.read())
    return own.merge(base) if base else own
