"""Run configurations, application presets laid over them, and the stamp of a run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, fields, replace

from strandweave.core.genetic import motifs_of
from strandweave.operators import rules as R
from strandweave.operators.rules import Rule


@dataclass(frozen=True)
class Config:
    """What a run optimises and what it must keep to; None or zero leaves a part out."""

    cai_weight: float = 1.0
    gc_weight: float = 0.0
    gc_target: float = 0.5
    tai_weight: float = 0.0
    cpg_weight: float = 0.0
    cpg_mode: str = "deplete"
    minmax_weight: float = 0.0
    ramp_weight: float = 0.0
    ramp_codons: int = 35
    codon_pair_weight: float = 0.0
    max_homopolymer: int | None = 6
    max_gc_run: int | None = None
    gc_window_nt: int | None = None
    gc_window_min: float = 0.3
    gc_window_max: float = 0.7
    forbidden: tuple[str, ...] = ()
    forbidden_presets: tuple[str, ...] = ()
    sites: tuple[tuple[str, str], ...] = ()
    tandem_unit: int | None = None
    tandem_copies: int = 3
    inverted_stem: int | None = None
    inverted_loop: int = 8
    max_repeat_length: int | None = None
    avoid_splice_sites: bool = False
    avoid_internal_start: bool = False
    avoid_polya: bool = False
    avoid_uorf: bool = False
    uorf_region_nt: int | None = 100
    gc_budget: tuple[float, float] | None = None
    dinucleotide_budget: tuple[str, int, int] | None = None
    refine: bool = False
    refine_steps: int = 2000
    beam: int | None = None
    seed: int = 0
    application_preset: str | None = None

    def faults(self) -> list[str]:
        """Why the parts do not go together; none if they do."""
        out = []
        if self.cpg_mode not in ("deplete", "elevate"):
            out.append(f"cpg_mode {self.cpg_mode!r}")
        if self.gc_budget and self.dinucleotide_budget:
            out.append("two budgets at once")
        if (self.gc_budget or self.dinucleotide_budget) and (self.refine or any(r.context >= R.UNBOUNDED for r in self.rules())):
            out.append("a budget with refinement")
        if self.dinucleotide_budget and (len(self.dinucleotide_budget[0]) != 2 or set(self.dinucleotide_budget[0]) - set("ACGT")):
            out.append("not a dinucleotide")
        return out

    def rules(self) -> list[Rule]:
        out: list[Rule] = []
        if self.max_homopolymer is not None:
            out.append(R.Homopolymer(self.max_homopolymer))
        if self.max_gc_run is not None:
            out.append(R.GcRun(self.max_gc_run))
        if self.gc_window_nt is not None:
            out.append(R.GcWindow(self.gc_window_nt, self.gc_window_min, self.gc_window_max))
        motifs = list(dict.fromkeys([*self.forbidden, *motifs_of(self.forbidden_presets)]))
        if motifs:
            out.append(R.Motifs(tuple(motifs)))
        if self.sites:
            out.append(R.restriction_sites(dict(self.sites)))
        if self.tandem_unit is not None:
            out.append(R.TandemRepeat(self.tandem_unit, self.tandem_copies))
        if self.inverted_stem is not None:
            out.append(R.InvertedRepeat(self.inverted_stem, self.inverted_loop))
        if self.max_repeat_length is not None:
            out.append(R.MaxRepeat(self.max_repeat_length))
        for wanted, rule in ((self.avoid_splice_sites, R.splice_sites()), (self.avoid_internal_start, R.InternalStart()), (self.avoid_polya, R.PolyaSignal()), (self.avoid_uorf, R.Uorf(region=self.uorf_region_nt))):
            if wanted:
                out.append(rule)
        return out


@dataclass(frozen=True)
class Preset:
    key: str
    label: str
    regime: str
    overrides: Mapping[str, object]


#: Limits that the synthesis presets share.
_SYNTHESIS = {"gc_window_nt": 50, "gc_window_min": 0.25, "gc_window_max": 0.65, "max_homopolymer": 6, "max_gc_run": 6, "max_repeat_length": 20}
#: What each application preset sets.
PRESETS = (
    Preset("synthesis", "Gene synthesis", "synthesis", _SYNTHESIS),
    Preset("aav_transgene", "AAV transgene", "vector", {**_SYNTHESIS, "cpg_weight": 1.0, "cpg_mode": "deplete", "avoid_splice_sites": True, "avoid_polya": True, "avoid_uorf": True}),
    Preset("lvv_transgene", "Lentiviral transgene", "vector", {**_SYNTHESIS, "max_repeat_length": 16, "avoid_splice_sites": True, "avoid_polya": True, "avoid_uorf": True}),
    Preset("plasmid_production", "Plasmid production", "plasmid", {**_SYNTHESIS, "max_repeat_length": 16, "max_homopolymer": 5}),
    Preset("mrna_ivt", "In-vitro mRNA", "mrna", {**_SYNTHESIS, "avoid_uorf": True, "refine": True}),
)


def preset(key: str) -> Preset:
    found = {p.key: p for p in PRESETS}
    if key not in found:
        raise KeyError(f"unknown preset {key!r}; known: {', '.join(sorted(found))}")
    return found[key]


def with_preset(key: str, config: Config | None = None) -> Config:
    """The configuration with a preset's values laid over it; what the caller sets afterwards wins. The key goes into the stamp."""
    chosen = preset(key)
    unknown = sorted(set(chosen.overrides) - {f.name for f in fields(Config)})
    if unknown:
        raise TypeError(f"preset {key!r} sets unknown fields: {', '.join(unknown)}")
    return replace(config or Config(), **chosen.overrides, application_preset=key)


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, ASCII: equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str)


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def manifest(config: Config, inputs: Mapping[str, str], version: str, extra: Mapping[str, str] | None = None) -> dict[str, object]:
    """What a run was made from, with a stamp over all of it; ``inputs`` are digests by name."""
    body = {"version": version, "config_hash": digest(asdict(config)), "inputs": dict(inputs), "seed": config.seed, "extra": dict(extra or {})}
    return {**body, "stamp": digest(body)}


def describe(presets: Iterable[Preset] = PRESETS) -> list[tuple[str, str, str, str]]:
    """(key, label, regime, overrides as canonical JSON), for a table."""
    return [(p.key, p.label, p.regime, canonical_json(dict(p.overrides))) for p in presets]
