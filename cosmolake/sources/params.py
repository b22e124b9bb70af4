"""Run parameters from INI files, with defaults."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Parameters:
    """Parameters of a finder run; thresholds have the usual values."""

    ic_filename: str = ""
    ic_filetype: int = 60
    outfile_prefix: str = "out"
    lgrid_domain: int = 64
    lgrid_max: int = 16_777_216
    n_per_dom_cell: float = 2.0
    n_per_ref_cell: float = 2.5
    vesc_tune: float = 1.5
    n_min_per_halo: int = 20
    rho_vir: int = 0
    d_vir: float = 200.0
    max_gather_rad: float = 3.0


_NAMES = {
    "LgridDomain": "lgrid_domain", "LgridMax": "lgrid_max", "NperDomCell": "n_per_dom_cell", "NperRefCell": "n_per_ref_cell", "VescTune": "vesc_tune",
    "NminPerHalo": "n_min_per_halo", "RhoVir": "rho_vir", "Dvir": "d_vir", "MaxGatherRad": "max_gather_rad",
}


def sections(text: str) -> dict[str, dict[str, str]]:
    """All sections of an INI text; keys keep their case, # and ; begin comments."""
    p = configparser.ConfigParser(inline_comment_prefixes=("#", ";"), interpolation=None, strict=False)
    p.optionxform = str
    p.read_string(text)
    return {s: dict(p[s]) for s in p.sections()}


def parameters(text: str, section: str = "") -> Parameters:
    """Typed parameters from the section of that name, or from all of them in order."""
    found: dict[str, str] = {}
    for name, values in sections(text).items():
        if not section or name == section:
            found |= values
    known = {f.name: f.type for f in fields(Parameters)}
    out = {}
    for k, v in found.items():
        name = _NAMES.get(k, k)
        if name in known:
            out[name] = {"int": lambda x: int(float(x)), "float": float, "str": str}[known[name]](v)
    return Parameters(**out)
