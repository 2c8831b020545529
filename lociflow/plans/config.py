"""Configuration: loading, merging, overriding and validation, all on the driver.

A configuration has two sections: ``params`` (by process) and ``exec`` (which processes run, in what
order, on reads with which marks).
"""

from __future__ import annotations

import copy
import json
import logging
import tomllib
from pathlib import Path
from typing import Any

from ..operators import marks as M

log = logging.getLogger("lociflow")

# The default graph.
DEFAULT_EXEC: dict[str, Any] = {
    "mark-support": {"enable": True, "require-marks": [], "exclude-marks": []},
    "mark-overlap": {"enable": True, "require-marks": ["SUPPORTS-VAR"], "exclude-marks": []},
    "mark-low-qual": {"enable": True, "require-marks": ["SUPPORTS-VAR"], "exclude-marks": []},
    "mark-duplicates": {"enable": True, "require-marks": ["SUPPORTS-VAR"], "exclude-marks": ["LOW-QUAL"]},
    "LQF": {"enable": True, "require-marks": ["SUPPORTS-VAR"], "exclude-marks": ["IS-OVERLAPPING-READ2"]},
    "DVF": {"enable": True, "require-marks": ["SUPPORTS-VAR"], "exclude-marks": ["IS-OVERLAPPING-READ2", "LOW-QUAL"]},
    "ALF": {"enable": True, "require-marks": ["SUPPORTS-VAR"], "exclude-marks": ["LOW-QUAL", "IS-OVERLAPPING-READ2", "IS-STUTTER-DUP"]},
    "ADF": {"enable": True, "require-marks": ["SUPPORTS-VAR"], "exclude-marks": ["LOW-QUAL", "IS-OVERLAPPING-READ2", "IS-STUTTER-DUP"]},
    "opts": {"mandate-excludes": True},
}
# The default parameters.
DEFAULT_PARAMS: dict[str, dict[str, Any]] = {
    "mark-low-qual": {"min_avg_clip_quality": 35, "min_mapping_quality": 11, "min_base_quality": 25},
    "mark-duplicates": {"duplication_window_size": 6},
    "LQF": {"read_loss_threshold": 0.99, "min_pass_reads": 2, "nsamples_threshold": 0},
    "DVF": {"read_loss_threshold": 0.49, "min_pass_reads": 2, "nsamples_threshold": 0},
    "ALF": {"avg_AS_threshold": 0.93},
    "ADF": {
        "edge_definition": 0.15,
        "edge_clustering_threshold": 0.9,
        "min_MAD_one_strand": 0,
        "min_sd_one_strand": 4.0,
        "min_MAD_both_strand_weak": 2,
        "min_sd_both_strand_weak": 2.0,
        "min_MAD_both_strand_strong": 1,
        "min_sd_both_strand_strong": 10.0,
        "min_non_edge_reads": 0,
        "low_n_supporting_reads_boundary": 1,
    },
}
# Fixed values: (type, least, most) of each parameter; bounds are inclusive.
_NAT, _REAL, _UNIT = (int, 0, None), (float, 0, None), (float, 0, 1)
RULES: dict[str, dict[str, tuple]] = {
    "mark-support": {},
    "mark-overlap": {},
    "mark-low-qual": {"min_avg_clip_quality": (int, 0, 40), "min_mapping_quality": (int, 0, 255), "min_base_quality": (int, 0, 40)},
    "mark-duplicates": {"duplication_window_size": (int, -1, None)},
    "LQF": {"read_loss_threshold": _UNIT, "min_pass_reads": _NAT, "nsamples_threshold": (int, None, None)},
    "DVF": {"read_loss_threshold": _UNIT, "min_pass_reads": _NAT, "nsamples_threshold": (int, None, None)},
    "ALF": {"avg_AS_threshold": (float, None, None)},
    "ADF": {
        "edge_definition": _UNIT,
        "edge_clustering_threshold": _UNIT,
        "min_MAD_one_strand": _NAT,
        "min_sd_one_strand": _REAL,
        "min_MAD_both_strand_weak": _NAT,
        "min_sd_both_strand_weak": _REAL,
        "min_MAD_both_strand_strong": _NAT,
        "min_sd_both_strand_strong": _REAL,
        "min_non_edge_reads": _NAT,
        "low_n_supporting_reads_boundary": _NAT,
    },
}
#: Marks that the built-in taggers add.
ADDS = {"mark-support": M.SUPPORT, "mark-overlap": M.OVERLAP, "mark-low-qual": M.LOW_QUAL, "mark-duplicates": M.DUPLICATE}
FLAGS = ("LQF", "DVF", "ALF", "ADF")


class ConfigError(ValueError):
    """The configuration can't be run."""


def default() -> dict[str, Any]:
    return {"params": copy.deepcopy(DEFAULT_PARAMS), "exec": copy.deepcopy(DEFAULT_EXEC)}


def load(path: str) -> dict[str, Any]:
    """A TOML or JSON file, by its suffix."""
    kind = Path(path).suffix.lower()
    try:
        if kind == ".toml":
            return tomllib.loads(Path(path).read_text())
        if kind == ".json":
            return json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise ConfigError(f"can't read {path}: {e}") from e
    raise ConfigError(f"{path}: configurations are .toml or .json files")


def json_or_file(value: str) -> Any:
    """JSON from the file of that name if there is one, else from the text itself."""
    try:
        is_file = Path(value).is_file()
    except OSError:  # too long for a name
        is_file = False
    try:
        return json.loads(Path(value).read_text() if is_file else value)
    except ValueError as e:
        raise ConfigError(f"neither a JSON file nor JSON: {value}") from e


def merge(parts: list[dict[str, Any]]) -> dict[str, Any]:
    """Sections of several files together; a section may not be split. No ``exec``: the default graph."""
    out: dict[str, Any] = {}
    for part in parts:
        if twice := out.keys() & part.keys():
            raise ConfigError(f"section in more than one file: {sorted(twice)}")
        out |= copy.deepcopy(part)
    if not out.get("exec"):
        out["exec"] = copy.deepcopy(DEFAULT_EXEC)
    return out


def override(config: dict[str, Any], path: str, value: str) -> dict[str, Any]:
    """A copy with the existing leaf at the dotted ``path`` set to a JSON value; a text that isn't JSON is
    taken as it is, with a warning. Sections and lists are no leaves."""
    out = copy.deepcopy(config)
    at = out
    *parents, leaf = path.split(".")
    for key in parents:
        at = at.get(key) if isinstance(at, dict) else None
    if not isinstance(at, dict) or leaf not in at or isinstance(at[leaf], (dict, list)):
        raise ConfigError(f"no such value in the configuration: {path}")
    try:
        at[leaf] = json.loads(value)
    except ValueError:
        log.warning("%s: %r isn't JSON and is taken as text", path, value)
        at[leaf] = value
    return out


def check_params(process: str, params: dict[str, Any], rules: dict[str, tuple]) -> None:
    if params.keys() != rules.keys():
        raise ConfigError(f"{process}: parameters must be {sorted(rules)}, not {sorted(params)}")
    for name, (kind, least, most) in rules.items():
        v = params[name]
        right = isinstance(v, (int, float) if kind is float else int) and not isinstance(v, bool)
        if not right or least is not None and v < least or most is not None and v > most:
            raise ConfigError(f"{process}.{name}: {v!r} is out of range")


def compile_exec(config: dict[str, Any], adds: dict[str, str] = ADDS, rules: dict[str, dict] = RULES, flags: tuple[str, ...] = FLAGS) -> list[tuple[str, list[str], list[str]]]:
    """Enabled processes in order, each with the marks that it requires and excludes.

    Order is that of the keys in ``exec``. Taggers come before flags; a required mark must come from
    an earlier enabled tagger, and under ``mandate-excludes`` an excluded one too.
    """
    if config.keys() != {"params", "exec"}:
        raise ConfigError(f"sections must be params and exec, not {sorted(config)}")
    params, graph = config["params"], config["exec"]
    if not isinstance(params, dict) or not isinstance(graph, dict):
        raise ConfigError("params and exec must be tables")
    strict = graph.get("opts", {}).get("mandate-excludes")
    if not isinstance(strict, bool):
        raise ConfigError("exec.opts.mandate-excludes must be true or false")
    known = {*adds, *flags}
    if odd := (params.keys() | graph.keys()) - known - {"opts"}:
        raise ConfigError(f"unknown processes: {sorted(odd)}")
    if odd := params.keys() - graph.keys():
        raise ConfigError(f"parameters without an exec entry: {sorted(odd)}")
    out, made, seen_flag = [], [], False
    for name, entry in graph.items():
        if name == "opts":
            continue
        if missing := {"enable", "require-marks", "exclude-marks"} - entry.keys():
            raise ConfigError(f"exec.{name} lacks {sorted(missing)}")
        if not entry["enable"]:
            continue
        check_params(name, params.get(name, {}), rules[name])
        required, excluded = list(entry["require-marks"]), list(entry["exclude-marks"])
        wanted = required + (excluded if strict else [])
        if absent := [m for m in wanted if m not in made]:
            raise ConfigError(f"{name} needs marks that no earlier process adds: {absent}")
        if name in adds:
            if seen_flag:
                raise ConfigError(f"{name} adds marks after a flag has read them")
            if adds[name] in made:
                raise ConfigError(f"two processes add {adds[name]}")
            made.append(adds[name])
        else:
            seen_flag = True
        out.append((name, required, excluded))
    return out
