"""Loads route files: imports and fragments, parameters, secrets, checks, versions."""

from __future__ import annotations

import copy
import hashlib
import json
import re
from pathlib import Path

import yaml


class ConfigError(ValueError):
    """A configuration that can't be used."""


STEP_KINDS = ("filter", "translate", "route", "wiretap", "idempotent", "authorize", "contract", "claim_check", "claim_resolve", "split", "aggregate")
# fixed values: kinds of adapters that a configuration may name
SOURCES = {"http", "file", "sftp", "kafka", "amqp", "s3", "database", "cdc", "parquet"}
SINKS = {"http", "file", "kafka", "amqp", "s3", "database", "parquet"}
TOP = {"version", "imports", "sources", "sinks", "routes", "secrets", "domains"}
_param = re.compile(r"\$\{PARAM:([^}]+)\}")
_secret = re.compile(r"\$\{SECRET:([^}]+)\}")


def merge(base: dict, over: dict) -> dict:
    """Maps merge, the second wins; lists of steps are joined, the first's before."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge(out[k], v)
        elif k == "steps" and isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + copy.deepcopy(v)
        else:
            out[k] = copy.deepcopy(v)
    return out


def _read(path: Path) -> dict:
    try:
        out = yaml.safe_load(path.read_text()) or {}
    except OSError as e:
        raise ConfigError(f"cannot read {path}: {e}") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"cannot parse {path}: {e}") from e
    if not isinstance(out, dict):
        raise ConfigError(f"{path} is no mapping")
    return out


def substitute(x, params: dict):
    """Replaces ${PARAM:name}: a string that is one reference takes the parameter's type."""
    if isinstance(x, dict):
        return {k: substitute(v, params) for k, v in x.items()}
    if isinstance(x, list):
        return [substitute(v, params) for v in x]
    if not isinstance(x, str):
        return x

    def one(name):
        if name not in params:
            raise ConfigError(f"unknown parameter {name!r}")
        return params[name]

    if m := _param.fullmatch(x):
        return copy.deepcopy(one(m[1]))
    return _param.sub(lambda m: str(one(m[1])), x)


def inherit(cfg: dict, base: Path, visiting: tuple[Path, ...] = (), given: dict | None = None) -> dict:
    """Resolves ``$import`` (a file this one builds on) and ``$params``; a child's parameters win."""
    params = {**(cfg.get("$params") or {}), **(given or {})}
    own = {k: v for k, v in cfg.items() if k not in ("$import", "$params")}
    if "$import" in cfg:
        if not isinstance(cfg["$import"], str):
            raise ConfigError("$import is a path")
        path = (base / cfg["$import"]).resolve()
        if path in visiting:
            raise ConfigError(f"circular import: {path}")
        parent = _read(path)
        params = {**(parent.get("$params") or {}), **params}
        own = merge(inherit(parent, path.parent, (*visiting, path), params), own)
    elif not visiting and not params and not _param.search(json.dumps(own, default=str)):
        return own
    return substitute(own, params)


def _fragments(paths: list[str], base: Path, visiting: tuple[Path, ...], found: dict, used_by: dict) -> None:
    for p in paths:
        path = (base / p).resolve()
        if path in visiting:
            raise ConfigError(f"circular import: {path}")
        data = _read(path)
        _fragments(data.get("imports") or [], path.parent, (*visiting, path), found, used_by)
        for name, body in (data.get("fragments") or {}).items():
            if name in found and used_by[name] != path:
                raise ConfigError(f"fragment {name!r} is defined twice")
            steps = body.get("steps") if isinstance(body, dict) else body
            found[name], used_by[name] = steps or [], path


def splice(cfg: dict, base: Path) -> tuple[dict, list[str]]:
    """(configuration with ``fragment`` steps replaced by their steps, imports that no step uses)."""
    found, source = {}, {}
    imports = cfg.get("imports") or []
    for p in imports:
        _fragments([p], base, (), found, source)
    used: set[Path] = set()

    def expand(steps, open_=()):
        out = []
        for s in steps or []:
            name = s.get("fragment") if isinstance(s, dict) else None
            if name is None:
                out.append(s)
                continue
            if name not in found:
                raise ConfigError(f"unknown fragment {name!r}")
            if name in open_:
                raise ConfigError(f"fragment {name!r} contains itself")
            used.add(source[name])
            out += expand(copy.deepcopy(found[name]), (*open_, name))
        return out

    out = {k: v for k, v in cfg.items() if k != "imports"}
    out["routes"] = {n: {**r, "steps": expand(r.get("steps"))} for n, r in (cfg.get("routes") or {}).items()}
    return out, [p for p in imports if (base / p).resolve() not in used]


class Secrets:
    """Secrets by domain; a reference to another domain's secret is refused, an unknown one fails."""

    def __init__(self, values: dict[str, dict[str, str]]):
        self.values = values

    def resolve(self, x, domain: str):
        if isinstance(x, dict):
            return {k: self.resolve(v, domain) for k, v in x.items()}
        if isinstance(x, list):
            return [self.resolve(v, domain) for v in x]
        return _secret.sub(lambda m: self._one(m[1], domain), x) if isinstance(x, str) else x

    def _one(self, name: str, domain: str) -> str:
        owner, slash, key = name.partition("/")
        if slash and owner != domain:
            raise ConfigError(f"domain {domain!r} may not read secret {name!r}")
        key = key if slash else name
        try:
            return self.values[domain][key]
        except KeyError:
            raise ConfigError(f"no secret {name!r} in domain {domain!r}") from None


def step_kind(step: dict) -> str:
    """The one kind of a step."""
    kinds = [k for k in step if k in STEP_KINDS] if isinstance(step, dict) else []
    if len(kinds) != 1 or len(step) != 1:
        raise ConfigError(f"a step has exactly one kind: {step!r}")
    return kinds[0]


def validate(cfg: dict, auth: str = "warn") -> list[str]:
    """Raises ConfigError for what is wrong, and returns warnings."""
    if extra := set(cfg) - TOP:
        raise ConfigError(f"unknown keys {sorted(extra)}")
    if cfg.get("version") != 1:
        raise ConfigError("version must be 1")
    for k in ("sources", "sinks", "routes"):
        if not isinstance(cfg.get(k), dict) or not cfg[k]:
            raise ConfigError(f"{k} is required")
    for group, kinds in (("sources", SOURCES), ("sinks", SINKS)):
        for name, s in cfg[group].items():
            if not isinstance(s, dict) or s.get("type") not in kinds:
                raise ConfigError(f"{group}.{name}: unknown type {s.get('type') if isinstance(s, dict) else s!r}")
    warnings, used = [], set()
    for name, r in cfg["routes"].items():
        sources = r.get("from")
        sources = sources if isinstance(sources, list) else [sources]
        for s in sources:
            if s not in cfg["sources"]:
                raise ConfigError(f"route {name!r}: unknown source {s!r}")
        used.update(sources)
        if not isinstance(r.get("error_path"), dict) or not r["error_path"].get("target"):
            raise ConfigError(f"route {name!r}: error_path is required")
        if r["error_path"]["target"] not in cfg["sinks"]:
            raise ConfigError(f"route {name!r}: unknown sink {r['error_path']['target']!r}")
        if not r.get("steps"):
            raise ConfigError(f"route {name!r}: steps are required")
        for s in r["steps"]:
            step_kind(s)
        if r.get("ordering", "none") not in ("none", "required"):
            raise ConfigError(f"route {name!r}: unknown ordering {r['ordering']!r}")
        if r.get("auth") is None:
            if auth == "strict":
                raise ConfigError(f"route {name!r}: auth is not declared")
            warnings.append(f"route {name!r}: auth is not declared")
    warnings += [f"source {s!r} is not used" for s in cfg["sources"] if s not in used]
    return warnings


# fixed values: what a route's version covers
_VERSIONED = ("from", "auth", "error_path", "ordering", "retry", "steps", "contracts")


def route_version(route: dict) -> str:
    """sha256 of the route's canonical JSON: any change of what it does changes it."""
    body = {k: route[k] for k in _VERSIONED if route.get(k) is not None}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def load(path: str | Path, secrets: Secrets | None = None, auth: str = "warn") -> dict:
    """A resolved, checked configuration with versions, warnings and unused imports."""
    path = Path(path)
    return loads(_read(path), path.resolve().parent, secrets, auth)


def loads(cfg: dict, base: str | Path = ".", secrets: Secrets | None = None, auth: str = "warn") -> dict:
    base = Path(base)
    cfg, unused = splice(inherit(cfg, base), base)
    warnings = validate(cfg, auth)
    for r in cfg["routes"].values():
        r["route_version"] = route_version(r)
    if secrets is not None:
        for group in ("sources", "sinks"):
            for s in cfg[group].values():
                s.update(secrets.resolve(s, s.get("domain", "default")))
    cfg["warnings"], cfg["unused_imports"] = warnings, unused
    return cfg
