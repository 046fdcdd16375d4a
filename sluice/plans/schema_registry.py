"""Schema registries that contracts are read from: in memory, or a registry's REST interface.

A backend registers a schema under (group, subject) and gives it back by version or as the latest one. Contracts are
resolved on the driver, once a plan; nothing of this runs with the data.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from sluice.operators.contracts import registry_tag


class RegistryError(RuntimeError):
    """The registry can't be reached, has no such schema, or refuses one."""


class Registry(Protocol):
    kind: str

    def register(self, group: str, subject: str, schema: dict) -> str: ...

    def get(self, group: str, subject: str, version: str = "latest") -> tuple[dict, str]: ...

    def check(self) -> None: ...


def compatible(old: dict, new: dict) -> bool:
    """Whether what fits the old schema fits the new one: nothing more is required, and no type changes."""
    if not set(new.get("required") or ()) <= set(old.get("required") or ()):
        return False
    before, after = old.get("properties") or {}, new.get("properties") or {}
    return all(after[k].get("type") in (None, v.get("type")) for k, v in before.items() if k in after)


class MemoryRegistry:
    """Schemas of this process; versions count from 1. A schema that ``rule`` refuses against the latest is an error;
    the latest schema again is no new version."""

    kind = "memory"

    def __init__(self, rule: Callable[[dict, dict], bool] | None = compatible):
        self.rule, self.schemas, self.healthy = rule, {}, True

    def register(self, group: str, subject: str, schema: dict) -> str:
        self.check()
        if not subject:
            raise RegistryError("a subject is needed")
        versions = self.schemas.setdefault((group or "default", subject), [])
        if versions and versions[-1] == schema:
            return str(len(versions))
        if versions and self.rule and not self.rule(versions[-1], schema):
            raise RegistryError(f"{subject} is not compatible with version {len(versions)}")
        versions.append(json.loads(json.dumps(schema)))
        return str(len(versions))

    def get(self, group: str, subject: str, version: str = "latest") -> tuple[dict, str]:
        self.check()
        versions = self.schemas.get((group or "default", subject), [])
        number = len(versions) if version in ("", "latest") else int(version) if version.isdigit() else 0
        if not 0 < number <= len(versions):
            raise RegistryError(f"no version {version!r} of {subject!r}")
        return json.loads(json.dumps(versions[number - 1])), str(number)

    def check(self) -> None:
        if not self.healthy:
            raise RegistryError("the registry is not healthy")


def send(method: str, url: str, body: bytes | None = None, timeout: float = 10.0) -> tuple[int, str]:
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
    except OSError as e:
        raise RegistryError(f"{url} can't be reached: {e}") from e


class HttpRegistry:
    """A registry with version 3 of the public artifact interface. ``transport``: (method, url, body) -> (status, text)."""

    kind = "apicurio"

    def __init__(self, base: str, transport: Callable[[str, str, bytes | None], tuple[int, str]] = send):
        self.base, self.transport = base.rstrip("/"), transport

    def _versions(self, group: str, subject: str) -> str:
        quote = lambda x: urllib.parse.quote(x, safe="")
        return f"{self.base}/apis/registry/v3/groups/{quote(group or 'default')}/artifacts/{quote(subject)}/versions"

    def _ask(self, method: str, url: str, body: bytes | None = None) -> str:
        status, text = self.transport(method, url, body)
        if not 200 <= status < 300:
            raise RegistryError(f"{method} {url}: {status} {text[:200]}")
        return text

    def register(self, group: str, subject: str, schema: dict) -> str:
        answer = json.loads(self._ask("POST", self._versions(group, subject), json.dumps(schema).encode()))
        return str(answer.get("version") or answer.get("versionId"))

    def latest(self, group: str, subject: str) -> str:
        answer = json.loads(self._ask("GET", self._versions(group, subject)))
        known = [str(v.get("version") or v.get("versionId")) for v in answer.get("versions") or ()]
        if not known:
            raise RegistryError(f"no version of {subject!r}")
        return max(known, key=lambda v: (v.isdigit() and int(v) or 0, v))

    def get(self, group: str, subject: str, version: str = "latest") -> tuple[dict, str]:
        version = self.latest(group, subject) if version in ("", "latest") else version
        return json.loads(self._ask("GET", f"{self._versions(group, subject)}/{urllib.parse.quote(version, safe='')}")), version

    def check(self) -> None:
        self._ask("GET", f"{self.base}/health")


@dataclass(frozen=True)
class Reference:
    """A schema in a registry; ``version`` may be latest."""

    subject: str
    group: str = "default"
    version: str = "latest"


def contract_of(registry: Registry, reference: Reference, strict: bool = False) -> dict:
    """A contract as the contract step takes it: the schema, and a version that names where it came from."""
    schema, version = registry.get(reference.group, reference.subject, reference.version)
    return {"schema": schema, "version": registry_tag(registry.kind, reference.group, reference.subject, version), "strict": strict}
