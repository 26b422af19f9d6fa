"""Git repositories as sources: addresses, tokens, clones and a cache of clones. All of it runs on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import subprocess
import tempfile
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path
from urllib.parse import quote

PROVIDERS = {"github.com": "github", "gitlab.com": "gitlab", "bitbucket.org": "bitbucket"}
TOKENS = {"github": ("GITHUB_TOKEN", "GH_TOKEN"), "gitlab": ("GITLAB_TOKEN", "GL_TOKEN")}
TTL_SECONDS = 24 * 3600
_FORMS = (("https", re.compile(r"^https?://(?:[^@/]+@)?([^/:]+)(?::\d+)?/([^/]+)/([^/]+?)(?:\.git)?/?$")), ("ssh", re.compile(r"^(?:ssh://)?git@([^/:]+)[:/](?:\d+/)?([^/]+)/([^/]+?)(?:\.git)?/?$")), ("git", re.compile(r"^git://([^/:]+)(?::\d+)?/([^/]+)/([^/]+?)(?:\.git)?/?$")))


class GitError(Exception):
    """A Git operation failed."""


@dataclass(frozen=True)
class Address:
    protocol: str
    host: str
    owner: str
    repo: str

    @property
    def provider(self) -> str:
        return PROVIDERS.get(self.host.lower(), "generic")

    @property
    def project_id(self) -> str:
        return f"{self.owner}-{self.repo}"

    def url(self, protocol: str = "https") -> str:
        return f"https://{self.host}/{self.owner}/{self.repo}.git" if protocol == "https" else f"git@{self.host}:{self.owner}/{self.repo}.git"

    def cache_key(self, branch: str | None = None) -> str:
        return hashlib.sha256(f"{self.host}/{self.owner}/{self.repo}/{branch or 'default'}".encode()).hexdigest()[:16]


def parse(url: str) -> Address:
    for protocol, rx in _FORMS:
        if m := rx.match(url.strip()):
            return Address(protocol, *m.groups())
    raise GitError("not a Git address: " + re.sub(r"//[^@/]*@", "//", url))


def is_git_url(url: str) -> bool:
    return any(rx.match(url.strip()) for _, rx in _FORMS)


def credentials(provider: str, given: dict[str, str] | None = None, env: dict[str, str] | None = None) -> dict[str, str]:
    """Given credentials over those of the environment: ``token``, or ``username`` and ``password``."""
    env = dict(os.environ) if env is None else env
    out: dict[str, str] = {}
    if provider == "bitbucket":
        if env.get("BITBUCKET_USERNAME") and env.get("BITBUCKET_APP_PASSWORD"):
            out = {"username": env["BITBUCKET_USERNAME"], "password": env["BITBUCKET_APP_PASSWORD"]}
    else:
        token = next((env[n] for n in TOKENS.get(provider, ()) if env.get(n)), None)
        if token:
            out = {"token": token}
    return {**out, **{k: v for k, v in (given or {}).items() if v}}


def plausible_token(provider: str, token: str) -> bool:
    """Whether a token has the form the provider's tokens have."""
    rx = {"github": r"(gh[pousr]_\w{30,}|github_pat_\w+|[0-9a-f]{40})", "gitlab": r"(glpat-[\w-]{20,}|[\w-]{20,})"}.get(provider, r"\S{8,}")
    return bool(re.fullmatch(rx, token))


def authenticated_url(address: Address, cred: dict[str, str]) -> str:
    user = {"github": "x-access-token", "gitlab": "oauth2"}.get(address.provider, "x-token-auth")
    if cred.get("token"):
        return f"https://{user}:{quote(cred['token'], safe='')}@{address.host}/{address.owner}/{address.repo}.git"
    if cred.get("username") and cred.get("password"):
        return f"https://{quote(cred['username'], safe='')}:{quote(cred['password'], safe='')}@{address.host}/{address.owner}/{address.repo}.git"
    return address.url()


@dataclass
class Entry:
    url: str
    branch: str | None
    path: str
    commit: str | None
    size: int
    updated: float


class Cache:
    """Clones by key in one folder; entries expire after ``ttl`` seconds."""

    def __init__(self, folder: str, ttl: float = TTL_SECONDS) -> None:
        self.folder, self.ttl = Path(folder), ttl
        self.folder.mkdir(parents=True, exist_ok=True)
        self.index = self.folder / "index.json"

    def _load(self) -> dict[str, Entry]:
        try:
            return {k: Entry(**v) for k, v in json.loads(self.index.read_text()).items()}
        except (OSError, ValueError, TypeError):
            return {}

    def _save(self, entries: dict[str, Entry]) -> None:
        part = self.index.with_suffix(".part")
        part.write_text(json.dumps({k: asdict(v) for k, v in entries.items()}))
        part.replace(self.index)

    def get(self, address: Address, branch: str | None = None, now: float | None = None) -> Entry | None:
        e = self._load().get(address.cache_key(branch))
        fresh = e is not None and (time.time() if now is None else now) - e.updated <= self.ttl
        return e if fresh and e is not None and os.path.isdir(e.path) else None

    def add(self, address: Address, path: str, branch: str | None = None, commit: str | None = None, now: float | None = None) -> Entry:
        size = sum(p.stat().st_size for p in Path(path).rglob("*") if p.is_file())
        e = Entry(address.url(), branch, path, commit, size, time.time() if now is None else now)
        self._save({**self._load(), address.cache_key(branch): e})
        return e

    def remove(self, address: Address, branch: str | None = None) -> bool:
        entries = self._load()
        e = entries.pop(address.cache_key(branch), None)
        if e is not None:
            shutil.rmtree(e.path, ignore_errors=True)
            self._save(entries)
        return e is not None

    def clear(self) -> int:
        entries = self._load()
        for e in entries.values():
            shutil.rmtree(e.path, ignore_errors=True)
        self._save({})
        return len(entries)

    def expire(self, now: float | None = None) -> int:
        at, entries = time.time() if now is None else now, self._load()
        old = [k for k, e in entries.items() if at - e.updated > self.ttl]
        for k in old:
            shutil.rmtree(entries.pop(k).path, ignore_errors=True)
        self._save(entries)
        return len(old)

    def stats(self) -> dict[str, object]:
        e = self._load().values()
        return {"entries": len(e), "size": sum(x.size for x in e), "oldest": min((x.updated for x in e), default=None), "newest": max((x.updated for x in e), default=None)}


def _git(args: list[str], timeout: int) -> str:
    try:
        done = subprocess.run(["git", *args], capture_output=True, text=True, timeout=timeout, env={**os.environ, "GIT_TERMINAL_PROMPT": "0"})
    except (OSError, subprocess.TimeoutExpired) as e:
        raise GitError(type(e).__name__) from None
    if done.returncode:
        raise GitError(re.sub(r"//[^@/\s]*@", "//", done.stderr.strip())[-500:])
    return done.stdout


def validate(url: str, cred: dict[str, str] | None = None, timeout: int = 60) -> dict[str, object]:
    """Whether a repository can be reached, and its branches."""
    a = parse(url)
    try:
        out = _git(["ls-remote", "--heads", authenticated_url(a, credentials(a.provider, cred))], timeout)
    except GitError as e:
        return {"valid": False, "error": str(e), "branches": []}
    return {"valid": True, "error": None, "branches": [line.split("refs/heads/")[1] for line in out.splitlines() if "refs/heads/" in line]}


def clone(url: str, branch: str | None = None, cache: Cache | None = None, cred: dict[str, str] | None = None, progress: Callable[[int, str], None] = lambda percent, what: None, source: str | None = None, timeout: int = 600) -> str:
    """The folder of a shallow clone, from the cache if it's fresh. ``source`` replaces the address that is cloned (mirrors, tests)."""
    a = parse(url)
    progress(10, "cache")
    if cache is not None and (e := cache.get(a, branch)):
        progress(100, "cached")
        return e.path
    folder = tempfile.mkdtemp(prefix="clone-", dir=str(cache.folder) if cache else None)
    progress(30, "clone")
    try:
        _git(["clone", "--depth", "1", *(["--branch", branch] if branch else []), source or authenticated_url(a, credentials(a.provider, cred)), folder], timeout)
        commit = _git(["-C", folder, "rev-parse", "HEAD"], 60).strip()
    except GitError:
        shutil.rmtree(folder, ignore_errors=True)
        raise
    progress(95, "store")
    if cache is not None:
        cache.add(a, folder, branch, commit)
    progress(100, "done")
    return folder
