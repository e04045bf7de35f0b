"""Acquiring a repository: a driver-side connector, checked before anything is run."""

from __future__ import annotations

import ipaddress
import os
import re
import shutil
import socket
import subprocess
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import urlsplit

from .. import settings
from ..errors import CloneTimeoutError, EmptyRepositoryError, InvalidRefError, InvalidRepositoryURLError, RepositoryError, RepositoryTooLargeError

_REF = re.compile(rf"[a-zA-Z0-9][a-zA-Z0-9._/\-]{{0,{settings.MAX_REF_LENGTH}}}")


@dataclass(frozen=True)
class ClonedRepo:
    local_path: str
    commit_sha: str
    repo_url: str
    size_bytes: int


def host_of(url: str) -> str:
    """Host of an https URL or of git@host:path."""
    if urlsplit(url).scheme == "https":
        return urlsplit(url).hostname or ""
    if url.startswith("git@"):
        return url[4:].split(":", 1)[0]
    raise InvalidRepositoryURLError(f"neither https nor git@: {url!r}")


def check_url(url: str, hosts: tuple[str, ...] = settings.ALLOWED_REPOSITORY_HOSTS) -> None:
    """The host must be allowed and its address a public one."""
    if (host := host_of(url)) not in hosts:
        raise InvalidRepositoryURLError(f"host {host!r} is not among {list(hosts)}")
    try:
        address = ipaddress.ip_address(socket.gethostbyname(host))
    except socket.gaierror as error:
        raise InvalidRepositoryURLError(f"host {host!r} has no address: {error}") from error
    if address.is_private or address.is_loopback or address.is_reserved or address.is_link_local:
        raise InvalidRepositoryURLError(f"host {host!r} has the blocked address {address}")


def check_ref(ref: str) -> None:
    if not _REF.fullmatch(ref):  # a leading dash would be an option of git
        raise InvalidRefError(f"not allowed as a ref: {ref!r}")


def size_of(path: str) -> int:
    """Bytes of all regular files, git's own included."""
    files = (os.path.join(folder, name) for folder, _, names in os.walk(path) for name in names)
    return sum(os.path.getsize(f) for f in files if os.path.isfile(f) and not os.path.islink(f))


@contextmanager
def clone(url: str, ref: str | None = None, hosts: tuple[str, ...] = settings.ALLOWED_REPOSITORY_HOSTS, max_mb: float = settings.MAX_REPO_SIZE_MB, timeout: int = settings.CLONE_TIMEOUT_SECONDS, below: str | None = None) -> Iterator[ClonedRepo]:
    """A shallow clone in a folder of its own, which is gone after the block, however it ends.

    On a cluster ``below`` names a mounted folder that the driver and all executors share; without it the folder is this machine's.
    """
    check_url(url, hosts)
    if ref is not None:
        check_ref(ref)
    folder = tempfile.mkdtemp(prefix="repo-", dir=below)
    try:
        check_url(url, hosts)  # the name may have got another address meanwhile
        branch = [f"--branch={ref}"] if ref else []
        try:
            subprocess.run(["git", "clone", *settings.GIT_CLONE_FLAGS, *branch, "--", url, folder], check=True, capture_output=True, text=True, timeout=timeout)
        except subprocess.TimeoutExpired as error:
            raise CloneTimeoutError(f"{url!r} took longer than {timeout} s") from error
        except subprocess.CalledProcessError as error:
            raise RepositoryError(f"cloning {url!r} failed: {(error.stderr or '')[: settings.ERROR_CHARS]}") from error
        size = size_of(folder)
        if size > max_mb * settings.BYTES_PER_MB:
            raise RepositoryTooLargeError(f"{size} bytes are more than {max_mb} MB")
        head = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
        if head.returncode:
            raise EmptyRepositoryError(f"{url!r} has no commit")
        yield ClonedRepo(folder, head.stdout.strip(), url, size)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
