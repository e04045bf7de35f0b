"""Acquisition, with git and name service replaced."""

import os
import subprocess
from types import SimpleNamespace

import pytest

from lodestone import errors
from lodestone.sources import clone as c


@pytest.fixture
def address(monkeypatch):
    def at(ip):
        monkeypatch.setattr(c.socket, "gethostbyname", lambda _: ip)

    at("140.82.114.4")
    return at


@pytest.fixture
def folder(monkeypatch, tmp_path):
    place = tmp_path / "clone"
    place.mkdir()
    monkeypatch.setattr(c.tempfile, "mkdtemp", lambda **_: str(place))
    return place


def git(monkeypatch, head=0, error=None, size=10):
    def run(command, **_):
        if command[1] == "clone":
            if error:
                raise error
            with open(os.path.join(command[-1], "f"), "wb") as f:
                f.write(b"x" * size)
            return SimpleNamespace(returncode=0, stdout="", stderr="")
        return SimpleNamespace(returncode=head, stdout="abc\n", stderr="")

    monkeypatch.setattr(c.subprocess, "run", run)


@pytest.mark.parametrize("url", ["ftp://github.com/a", "http://github.com/a", "https://bitbucket.org/a", "file:///etc", "git@evil.org:a/b"])
def test_urls_that_are_not_allowed(address, url):
    with pytest.raises(errors.InvalidRepositoryURLError):
        c.check_url(url)


@pytest.mark.parametrize("ip", ["192.168.1.1", "127.0.0.1", "169.254.1.1", "240.0.0.1", "10.0.0.1"])
def test_addresses_that_are_not_public(address, ip):
    address(ip)
    with pytest.raises(errors.InvalidRepositoryURLError):
        c.check_url("https://github.com/a/b")


def test_urls_and_refs_that_are_allowed(address):
    c.check_url("https://github.com/a/b")
    c.check_url("git@gitlab.com:a/b.git")
    c.check_ref("feature/new-feature_1.0")


@pytest.mark.parametrize("ref", ["-x", "a;rm -rf /", "", "a" * 256, "a\n"])
def test_refs_that_are_not_allowed(ref):
    with pytest.raises(errors.InvalidRefError):
        c.check_ref(ref)


def test_a_clone_is_gone_after_its_block(monkeypatch, address, folder):
    git(monkeypatch)
    with pytest.raises(KeyError), c.clone("https://github.com/a/b", "main") as repo:
        assert (repo.commit_sha, repo.size_bytes, repo.local_path) == ("abc", 10, str(folder))
        raise KeyError
    assert not folder.exists()


@pytest.mark.parametrize(
    ("options", "limits", "expected"),
    [
        ({"error": subprocess.TimeoutExpired("git", 1)}, {}, errors.CloneTimeoutError),
        ({"error": subprocess.CalledProcessError(1, "git", stderr="no")}, {}, errors.RepositoryError),
        ({"size": 2_000_000}, {"max_mb": 1}, errors.RepositoryTooLargeError),
        ({"head": 128}, {}, errors.EmptyRepositoryError),
    ],
)
def test_failures_have_types_and_leave_nothing(monkeypatch, address, folder, options, limits, expected):
    git(monkeypatch, **options)
    with pytest.raises(expected), c.clone("https://github.com/a/b", **limits):
        pass
    assert not folder.exists()
