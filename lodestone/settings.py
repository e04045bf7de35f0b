"""Limits and defaults."""

from __future__ import annotations

import os

MAX_REPO_SIZE_MB = int(os.getenv("MAX_REPO_SIZE_MB", "500"))
CLONE_TIMEOUT_SECONDS = int(os.getenv("CLONE_TIMEOUT", "300"))
ALLOWED_REPOSITORY_HOSTS = tuple(os.getenv("ALLOWED_REPOSITORY_HOSTS", "github.com,gitlab.com").split(","))
MAX_REF_LENGTH = 254
CHUNK_ID_LENGTH = 16
BYTES_PER_MB = 1024 * 1024
MAX_FILE_SIZE_MB = 5
#: Bytes above which a file gets an overview of its own.
FILE_SKELETON_THRESHOLD = 200
#: Bytes up to which a definition is one chunk.
DEFINITION_BUDGET = 4000
# Directories that hold no sources.
SKIP_DIRS = frozenset(".git node_modules __pycache__ .venv venv dist build .pytest_cache .mypy_cache target .idea .vscode".split())
#: No tags, one commit, and no hooks of the cloned repository.
GIT_CLONE_FLAGS = ("--depth=1", "--no-tags", "--config", "core.hooksPath=/dev/null")
ERROR_CHARS = 300
