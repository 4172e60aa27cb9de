"""Clone a repository to scan it. Runs on the driver, once, before any Spark job."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from loomgraph.functions.paths import REPO_PREFIXES


def folder_name(url: str) -> str:
    return re.sub(r"(\.git)+$", "", url.rstrip("/")).rsplit("/", 1)[-1]


def clone(url: str, into: str | Path) -> Path:
    """Shallow clone of ``url`` in a folder of ``into``; an existing folder is used as it is."""
    if not url.startswith(REPO_PREFIXES):
        raise ValueError("only GitHub and GitLab addresses are supported")
    target = Path(into) / folder_name(url)
    if not target.exists():
        done = subprocess.run(["git", "clone", "--depth", "1", "--", url, str(target)], capture_output=True, text=True)
        if done.returncode:
            raise RuntimeError(f"git clone failed: {done.stderr.strip()}")
    return target
