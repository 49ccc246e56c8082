"""Verdicts of an outside PDF/A validator, read from the JSON it prints."""

from __future__ import annotations

import json
import shutil
import subprocess

_REFUSED = "the validator reported a non-compliant file"


def verdict(output: str) -> tuple[bool, str | None]:
    """(compliant, reason) from a report in any of its layouts: jobs under ``report`` with lists of results, a list of
    ``validationReports``, or ``jobs`` with one report each. Every result must be compliant and there must be one."""
    try:
        payload = json.loads(output)
    except ValueError as e:
        return False, str(e)
    if not isinstance(payload, dict):
        return False, "unreadable validation result"
    dicts = lambda x: [i for i in x if isinstance(i, dict)] if isinstance(x, list) else []
    report = payload.get("report")
    if isinstance(report, dict) and isinstance(report.get("jobs"), list):
        marks = [r.get("compliant", False) for j in dicts(report["jobs"]) for r in dicts(j.get("validationResult"))]
    elif isinstance(payload.get("validationReports"), list):
        listed = payload["validationReports"]
        if not listed:
            return False, "the validator had no profile to test"
        marks = [isinstance(r, dict) and r.get("isCompliant", False) for r in listed]
    elif isinstance(payload.get("jobs"), list):
        marks = [j["validationReport"].get("isCompliant", False) for j in dicts(payload["jobs"]) if isinstance(j.get("validationReport"), dict)]
    else:
        return False, "unreadable validation result"
    return (True, None) if marks and all(marks) else (False, _REFUSED)


def validate(path: str, command: str | None) -> tuple[bool, str | None]:
    """Runs ``command --format json PATH``; without the tool nothing is compliant, and the reason says so."""
    tool = shutil.which(command) if command else None
    if not tool:
        return False, "no validator installed"
    try:
        done = subprocess.run([tool, "--format", "json", path], check=False, capture_output=True, text=True)
    except OSError as e:
        return False, str(e)
    if done.returncode not in (0, 1):
        return False, (done.stderr or done.stdout).strip() or f"the validator ended with status {done.returncode}"
    return verdict(done.stdout)
