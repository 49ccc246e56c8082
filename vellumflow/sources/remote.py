"""A remote extraction service as a seam: its key, its files, and waiting until one can be read."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

#: Seconds between two looks at a file that is being processed.
POLL_SECONDS = 2.0


@dataclass(frozen=True)
class RemoteFile:
    name: str | None
    state: str | None  # PROCESSING, ACTIVE, FAILED, or nothing


class Service(Protocol):
    """What a service has to offer; ``answer`` returns the result of one request about uploaded files."""

    def upload(self, path: str, display_name: str) -> RemoteFile: ...

    def look(self, name: str) -> RemoteFile: ...

    def answer(self, request: dict, files: list[RemoteFile]) -> dict: ...


def required_key(variable: str) -> str:
    """The key in an environment variable; without it nothing remote can be done."""
    key = os.environ.get(variable)
    if not key:
        raise SystemExit(f"{variable} is not set")
    return key


def wait_until_ready(service: Service, file: RemoteFile, sleep: Callable[[float], None] = time.sleep) -> RemoteFile:
    """``file`` once it is no longer processed; an error if that failed, or if it can't be asked for again."""
    while file.state == "PROCESSING":
        if file.name is None:
            raise RuntimeError("a file without a name can't be waited for")
        sleep(POLL_SECONDS)
        file = service.look(file.name)
    if file.state == "FAILED":
        raise RuntimeError(f"processing of {file.name} failed")
    return file


class RemoteExtractor:
    """An extractor that sends a document's pages as one request to a service."""

    def __init__(self, service: Service, model: str):
        self.service, self.model = service, model

    def analyse(self, question: str, filename: str, pages: list[str]) -> dict:
        from vellumflow.sources.extract import document_prompt

        return self.service.answer({"model": self.model, "prompt": document_prompt(question, filename, []), "pages": pages}, [])
