"""The extraction step as a pluggable function of a document, run in the tasks that hold it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed nested shape of one result.
ITEM = "struct<page_start:int,page_end:int,summary:string,people:array<string>,places:array<string>,dates:array<string>>"
RESULT = f"document_sha256 string, status string, failure_type string, error_text string, responsive boolean, relevance_score int, summary string, people array<string>, places array<string>, dates array<string>, evidence array<{ITEM}>, prompt_tokens long, candidate_tokens long"


class Extractor(Protocol):
    """Answers a question about a document's pages; whatever it raises becomes a failed row."""

    def analyse(self, question: str, filename: str, pages: list[str]) -> dict: ...


class KeywordExtractor:
    """A deterministic extractor without any model: pages sharing a longer word with the question are evidence; names,
    places and dates are capitalised runs and date forms on them. It stands in for a remote model in tests and offline runs."""

    _NAME = re.compile(r"\b[A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-z]+\b")
    _DATE = re.compile(r"\b(?:\d{1,2} )?(?:January|February|March|April|May|June|July|August|September|October|November|December)(?: \d{1,2},)? \d{4}\b|\b(?:18|19|20)\d{2}\b")
    _PLACE = re.compile(r"\b(?:at|in|near) ([A-Z][a-z]+(?: [A-Z][a-z]+)?)")

    def analyse(self, question: str, filename: str, pages: list[str]) -> dict:
        words = {w for w in re.findall(r"[a-z]{4,}", question.lower())}
        items = []
        for number, page in enumerate(pages, 1):
            if words & set(re.findall(r"[a-z]{4,}", page.lower())):
                items.append({"page_start": number, "page_end": number, "summary": " ".join(page.split()), "people": list(dict.fromkeys(self._NAME.findall(page))), "places": list(dict.fromkeys(self._PLACE.findall(page))), "dates": list(dict.fromkeys(self._DATE.findall(page)))})
        merged = {k: list(dict.fromkeys(x for i in items for x in i[k])) for k in ("people", "places", "dates")}
        return {"responsive": bool(items), "relevance_score": min(10, 1 + len(items)), "summary": items[0]["summary"] if items else "", "evidence": items, "prompt_tokens": sum(len(p) for p in pages) // 4, "candidate_tokens": sum(len(i["summary"]) for i in items) // 4, **merged}


def analyse_documents(documents: DataFrame, question: str, extractor: Extractor) -> DataFrame:
    """One result row for each document (document_sha256, filename, pages array<string>), failures included: no pages is
    'preparation_failed', an exception 'analysis_failed' with its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = {"responsive": None, "relevance_score": None, "summary": None, "people": [], "places": [], "dates": [], "evidence": [], "prompt_tokens": 0, "candidate_tokens": 0}
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                base = {"document_sha256": r.document_sha256, "status": "failed", "failure_type": None, "error_text": None, **empty}
                pages = [p for p in r.pages] if r.pages is not None else []
                if not pages:
                    rows.append(base | {"failure_type": "preparation_failed", "error_text": "no pages"})
                    continue
                try:
                    rows.append(base | extractor.analyse(question, r.filename, [p or "" for p in pages]) | {"status": "succeeded"})
                except Exception as e:  # one document's failure is a row, not the run's end
                    rows.append(base | {"failure_type": "analysis_failed", "error_text": str(e)})
            yield pd.DataFrame(rows).astype({"relevance_score": "Int32", "responsive": object})

    return documents.select("document_sha256", "filename", "pages").mapInPandas(run, RESULT)


def document_prompt(question: str, filename: str, chunks: list[str]) -> str:
    """The request sent with a document; chunks are named only if there are several."""
    lines = [f"Question: {question}", f"Document: {filename}"]
    if len(chunks) > 1:
        lines += [f"Part {i} of {len(chunks)}: {c}" for i, c in enumerate(chunks, 1)]
    return "\n".join(lines)


def synthesis_prompt(question: str, total: int, successful: int, responsive: list[dict]) -> dict:
    """The request for a project's answer: the question, how much was read, and the responsive documents with their findings."""
    return {"question": question, "total_documents": total, "successful_documents": successful, "responsive_documents": responsive}


def fingerprint(payload: object, length: int = 12) -> str:
    """Short digest of a value's canonical JSON (sorted keys, no spaces, ASCII)."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()[:length]


# How a stored version names what it was made with.
TAGS = {"prompt": "pf", "schema": "sf", "synthesis_prompt": "spf", "synthesis_schema": "ssf"}


@dataclass(frozen=True)
class Asked:
    """What makes up a question's identity: each version with the parts it stands for."""

    prompt: tuple[str, dict[str, object]]
    schema: tuple[str, dict[str, object]]
    synthesis_prompt: tuple[str, dict[str, object]]

    def versions(self) -> dict[str, str]:
        """Versions with the fingerprints of their parts: a changed part is a different question."""
        stated = {f.name: getattr(self, f.name) for f in fields(self)}
        return {f"{name}_version": "+".join((version, *(f"{TAGS[part]}:{fingerprint(value)}" for part, value in parts.items()))) for name, (version, parts) in stated.items()}


def query_identity(prompt_version: str, schema_version: str, synthesis_version: str, prompt: object, schema: object, synthesis_prompt: object, synthesis_schema: object) -> dict[str, str]:
    """The versions of a question as stored with it."""
    return Asked((prompt_version, {"prompt": prompt}), (schema_version, {"schema": schema}), (synthesis_version, {"synthesis_prompt": synthesis_prompt, "synthesis_schema": synthesis_schema})).versions()


def synthesize(question: str, findings: list[dict], successes: int, write) -> dict:
    """A project's answer from its findings: skipped without successes, fixed without findings, else ``write``'s."""
    if not successes:
        return {"status": "skipped", "answer": "", "key_findings": []}
    if not findings:
        return {"status": "succeeded", "answer": "No responsive documents were found.", "key_findings": []}
    return {"status": "succeeded", **write(question, findings)}
