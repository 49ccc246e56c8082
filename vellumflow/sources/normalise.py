"""Files brought into the form a policy asks for: flattened, freed of what acts or reaches outside, converted, checked again.

Flattening and conversion are outside tools named by the caller; without them those steps are left out, and what remains
to be objected to is said.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from dataclasses import dataclass
from pathlib import Path

from vellumflow.sources.pdf import Pdf, issue_names, policy_flags, sanitise
from vellumflow.sources.validation import validate


@dataclass(frozen=True)
class Normaliser:
    """``flattener`` is run as TOOL --dpi N IN OUT, ``converter`` as TOOL IN OUT, ``validator`` as :func:`validate` runs it."""

    flattener: str | None = None
    converter: str | None = None
    validator: str | None = None
    dpi: int = 300

    def issues(self, path: Path) -> list[str]:
        """What is objected to; conformity is taken from the validator alone."""
        flags = policy_flags(path.read_bytes())
        if self.validator and not flags["encrypted"]:
            flags["not_pdfa"] = not validate(str(path), self.validator)[0]
        return issue_names(flags)

    def __call__(self, path: str | Path, flatten: bool = False) -> list[str]:
        """Normalises a file in place, by a new file that replaces it once it is whole; what is still objected to."""
        path = Path(path)
        before = self.issues(path)
        if "encrypted" in before:
            return before
        with tempfile.TemporaryDirectory(dir=path.parent) as folder:
            work = Path(folder, "work.pdf")
            shutil.copyfile(path, work)
            if flatten:
                self._run(self.flattener, ["--dpi", str(self.dpi)], work)
            if set(self.issues(work)) - {"not_pdfa"}:
                work.write_bytes(sanitise(work.read_bytes()))
            if "not_pdfa" in self.issues(work):
                self._run(self.converter, [], work)
            Pdf(work.read_bytes()).pages()
            work.replace(path)
        return self.issues(path)

    @staticmethod
    def _run(command: str | None, options: list[str], work: Path) -> None:
        tool = shutil.which(command) if command else None
        if not tool:
            return
        out = work.with_name("out.pdf")
        subprocess.run([tool, *options, str(work), str(out)], check=True, capture_output=True)
        out.replace(work)
