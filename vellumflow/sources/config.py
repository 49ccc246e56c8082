"""Project configuration: a YAML mapping, checked, with paths relative to its file."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

#: Ways to make an oversized document fit, and ways to link names.
STRATEGIES = ("auto", "chunk", "qpdf", "ebook", "none")
METHODS = ("local", "external")


@dataclass
class ProjectConfig:
    name: str
    pdf_directory: str
    output_directory: str
    question: str
    model: str | None = None
    workers: int | None = None
    oversize_strategy: str | None = None
    report_html_filename: str = "report.html"
    ignore_dirs_containing: list[str] = field(default_factory=lambda: [".pdfdata"])
    name_clustering: str = "local"
    flatten_pdf: bool = False
    flatten_dpi: int = 300

    def __post_init__(self) -> None:
        for key in ("pdf_directory", "output_directory"):
            value = getattr(self, key)
            if not isinstance(value, str) or not value or value != value.strip():
                raise ValueError(f"{key} must be a path without outer white space")
        for key in ("name", "question"):
            if not isinstance(getattr(self, key), str) or not getattr(self, key).strip():
                raise ValueError(f"{key} is required")
        if self.ignore_dirs_containing is None:
            self.ignore_dirs_containing = [".pdfdata"]
        elif isinstance(self.ignore_dirs_containing, str):
            self.ignore_dirs_containing = [self.ignore_dirs_containing]
        if Path(self.report_html_filename).name != self.report_html_filename or not self.report_html_filename.lower().endswith((".html", ".htm")):
            raise ValueError("report_html_filename must be the name of an HTML file, not a path")
        if self.name_clustering not in METHODS:
            raise ValueError(f"name_clustering must be one of {METHODS}")
        if self.oversize_strategy is not None and self.oversize_strategy not in STRATEGIES:
            raise ValueError(f"oversize_strategy must be one of {STRATEGIES}")
        if not isinstance(self.flatten_dpi, int) or self.flatten_dpi <= 0:
            raise ValueError("flatten_dpi must be positive")
        if self.workers is not None and self.workers < 1:
            raise ValueError("workers must be positive")

    @classmethod
    def from_mapping(cls, payload: dict, base: Path) -> ProjectConfig:
        values = dict(payload)
        if "root_directory" in values:
            values.setdefault("pdf_directory", values.pop("root_directory"))
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        missing = {"name", "pdf_directory", "output_directory", "question"} - set(values)
        if missing:
            raise ValueError(f"missing settings: {', '.join(sorted(missing))}")
        config = cls(**values)
        for key in ("pdf_directory", "output_directory"):
            setattr(config, key, str((base / getattr(config, key)).resolve()))
        return config

    @classmethod
    def from_path(cls, path: str | Path) -> ProjectConfig:
        """The configuration in a YAML file; its output directory is made, its input directory must be there."""
        import yaml

        payload = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        if not isinstance(payload, dict):
            raise ValueError("a configuration is a mapping")
        config = cls.from_mapping(payload, Path(path).resolve().parent)
        if not Path(config.pdf_directory).is_dir():
            raise ValueError(f"no directory {config.pdf_directory}")
        Path(config.output_directory).mkdir(parents=True, exist_ok=True)
        return config
