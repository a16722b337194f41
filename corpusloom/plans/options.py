"""Options of structural chunking."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column

log = logging.getLogger("corpusloom")


@dataclass(frozen=True)
class ChunkOptions:
    """``verb`` decides which lines count as sentences; without it chunk types don't look for verbs."""

    target_level: int = 3
    max_chunk_size: int = 1000
    chunk_overlap: int = 200
    max_name_paragraphs: int = 5
    include_section_content: bool = True
    save_text: bool = False
    save_toc: bool = False
    save_table_json: bool = False
    verb: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        if self.max_chunk_size < 1 or not 0 <= self.chunk_overlap <= self.max_chunk_size:
            raise ValueError("0 <= chunk_overlap <= max_chunk_size, and max_chunk_size at least 1")

    @staticmethod
    def load(path: str | None = None, **given) -> ChunkOptions:
        """Options of a JSON file and arguments; an unreadable file is a warning.

        The file decides on table names and output only: level, size and overlap are the arguments' or the defaults, whatever it says.
        """
        found = {}
        if path:
            try:
                raw = json.loads(Path(path).read_text(encoding="utf-8"))
                found = {name: raw[part][key] for name, (part, key) in _IN_FILE.items() if isinstance(raw.get(part), dict) and key in raw[part]}
            except (OSError, ValueError, AttributeError) as why:
                log.warning("options of %s not read: %s", path, why)
        return replace(ChunkOptions(), **(found | given))


#: Where a file of options has what it decides on.
_IN_FILE = {
    "max_name_paragraphs": ("table_processing", "max_table_name_paragraphs"),
    "include_section_content": ("output", "include_section_content"),
    "save_text": ("output", "save_docx2python_text"),
    "save_toc": ("output", "save_toc_text"),
    "save_table_json": ("output", "save_table_json"),
}


def set_log_level(level: str | None = None, configured: str | None = None) -> str:
    """The level given, else that of the environment, else the configured one, else INFO."""
    chosen = (level or os.environ.get("CORPUSLOOM_LOG_LEVEL") or configured or "INFO").upper()
    log.setLevel(chosen)
    return chosen
