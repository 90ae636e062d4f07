"""Index configuration of one business (tenant)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

FORMATS = ("JSON", "TAB", "KV")


@dataclass(frozen=True)
class Step:
    """One tokenizer of a chain, with its parameter."""

    name: str
    param: str | None = None


@dataclass(frozen=True)
class IndexConfig:
    business: str
    data_format: str = "TAB"
    field_names: tuple[str, ...] = ()
    tokenizers: dict[str, tuple[Step, ...]] = field(default_factory=dict)
    alias: dict[str, str] = field(default_factory=dict)
    token_filters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    lines_per_doc: int = 128
    shard_width: int = 200
    files_per_field: int = 1000
    posting_cap: int = 1_000_000
    longest_line: int = 10 * 1024 * 1024

    def __post_init__(self) -> None:
        if not self.business:
            raise ValueError("business is required")
        if self.lines_per_doc < 1 or self.shard_width < 1 or self.files_per_field < 1 or self.posting_cap < 1:
            raise ValueError("sizes are at least 1")
        if self.format == "TAB":
            unknown = [f for f in self.tokenizers if f not in self.field_names]
            if unknown:
                raise ValueError(f"not in field_names: {unknown}")

    @property
    def format(self) -> str:
        """Any unknown format is read as TAB."""
        return self.data_format if self.data_format in FORMATS else "TAB"

    def output_field(self, name: str) -> str:
        return self.alias.get(name, name)

    @classmethod
    def from_json(cls, text: str, macros: dict[str, str] | None = None, filters: dict[str, list[str]] | None = None) -> IndexConfig:
        """Reads the JSON form; trailing commas are allowed, ``{name}`` of macros replaced once.

        filters: the tokens of each token filter file, by the name that a tokenfilter step gives."""
        for name, value in (macros or {}).items():
            text = text.replace("{" + name + "}", value, 1)
        found = json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
        common, index = found.get("common", {}), found.get("inverted_index", {})
        optional = {
            "lines_per_doc": common.get("line_per_doc"),
            "shard_width": common.get("indexgzmeta_section"),
            "files_per_field": common.get("indexgz_file_num_per_field"),
            "posting_cap": index.get("save_line_count_per_map"),
        }
        return cls(
            business=common.get("bussiness") or common.get("business") or "",
            data_format=index.get("data_format", "TAB"),
            field_names=tuple(index.get("field_names", ())),
            tokenizers={k: steps(v) for k, v in index.get("tokenizer", {}).items()},
            alias=dict(index.get("alias", {})),
            token_filters={f: tuple(t for x in names for t in (filters or {}).get(x, ())) for f, names in filter_files(index.get("tokenizer", {})).items()},
            **{k: int(v) for k, v in optional.items() if v},
        )


def filter_files(chains: dict[str, Any]) -> dict[str, list[str]]:
    """The files that each field's tokenfilter steps name."""
    found = {f: [s.param for s in steps(c) if s.name == "tokenfilter" and s.param] for f, c in chains.items()}
    return {f: x for f, x in found.items() if x}


def steps(chain: Any) -> tuple[Step, ...]:
    """A chain as configured: a name, or a list of names and {name: parameter}."""
    out = []
    for item in [chain] if isinstance(chain, (str, dict)) else chain:
        out += [Step(item)] if isinstance(item, str) else [Step(k, v) for k, v in item.items()]
    return tuple(out)
