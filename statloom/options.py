"""Options of scans, checked when they are made."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from pathlib import PurePosixPath

FORMATS = {"sas7bdat": "sas7bdat", "sas7bcat": "sas7bdat", "xpt": "xpt", "xport": "xpt", "dta": "dta", "sav": "sav", "zsav": "sav", "por": "por"}
READABLE = (".sas7bdat", ".sas7bcat", ".xpt", ".xport", ".dta", ".sav", ".zsav", ".por")


def format_of(path: str) -> str:
    """The format that a path's extension names; ValueError for others."""
    suffix = PurePosixPath(str(path)).suffix
    if suffix not in READABLE:
        raise ValueError(f"can't tell the format of {path!r}; known extensions: {', '.join(READABLE)}")
    return FORMATS[suffix[1:]]


def _choice(what: str, value, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{what}: {value!r} is unknown; choose from {', '.join(allowed)}")


@dataclass(frozen=True)
class InformativeNulls:
    """Keep user-defined missing codes: which columns, in which shape."""

    columns: str | tuple[str, ...] = "all"
    mode: str = "separate_column"
    suffix: str = "_null"
    use_value_labels: bool = True

    def __post_init__(self):
        _choice("informative_nulls mode", self.mode, ("separate_column", "struct", "merged_string"))
        if isinstance(self.columns, str):
            if self.columns != "all":
                raise ValueError('columns of informative_nulls: give names in a list, or "all"')
        else:
            object.__setattr__(self, "columns", tuple(self.columns))
        if self.mode == "separate_column" and not self.suffix:
            raise ValueError("informative_nulls suffix must not be empty")


@dataclass(frozen=True)
class Compress:
    """Narrow column types to what the values need, each kind of narrowing where it is asked for; ``True`` asks for all."""

    enabled: bool = False
    cols: tuple[str, ...] | None = None
    compress_numeric: bool = False
    datetime_to_date: bool = False
    string_to_numeric: bool = False
    infer_compress_length: int | None = None

    def __post_init__(self):
        if self.cols is not None:
            object.__setattr__(self, "cols", tuple(self.cols))
        if self.infer_compress_length is not None and self.infer_compress_length < 1:
            raise ValueError("infer_compress_length must be at least 1")


@dataclass(frozen=True)
class PreserveOrder:
    """Whether and how rows keep the file's order."""

    mode: str = "buffered"
    row_index_name: str = "row_index"

    def __post_init__(self):
        _choice("preserve_order mode", self.mode, ("buffered", "row_index", "sort"))
        if not isinstance(self.row_index_name, str) or not self.row_index_name:
            raise ValueError("row_index_name must be a non-empty string")


def _built(kind: type, value, on=None):
    """``value`` as an instance of ``kind``: an instance, a dict of its fields, a flag, or None."""
    if value is None or value is False:
        return None
    if isinstance(value, kind):
        return value
    if value is True:
        return on
    if isinstance(value, dict):
        if unknown := set(value) - {f.name for f in fields(kind)}:
            raise ValueError(f"unknown {kind.__name__} options: {', '.join(sorted(unknown))}")
        return kind(**value)
    raise TypeError(f"{kind.__name__} options must be a dict, a flag or {kind.__name__}, not {type(value).__name__}")


def informative_nulls(value) -> InformativeNulls | None:
    return _built(InformativeNulls, value, InformativeNulls())


def compress(value) -> Compress | None:
    made = _built(Compress, value, Compress(enabled=True, compress_numeric=True, datetime_to_date=True, string_to_numeric=True))
    return made if made and made.enabled else None


def preserve_order(value) -> PreserveOrder | None:
    return PreserveOrder(value) if isinstance(value, str) else _built(PreserveOrder, value, PreserveOrder())
