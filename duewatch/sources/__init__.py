from .files import (
    read_complaints,
    read_scored_file,
    source_row_count,
    split_text,
    write_table,
)
from .workspace import Workspace

__all__ = [
    "Workspace", "read_complaints", "read_scored_file", "source_row_count", "split_text", "write_table",
]
