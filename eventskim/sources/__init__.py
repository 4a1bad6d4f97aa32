"""Reading and writing groups."""

from .arrays_format import register_arrays, scan_arrays
from .colgroup import read_colgroup, sum_arrays
from .folders import folder_columns, read_folder
from .groups import (
    bind_group,
    copy_format,
    merge_groups,
    merge_sample,
    merge_sample_again,
    read_columns,
    read_dynamic,
    read_group,
    read_merged,
    stored_groups,
    sum_groups,
    write_group,
    write_histogram,
)
from .paired import read_paired

__all__ = [
    "bind_group",
    "copy_format",
    "folder_columns",
    "merge_groups",
    "merge_sample",
    "merge_sample_again",
    "read_colgroup",
    "read_columns",
    "read_dynamic",
    "read_folder",
    "read_group",
    "read_merged",
    "read_paired",
    "register_arrays",
    "scan_arrays",
    "stored_groups",
    "sum_arrays",
    "sum_groups",
    "write_group",
    "write_histogram",
]
