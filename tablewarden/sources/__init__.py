"""Readers, writers and shared scratch folders."""

from .file_rows import read_parquet_with_row_id
from .files import read_csv, read_parquet, staged_parquet, write_csv
from .scratch import checkpointed, remove_scratch, scratch_folder

__all__ = ["checkpointed", "read_csv", "read_parquet", "read_parquet_with_row_id", "remove_scratch", "scratch_folder", "staged_parquet", "write_csv"]
