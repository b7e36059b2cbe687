"""Sources and sinks: JSONL (plain or compressed), statement folders, Parquet caches."""

from .files import (materialize, output_name, parquet_rows, read_statement_dir, scratch_path,  # noqa: F401
                    split_from_name, write_parquet, write_report, write_statement_dir)
from .jsonl import (jsonl_rejects, numbered_lines, read_jsonl_lenient, read_jsonl_strict,  # noqa: F401
                    read_lines, write_jsonl)
