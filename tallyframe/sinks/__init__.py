from tallyframe.sinks.files import replace_directory, write_csv, write_directory, write_single_csv
from tallyframe.sinks.tables import (
    recover_table,
    refresh_table,
    rewrite_external_table,
    store_once,
    write_external_table,
)

__all__ = [
    "recover_table",
    "refresh_table",
    "replace_directory",
    "rewrite_external_table",
    "store_once",
    "write_csv",
    "write_directory",
    "write_external_table",
    "write_single_csv",
]
