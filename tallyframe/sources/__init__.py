from tallyframe.sources.files import list_files, public_bucket_options
from tallyframe.sources.jdbc import read_jdbc_query, read_jdbc_table
from tallyframe.sources.tables import create_delimited_table, create_table_at
from tallyframe.sources.text import frame_from_rows, read_delimited, read_parquet

__all__ = [
    "create_delimited_table",
    "create_table_at",
    "frame_from_rows",
    "list_files",
    "public_bucket_options",
    "read_delimited",
    "read_jdbc_query",
    "read_jdbc_table",
    "read_parquet",
]
