"""Feed files and shared intermediate tables."""

from shelfgauge.sources.feed_csv import (
    clean_feed,
    column_status,
    conform,
    export_columns,
    normalise_headers,
    read_feed,
    require_columns,
    surplus_rows,
    write_feed,
    write_file,
    write_ordered,
)
from shelfgauge.sources.shared_tables import (
    drop_folder,
    drop_tables,
    new_path,
    scratch,
    shared_folder,
    store,
    store_once,
)

__all__ = [
    "clean_feed",
    "column_status",
    "conform",
    "drop_folder",
    "drop_tables",
    "export_columns",
    "new_path",
    "normalise_headers",
    "read_feed",
    "require_columns",
    "scratch",
    "shared_folder",
    "store",
    "store_once",
    "surplus_rows",
    "write_feed",
    "write_file",
    "write_ordered",
]
