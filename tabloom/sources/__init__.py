from tabloom.sources.coerce import coerce_dtypes  # noqa: F401
from tabloom.sources.excel import read_excel  # noqa: F401
from tabloom.sources.files import (  # noqa: F401
    list_datasets,
    load_dataset,
    read_csv,
    read_json,
    read_parquet,
    write_dataset,
    write_splits,
)
from tabloom.sources.sqlite import list_sqlite_tables, read_sqlite, register_sqlite_tables  # noqa: F401
