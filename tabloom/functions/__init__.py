from tabloom.functions.columns import (  # noqa: F401
    c,
    categorical_columns,
    datetime_columns,
    is_numeric,
    numeric_columns,
    require_column,
    string_columns,
)
from tabloom.functions.seeded import seeded_fraction, seeded_key  # noqa: F401
