from riskloom.sources.tables import (  # noqa: F401
    TABLES, claims_view, doctors_view, hospitals_view, parts_view, patients_view,
    prediction_log_view, read_table,
)
