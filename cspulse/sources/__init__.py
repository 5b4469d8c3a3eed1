"""Table sources: declared-schema Parquet readers/writers and fixture derivation."""

from .derive import (derive_activity, derive_baseline, derive_customers, fixture_baseline,
                     fixture_history, fixture_tables)
from .tables import (conform, domain_faults, load_activity, load_baseline, load_customers,
                     write_activity, write_customers)
from .upsert import activity_table, upsert
from .versions import VersionConflict, VersionedTable, publish, read_published

__all__ = [
    "VersionConflict", "VersionedTable", "activity_table", "conform", "derive_activity", "derive_baseline", "derive_customers", "domain_faults",
    "fixture_baseline", "fixture_history", "fixture_tables", "load_activity", "load_baseline", "load_customers",
    "publish", "read_published", "upsert", "write_activity", "write_customers",
]
