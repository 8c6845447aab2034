from wardlens.sources.readers import coerce_dates, read_dim, read_table, read_tests, rejected_values
from wardlens.sources.writers import stamped_name, write_csv

__all__ = ["coerce_dates", "read_dim", "read_table", "read_tests", "rejected_values", "stamped_name", "write_csv"]
