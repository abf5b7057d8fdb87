"""Readers, writers and tables in the shared folder."""

from .examples import example_domains, nm_data_timepoints
from .tables import read_domains, read_table, write_csv
from .shared import close, written

__all__ = ["close", "example_domains", "nm_data_timepoints", "read_domains", "read_table", "write_csv", "written"]
