"""Sources: tables, catalogs, source trees."""

from declarium.sources.tables import checkpoint_dir, columns, latest, materialize, release, table

__all__ = ["checkpoint_dir", "columns", "latest", "materialize", "release", "table"]
