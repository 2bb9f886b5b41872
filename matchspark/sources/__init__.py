from matchspark.sources.tables import TableSource, jdbc_options_from_url, read_table  # noqa: F401
