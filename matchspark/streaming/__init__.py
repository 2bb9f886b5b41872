from matchspark.streaming.refresh import start_refresh  # noqa: F401
