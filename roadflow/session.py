"""Session settings that the engine relies on."""

from pyspark.sql import SparkSession


def build(app: str = "roadflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; ``conf`` adds or overrides settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
