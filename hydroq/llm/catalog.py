"""Registry of the queries of this subpackage and of the SQL text each is checked against."""

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register ``build(spark, sf_dir)``; ``sql`` is the DuckDB text with the same rows, where there is one."""

    def wrap(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
