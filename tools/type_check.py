"""List column-type differences between each Spark query and its DuckDB oracle."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ledgerline.plans.registry import all_queries  # noqa: E402
from ledgerline.session import get_spark  # noqa: E402
from ledgerline.sources.tables import TABLES  # noqa: E402

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, q in all_queries().items():
        if not q.sql:
            continue
        s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in q.fn(spark, sf).schema.fields}
        rel = con.sql(q.sql)
        d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
                if s_types.get(c) != d_types.get(c)}
        if diff:
            print(name, diff)


if __name__ == "__main__":
    main()
