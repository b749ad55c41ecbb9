"""Compare registered queries with their SQL: python tests/check_oracles.py SF_DIR [name ...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def _value(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    if hasattr(value, "item"):
        value = value.item()
    if type(value).__name__ == "Decimal":
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return str(int(value)) if value == int(value) else f"{value:.6f}"
    return str(value)


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_value(row[i]) for i in order) for row in rows)


def connect(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def compare(spark, connection, sf_dir, query, sql):
    """None when both sides agree, else a description of the difference."""
    found = query(spark, sf_dir)
    got = table_rows(found.columns, found.collect())
    if sql is None:
        return None if got[1] else "no rows"
    result = connection.execute(sql)
    expected = table_rows([c[0] for c in result.description], result.fetchall())
    if got[0] != expected[0]:
        return f"columns {got[0]} != {expected[0]}"
    if not got[1]:
        return "no rows"
    if got[1] == expected[1]:
        return None
    first = next(
        (pair for pair in zip(got[1], expected[1], strict=False) if pair[0] != pair[1]), None
    )
    return f"{len(got[1])} rows, expected {len(expected[1])}; first difference {first}"[:1500]


def main():
    import __spark_entry__ as entry
    from conftest import make_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = make_session()
    connection = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, query, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        state = "ok" if problem is None else "FAIL"
        weak = "" if name in oracles else " (no SQL)"
        print(f"{state} {name}{weak} {time.time() - start:.1f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
