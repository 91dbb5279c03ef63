"""Compare registered queries with their SQL: python tests/oracle.py SF_DIR [PREFIX...]."""

import glob
import sys
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def compare(spark, con, sf_dir, name, entry):
    """'' if the rows agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if not sql:
        return "" if got else "no rows"
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    if not got:
        return "no rows"
    return "" if got == want else f"{len(got)} and {len(want)} rows; {sorted(set(got) - set(want))[:2]} and {sorted(set(want) - set(got))[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sys.argv[1])
    bad = 0
    for name in entry.queries():
        if (sys.argv[2:] and not name.startswith(tuple(sys.argv[2:]))) or (not sys.argv[2:] and (name.startswith("op") or name == "pipeline")):
            continue
        try:
            said = compare(spark, con, sys.argv[1], name, entry)
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:700]}" if "-v" not in sys.argv else traceback.format_exc()
        bad += bool(said)
        if said:
            print(name, said, flush=True)
    print("bad", bad)
