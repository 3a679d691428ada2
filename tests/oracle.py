"""Runs a query's SQL in DuckDB over the same tables and compares the rows."""

import glob
import os

import duckdb


def rows_of(df, columns):
    def value(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        if hasattr(v, "tolist"):
            return str(v.tolist())
        return str(v)

    return sorted(tuple(value(v) for v in r) for r in df[columns].itertuples(index=False))


def sql_rows(sql, folder):
    con = duckdb.connect()
    for f in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con.execute(sql).df()


def compare(spark_df, sql, folder, where):
    spark_df.write.mode("overwrite").parquet(where)
    ours, theirs = duckdb.connect().execute(f"select * from '{where}/*.parquet'").df(), sql_rows(sql, folder)
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows_of(ours, columns) == rows_of(theirs, columns)
