import glob
import os

import pandas as pd


def same(got, duckdb, sql, data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(sql).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)

    def canonical(df):
        return sorted(repr([None if pd.isna(x) else str(x) for x in r]) for r in df[columns].itertuples(index=False))

    assert canonical(got) == canonical(want)
