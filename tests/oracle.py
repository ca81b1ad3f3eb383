"""Runs SQL over a folder of driver tables, and compares results as bags of rows."""

import os
from collections import Counter

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


def connect(sf_dir=DIR):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def bag(pdf):
    pdf = pdf[sorted(pdf.columns)]

    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return None
        x = x.item() if hasattr(x, "item") else x
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return Counter(tuple(map(cell, r)) for r in pdf.itertuples(index=False, name=None))


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = bag(got), bag(want)
    assert a == b, (list((a - b).items())[:2], list((b - a).items())[:2])
