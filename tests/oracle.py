"""Side-by-side runs of a registered query and its SQL."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return repr(x)
    return str(int(x)) if isinstance(x, bool) else str(x)


def compare(made, con, sql: str) -> str:
    """What differs, or an empty text."""
    names = sorted(made.columns)
    relation = con.sql(sql)
    if sorted(relation.columns) != names:
        return f"columns {names} and {sorted(relation.columns)}"
    mine = Counter(tuple(plain(v) for v in r) for r in made.select(*[f"`{n}`" for n in names]).collect())
    theirs = Counter(tuple(plain(v) for v in r) for r in con.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({sql})").fetchall())
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}, only there {list((theirs - mine).items())[:3]}"
