"""Small tables with every awkward case, and plain re-tellings of the contracts."""

import re

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = {c: c + 32 for c in range(65, 91)}

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    """Documents with ids from ``start``; a text may be a (id, text) pair."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts, start)]
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)


def odd_columns(df, *names):
    """The table with further columns that have the names operators like to use."""
    for n in names:
        df = df.withColumn(n, df[df.columns[0]].cast("string"))
    return df


def sql_rows(sql, folder=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return {r[0]: r for r in (tuple(dict(zip(names, row))[n] for n in names) for row in found.fetchall())}, names


def agrees(df, sql, folder=SF):
    wanted, names = sql_rows(sql, folder)
    assert sorted(df.columns) == sorted(names)
    got = {r[names[0]]: tuple(r[n] for n in names) for r in df.collect()}
    assert got == wanted


def words(text):
    return SPACE_WORD.findall(text or "")


def shingles(text, n=5):
    w = words((text or "").translate(ASCII))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]
