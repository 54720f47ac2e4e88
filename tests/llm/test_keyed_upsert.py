"""The upsert's files against a plain version that holds the whole table."""

import glob
import hashlib
import math
import os
import zlib
from datetime import datetime

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewell.llm import keyed_upsert, queries

CLIENT = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
CHANGE = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
NAMES = [c.split()[0] for c in CLIENT.split(", ")]


def _crc(x):
    return zlib.crc32(str(x).encode())


def _brute(clients, changes):
    """(first_id, n_rows, cents, rows_crc, ids, rewritten) of every file by the contract's words."""
    m = 1 + len(clients) // 700
    base = sorted((c for c in clients if c[0] is not None and _crc(c[0]) % 7 > 3), key=lambda c: c[0])
    files = [base[i : i + m] for i in range(0, len(base), m)]
    if not files:
        return []
    best = {}
    for c in changes:
        order = tuple((x is not None, x or 0) for x in (c[2], c[0]))
        if c[1] is not None and (c[1] not in best or order > best[c[1]][0]):
            best[c[1]] = (order, c)
    new = [{r[0]: r for r in f} for f in files]
    for i, (_, c) in best.items():
        home = max((k for k, f in enumerate(files) if f[0][0] <= i), default=0)
        h = _crc(files[home][0][0]) % 12
        if h > 7:
            continue
        if c[3] == "D" or _crc(c[0]) % 8 < h:
            new[home].pop(i, None)
        else:
            row = list(new[home].get(i, (i,) + (None,) * 9))
            row[2], row[8], row[6], row[9] = c[5], c[6], c[7], c[8]
            new[home][i] = tuple(row)
    out = []
    for old, now in zip(files, new):
        rows = [now[i] for i in sorted(now)]
        if rows == old:
            out.append([rows, False])
            continue
        k = math.ceil(len(rows) / m)
        at = 0
        for piece in range(k):
            size = len(rows) // k + (piece < len(rows) % k)
            out.append([rows[at : at + size], True])
            at += size
    joined = []
    for rows, fresh in out:
        if fresh and joined and joined[-1][1] and len(joined[-1][0]) + len(rows) <= m:
            joined[-1][0] = joined[-1][0] + rows
        else:
            joined.append([rows, fresh])
    cents = lambda r: 0 if r[9] is None else math.floor(100 * r[9] + 0.5)
    said = lambda r: _crc("|".join(r[k] or "" for k in (2, 8, 6)))
    return [(rows[0][0], len(rows), sum(map(cents, rows)), sum(map(said, rows)), hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest(), ",".join(NAMES), fresh) for rows, fresh in joined]


def _tables(seed, n, n_changes):
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    at = datetime(2024, 1, 1)
    clients = [(i * 3, i, pick("crm", "web", None), at, f"n{i}", None, pick("A", "é", None), 1, pick("x", None), pick(None, 1.25, -2.005, float(i))) for i in range(n)]
    changes = [(k, pick(7, int(rng.integers(-20, 3 * n + 200))), pick(k, 3, None), pick("U", "U", "I", "D", None), at, pick("crm", "web", None), pick("x", None), pick("A", "é"), pick(None, 5.5)) for k in range(n_changes)]
    return clients + [(None, 0, "crm", at, "", "", "", 1, "", 0.0)], changes + changes[:10] + [(99, None, 1, "U", at, "a", "b", "c", 1.0)]


def _run(spark, tmp_path, clients, changes):
    spark.createDataFrame(clients, CLIENT).repartition(3).write.parquet(f"{tmp_path}/clients.parquet")
    spark.createDataFrame([(*c, "extra") for c in changes], CHANGE + ", home string").repartition(3).write.parquet(f"{tmp_path}/client_changes.parquet")
    return queries.op11_keyed_upsert(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("seed,n,n_changes", [(1, 900, 300), (3, 1500, 9000), (4, 40, 400)])
def test_query_equals_brute_force(spark, tmp_path, seed, n, n_changes):
    clients, changes = _tables(seed, n, n_changes)
    got = sorted(_run(spark, tmp_path, clients, changes), key=lambda r: r["first_id"])
    want = _brute(clients, changes)
    assert [tuple(r[c] for c in ("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "rewritten")) for r in got] == want
    assert any(r["rewritten"] for r in got) and (n < 900 or not all(r["rewritten"] for r in got))
    folder = os.path.dirname(got[0]["path"])
    assert sorted(glob.glob(f"{folder}/**/*.parquet", recursive=True)) == sorted(r["path"] for r in got)
    for r in got[:5]:
        own = pq.read_table(r["path"])
        assert own.column_names == NAMES and own["client_id"].to_pylist()[0] == r["first_id"] and len(own) == r["n_rows"]


def test_no_rows(spark, tmp_path):
    clients, changes = _tables(5, 10, 20)
    assert _run(spark, tmp_path, [], changes) == []
    os.makedirs(tmp_path / "b")
    got = _run(spark, tmp_path / "b", clients, [])
    assert [tuple(r[c] for c in ("first_id", "n_rows", "rewritten")) for r in sorted(got, key=lambda r: r["first_id"])] == [(w[0], w[1], w[-1]) for w in _brute(clients, [])]


def _always(said):
    return lambda first, change: F.lit(said)


def test_all_deleted_repeated_keys_and_text_keys(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i:03}", i) for i in range(50)], "k string, v int")
    keyed_upsert.start(rows, f"{tmp_path}/t", "k", 8)
    assert len(glob.glob(f"{tmp_path}/t/*.parquet")) == 7
    more = spark.createDataFrame([("k010", 1, -1), ("k010", 2, -2), ("k0105", 1, -3), ("a", 1, -4)], "k string, seq int, v int")
    kept = keyed_upsert.upsert(spark, f"{tmp_path}/t", more, "k", ("seq",), ("v",), 8, _always("set"))
    assert len(kept) == 5
    got = {r["k"]: r["v"] for r in keyed_upsert.table(spark, f"{tmp_path}/t", rows.schema).collect()}
    assert got == {f"k{i:03}": i for i in range(50)} | {"k010": -2, "k0105": -3, "a": -4}
    every = rows.select("k", F.lit(1).alias("seq")).union(more.select("k", "seq"))
    assert keyed_upsert.upsert(spark, f"{tmp_path}/t", every, "k", ("seq",), (), 8, _always("delete")) == []
    assert keyed_upsert.table(spark, f"{tmp_path}/t", rows.schema).count() == 0 and not glob.glob(f"{tmp_path}/t/*.parquet")
    twice = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "k long, v string").coalesce(1)
    keyed_upsert.start(twice, f"{tmp_path}/d", "k", 2)
    keyed_upsert.upsert(spark, f"{tmp_path}/d", spark.createDataFrame([], "k long, v string"), "k", ("v",), ("v",), 2, _always("set"))
    assert sorted(r["k"] for r in keyed_upsert.table(spark, f"{tmp_path}/d", twice.schema).collect()) == [1, 2, 3]


def test_layout_joins_only_what_fits():
    home = lambda n, dirty=True: keyed_upsert.Home("", 0, dirty, n)
    assert keyed_upsert.layout([home(3), home(4), home(0), home(3), home(9, False), home(1)], 10) == ([0, 0, -1, 0, -1, 1], 2)
    assert keyed_upsert.layout([home(21), home(3), home(4), home(0, True), home(25)], 10) == ([0, 2, 3, -1, 4], 7)
    assert keyed_upsert.layout([], 10) == ([], 0)
