"""Queries on small tables of the rows that only large tables have, against
their SQL, the sign of zero included."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siltstone.plans.queries import oracles, queries


def table(folder, vectors, ids=None, labels=None):
    n = len(vectors)
    columns = {"vec_id": pa.array(list(range(n)) if ids is None else ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([k % 3 for k in range(n)] if labels is None else labels, pa.int32())}
    pq.write_table(pa.table(columns), f"{folder}/embeddings.parquet")
    return str(folder)


def signed(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6))
    return tuple(map(signed, v)) if isinstance(v, (list, tuple)) else v


def agrees(spark, folder, name):
    df = queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    result = con.execute(oracles()[name])
    at = [[c[0] for c in result.description].index(c) for c in df.columns]
    want = sorted((tuple(signed(r[k]) for k in at) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(signed, r)) for r in df.collect()), key=repr) == want
    return want


def vectors(n, seed=1):
    return np.random.default_rng(seed).normal(0, 0.12, (n, 64)).astype(np.float32)


def small():
    """Vectors with components that round to zero from either side, and halves."""
    v = vectors(24)
    v[::2, :64:5], v[1::2, :64:3], v[4], v[6, :9] = -2e-7, 3e-7, 0.0, [-0.0, 0, 0, 0, -0.0, 0, 0, 0, -0.0]
    v[8:, 10], v[9:, 11] = -0.0000005, 2.0**-7
    return v.tolist()


@pytest.mark.parametrize("name", ["alignment_columns", "alignment_copies", "alignment_first", "stockholm_rows", "hhr_hits", "hmmsearch_hits"])
def test_component_at_a_letters_bound(spark, tmp_path, name):
    v = vectors(16)
    v[:, ::3], v[:, 1::6], v[:, 2::6] = 0.15, 0.1, -0.1
    v[3, :8], v[5, :8] = -0.15, 0.08
    agrees(spark, table(tmp_path, v.tolist()), name)


@pytest.mark.parametrize("name", ["pad_truncate", "virtual_point"])
def test_zero_keeps_its_sign_in_vectors(spark, tmp_path, name):
    agrees(spark, table(tmp_path, small()), name)


def test_zero_keeps_its_sign_through_a_text(spark, tmp_path):
    got = agrees(spark, table(tmp_path, small()), "parse_arrays")
    assert any("-0.0" in r[1] for r in got)


@pytest.mark.parametrize("name", ["rigid_frames", "torsions"])
def test_zero_keeps_its_sign_in_axes(spark, tmp_path, name):
    v = vectors(12)
    v[:, :9], v[::2, 6], v[1::2, 3] = [1, 0, 0, 0, 0, 0, 0, 1, 0], 1e-7, -1e-7
    agrees(spark, table(tmp_path, v.tolist()), name)


def test_zero_keeps_its_sign_in_crops(spark, tmp_path):
    got = agrees(spark, table(tmp_path, small()), "crop_slice")
    assert any("-0.0" in r[1] for r in got)


def test_atom_serials_of_more_than_five_digits(spark, tmp_path):
    ids = [0, 9, 12_345, 99_999, 100_000, 100_001, 123_456, 999_999, 43_770_015, 43_770_016, 87_440_031]
    got = agrees(spark, table(tmp_path, vectors(len(ids)).tolist(), ids), "pdb_atoms")
    assert sorted(r[2] for r in got) == ids


@pytest.mark.parametrize("n", [36, 30, 26, 37])
def test_alternative_alone_in_its_residue(spark, tmp_path, n):
    got = agrees(spark, table(tmp_path, vectors(n).tolist()), "mmcif_alternatives")
    assert (1, n - 1) in got


def test_slots_of_an_alternative_alone(spark, tmp_path):
    got = agrees(spark, table(tmp_path, vectors(36).tolist()), "mmcif_chain_slots")
    assert (1, 13, 1) in {r[:3] for r in got}
