"""Queries through files and whole runs, with a shared folder as a cluster has it."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from promptmatrix.plans import project_queries


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    """spark.checkpoint.dir is set and reached by paths, so that project folders lie in it."""
    place = (tmp_path / "shared").as_uri()
    monkeypatch.setattr(project_queries.runs, "shared_folder", lambda spark: place)
    return place


def put(tmp_path, name: str, **columns) -> str:
    pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_a_results_log_is_written_beside_the_project(spark, tmp_path, shared):
    d = put(tmp_path, "nation", n_nationkey=pa.array(range(4), pa.int32()), n_name=["A", "B", "C", "D"])
    got = {(r.case_id, r.output, r.passed) for r in project_queries.results_log_read(spark, d).collect()}
    assert got == {("n0", "A", False), ("n1", "B", True), ("n2", "C", True), ("n3", "D", False)}


def test_pages_share_starts_of_the_stream(spark, tmp_path, shared, monkeypatch):
    """600 suppliers are 15 pages of 40, which go in few waves."""
    handed, drain = [], project_queries.waves.drain

    def counted(spark, source, base, checkpoint, wave, *more, **named):
        return drain(spark, source, base, checkpoint, lambda pages, number: (handed.append(number), wave(pages, number)), *more, **named)

    monkeypatch.setattr(project_queries.waves, "drain", counted)
    d = put(tmp_path, "supplier", s_suppkey=pa.array(range(1, 601), pa.int32()), s_name=[f"S{i}" for i in range(600)])
    got = sorted((r.page, r.n, int(r.case_id)) for r in project_queries.page_waves(spark, d).collect())
    assert got == [(i // 40, 40, i + 1) for i in range(600)]
    assert len(handed) == 1


def test_csv_cases_leave_the_driver_out(spark, tmp_path, shared, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("rows of the table came to the driver")

    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", refused)
    names = ['a, "b"', " c ", "d"]
    d = put(tmp_path, "customer", c_custkey=pa.array([1, 2, 3], pa.int32()), c_name=names, c_mktsegment=["x", None, "z,"])
    got = sorted((r.case_id, r.name, r.expected) for r in project_queries.csv_cases(spark, d).collect())
    assert got == [("1", names[0], "x"), ("2", names[1], None), ("3", names[2], "z,")]


def test_borders_of_waves_are_counted_not_sorted(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("the cells were sorted")

    ords = [3 * i * i for i in range(300)]
    book = object.__new__(project_queries.runs.Book)
    book.cells, book.count = spark.createDataFrame([(x,) for x in ords], "cell_ord long"), len(ords)
    monkeypatch.setattr(type(book.cells), "orderBy", refused)
    got = [sorted(r.cell_ord for r in part.collect()) for part in book.waves(lambda: 130)]
    assert got == [ords[:130], ords[130:260], ords[260:]]
    assert [project_queries.runs.matrix.border(book.cells, n, ranges=7) for n in (1, 2, 77, 300)] == [ords[i - 1] for i in (1, 2, 77, 300)]
