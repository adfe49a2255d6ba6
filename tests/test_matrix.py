import numpy as np
import pytest

from lattica.functions import lcg
from lattica.matrix import Flag, MatrixError, MatrixType, SparseMatrix, matrix_from_entries
from lattica.operators import convert
from lattica.sources import plot, random_matrix
from lattica.sources import rutherford_boeing as rb

SYM5 = [(1, 1, 2), (2, 1, 1), (2, 2, 4), (3, 2, 1), (5, 2, 8), (3, 3, 3), (4, 3, 2), (5, 5, 2)]


@pytest.fixture(scope="module")
def sym5(spark):
    return matrix_from_entries(spark, SYM5, 5, 5, MatrixType.REAL_SYM_INDEF)


# Published results that must be met.
def test_stream_golden(spark):
    s = lcg.RandomState()
    assert (round(s.real(), 12), round(s.real(True), 12), s.integer(20), s.integer(20 * (2**31 - 1)), s.logical()) == (0.951878630556, 0.395779648796, 3, 33572664025, False)
    t, u = lcg.RandomState(), lcg.RandomState()
    u.jump(700)
    states = [t.step() for _ in range(700)]
    assert u.seed == states[-1]
    assert [r["state"] for r in lcg.stream(spark, 700).orderBy("k").collect()] == states


# Published results that must be met.
def test_random_matrix_golden(spark):
    a = random_matrix.random_matrix(spark, lcg.RandomState(), MatrixType.UNSPECIFIED, 4, 5, 8, nonsingular=True)
    got = [(r.i, r.j, round(r.v, 5)) for r in a.entries.orderBy("pos").collect()]
    assert sorted(got) == sorted([(4, 1, -0.90631), (2, 3, 0.95364), (3, 4, 0.11631), (1, 4, -0.10744), (1, 5, 0.91), (2, 5, 0.10912), (4, 5, 0.77313), (3, 5, -0.58957)])


@pytest.mark.parametrize(("args", "flag"), [((MatrixType.CPLX_RECT, 2, 2, 1), -2), ((MatrixType.REAL_UNSYM, 2, 3, 1), -4), ((MatrixType.REAL_RECT, 0, 3, 1), -3), ((MatrixType.REAL_RECT, 2, 2, 5), -3)])
def test_random_matrix_errors(args, flag):
    with pytest.raises(random_matrix.RandomMatrixError) as e:
        random_matrix.check(*args, False)
    assert e.value.flag == flag


def test_random_patterns():
    s = lcg.RandomState()
    for k in range(30):
        kind = [MatrixType.REAL_RECT, MatrixType.REAL_UNSYM, MatrixType.REAL_SYM_INDEF][k % 3]
        n = s.between(1, 30)
        m = s.between(1, 30) if k % 3 == 0 else n
        nnz = s.between(min(m, n), n * (n + 1) // 2 if kind.lower_only else m * n)
        columns = random_matrix.pattern(s, kind, m, n, nnz, nonsingular=True, sort=True)
        assert sum(map(len, columns)) == nnz
        assert all(c == sorted(set(c)) and all(1 <= i <= m for i in c) for c in columns)
        assert not kind.lower_only or all(i >= j for j, c in enumerate(columns, 1) for i in c)


def test_duplicates_are_summed(spark):
    rows = [(1, 1, 1.0, 1), (1, 1, 10.0, 2), (1, 1, 100.0, 3), (2, 1, 1.0, 4), (9, 1, 1.0, 5), (1, 2, 5.0, 6)]
    d = spark.createDataFrame(rows, "i long, j long, v double, pos long")
    c = convert.from_coordinates(d, 2, 2, MatrixType.REAL_SYM_INDEF)
    assert (c.out_of_range, c.duplicates, c.missing_diagonal, c.flag) == (1, 3, 1, Flag.WARN_MISSING_DIAGONAL_AND_OTHER)
    assert sorted(map(tuple, c.matrix.entries.collect())) == [(1, 1, 111.0), (2, 1, 6.0)]
    mapping = convert.conversion_map(d, 2, 2, MatrixType.REAL_SYM_INDEF)
    assert sorted(map(tuple, convert.apply_conversion_map(d.select("pos", "v"), mapping).collect())) == [(1, 111.0), (2, 6.0)]
    u = convert.clean(d, 2, 2, MatrixType.REAL_RECT)
    assert (u.flag, u.duplicates) == (Flag.WARN_DUPLICATE_AND_OUT_OF_RANGE, 2)


def test_conversion_errors(spark):
    d = spark.createDataFrame([(7, 1, 1.0)], "i long, j long, v double")
    for call, flag in ((lambda: convert.from_coordinates(d, 2, 2), Flag.ALL_OUT_OF_RANGE), (lambda: convert.from_coordinates(d, -1, 2), Flag.N_OUT_OF_RANGE), (lambda: convert.from_coordinates(d, 2, 3, MatrixType.REAL_UNSYM), Flag.NOT_SQUARE), (lambda: convert.clean(d, 2, 2), Flag.ALL_OUT_OF_RANGE)):
        with pytest.raises(MatrixError) as e:
            call()
        assert e.value.flag == flag


def test_verify(spark, sym5):
    at = convert.positions(sym5.entries, 5)
    assert convert.verify(at, None, 5, 5, MatrixType.REAL_SYM_INDEF) == (Flag.SUCCESS, 0)
    assert convert.verify(at, None, 5, 5, MatrixType.REAL_SYM_PSDEF) == (Flag.MISSING_DIAGONAL, 4)
    bad = spark.createDataFrame([(2, 1, 1.0, 1), (2, 1, 1.0, 2), (1, 1, 1.0, 3), (9, 2, 1.0, 4)], "i long, j long, v double, pos long")
    assert convert.verify(bad, None, 3, 3, MatrixType.REAL_RECT) == (Flag.ROW_DUPLICATE, 1)
    assert convert.verify(bad.where("pos > 1"), None, 3, 3, MatrixType.REAL_RECT) == (Flag.ROW_ORDER, 3)
    assert convert.verify(bad.where("pos > 2"), None, 3, 3, MatrixType.REAL_RECT) == (Flag.ROW_OUT_OF_RANGE, 4)
    assert convert.verify(bad, [1, 3, 2, 5], 3, 3, MatrixType.REAL_RECT) == (Flag.PTR_ORDER, 3)
    assert convert.verify(at, [0, 1], 5, 5, MatrixType.REAL_SKEW) == (Flag.PTR_FIRST, 0)
    assert convert.verify(at, convert.column_pointers(sym5.entries, 5), 5, 5, MatrixType.REAL_SYM_INDEF) == (Flag.SUCCESS, 0)


# Published results that must be met.
def test_print_golden(sym5):
    lines = convert.print_matrix(sym5)
    assert lines[0] == "Real symmetric indefinite matrix, dimension 5x5 with 8 entries."
    assert lines[1] == "1:   2.0000E+00   1.0000E+00"
    assert lines[2] == "2:   1.0000E+00   4.0000E+00   1.0000E+00                8.0000E+00"


# Published results that must be met.
def test_file_golden_and_round_trip(spark, sym5, tmp_path):
    rb.write(sym5, str(tmp_path / "m"), title="A test matrix")
    text = next((tmp_path / "m").glob("part-*")).read_text().splitlines()
    assert text[0] == f"{'A test matrix':<72}0       "
    assert text[1].split() == ["5", "1", "1", "3"]
    assert text[3].split() == ["(40i2)", "(40i2)", "(3e24.16)"]
    assert text[4] == " 1 3 6 8 8 9"
    assert text[5] == " 1 2 2 3 5 3 4 5"
    assert text[6] == "  0.2000000000000000E+01  0.1000000000000000E+01  0.4000000000000000E+01"
    a, h, flag = rb.read(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, a.entries.collect())) == sorted((i, j, float(v)) for i, j, v in SYM5)
    assert (h.title, h.type_code, flag) == ("A test matrix", "rsa", 0)
    full, _, _ = rb.read(spark, str(tmp_path / "m"), rb.ReadOptions(triangle=3))
    assert full.entries.count() == 12
    dominant, _, _ = rb.read(spark, str(tmp_path / "m"), rb.ReadOptions(values=-3))
    assert {r.i: r.v for r in dominant.entries.where("i = j").collect()} == dict.fromkeys(range(1, 6), 100.0)
    spark.dataSource.register(rb.RutherfordBoeing)
    path = str(next((tmp_path / "m").glob("part-*")))
    assert spark.read.format("rb").load(path).count() == 8


def test_file_errors(spark, tmp_path):
    with pytest.raises(rb.FileError):
        rb.peek(spark, str(tmp_path / "absent"))
    (tmp_path / "x.rb").write_text("t\n 1 1 1 1\nxyz 1 1 1 0\n()\n")
    with pytest.raises(rb.FileError) as e:
        rb.peek(spark, str(tmp_path / "x.rb"))
    assert e.value.flag == rb.FileFlag.NOT_RB
    for options, flag in ((rb.ReadOptions(extra_space=0.5), -10), (rb.ReadOptions(triangle=5), -11), (rb.ReadOptions(values=9), -13)):
        with pytest.raises(rb.FileError) as e:
            rb.read(spark, str(tmp_path / "x.rb"), options)
        assert e.value.flag == flag


def test_files_in_parts(spark, tmp_path):
    r = np.random.default_rng(5)
    m, n = 40, 1500
    places = {(int(i), int(j)) for i, j in zip(r.integers(1, m + 1, 4000), np.concatenate([r.integers(1, n - 200, 3000), np.full(1000, 700)]), strict=True)}  # empty columns, also last ones; a full one
    rows = sorted((j, i, float(f"{x:.14e}")) for (i, j), x in zip(sorted(places), r.normal(size=len(places)) * 10.0 ** r.integers(-9, 9, len(places)), strict=True))  # files keep 16 digits
    want = [(i, j, v) for j, i, v in rows]
    a = matrix_from_entries(spark, want, m, n, MatrixType.REAL_RECT)
    folder = tmp_path / "parts"
    rb.write(a, str(folder), least_parts=6)
    files = sorted(folder.glob("part-*"))
    assert len(files) == 6
    text = "".join(f.read_text() for f in files)
    i, j, v = (np.array(x) for x in zip(*want, strict=True))
    assert text == rb.encode(i, j, v, m, n, MatrixType.REAL_RECT)
    got, h, _ = rb.read(spark, str(folder))
    assert (h.m, h.n, h.indices) == (m, n, len(want))
    assert sorted(map(tuple, got.entries.collect())) == sorted(want)
    drawn = {(x.i, x.j): x.v for x in rb.read(spark, str(folder), rb.ReadOptions(values=-2))[0].entries.collect()}
    state = lcg.RandomState()
    assert [drawn[x[:2]] for x in want] == [state.real() for _ in want]  # the k-th entry in column order takes the k-th draw
    spark.dataSource.register(rb.RutherfordBoeing)
    for name, content in (("one", text), ("crlf", text.replace("\n", "\r\n")), ("uneven", text.replace("\n", "  \n"))):
        (tmp_path / name).write_bytes(content.encode())
        frame = spark.read.format("rb").option("entries", 300).load(str(tmp_path / name))
        assert frame.rdd.getNumPartitions() == (1 if name == "uneven" else -(-len(want) // 300))
        assert [tuple(x) for x in frame.orderBy("pos").collect()] == [(*x, k + 1) for k, x in enumerate(want)]
    (tmp_path / "short").write_text("\n".join(text.splitlines()[:-3]))
    with pytest.raises(rb.FileError) as e:
        rb.read(spark, str(tmp_path / "short"))
    assert e.value.flag == rb.FileFlag.IO


def test_an_empty_matrix_has_a_file(spark, tmp_path):
    a = matrix_from_entries(spark, [(1, 1, 1.0)], 3, 2, MatrixType.REAL_RECT)
    rb.write(SparseMatrix(a.entries.where("i > 1"), 3, 2, MatrixType.REAL_RECT), str(tmp_path / "none"))
    assert rb.read(spark, str(tmp_path / "none"))[0].entries.count() == 0


def test_integer_values_are_kept():
    text = "t".ljust(72) + "0       \n" + "             3             1             1             1\nisa                        2             2             3             0\n(40i2)          (40i2)          (40i2)              \n 1 3 4\n 1 2 2\n 1 2 3\n"
    assert rb.decode(text).v.tolist() == [1.0, 2.0, 3.0]


def test_picture(sym5):
    assert plot.picture(sym5.entries, 5, 5).tolist()[4] == [1, 0, 1, 1, 0]
    assert plot.pgm_text(np.array([[0, 1]])) == "P2\n2 1\n1\n0 1\n"
