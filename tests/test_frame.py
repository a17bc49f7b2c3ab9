"""Small literal frames: nulls, NaN, ties, names and errors."""

import math

import pytest
from pyspark.sql import functions as F

from framewright.plans import frame as fw
from framewright.plans.frame import Frame
from framewright.sources import csv, literals


@pytest.fixture
def make(spark):
    def build(data, order="i"):
        n = len(next(iter(data.values())))
        return Frame(literals.frame(spark, {"i": list(range(n)), **data}), order)

    return build


def test_constructors(spark):
    assert literals.frame(spark, {"a": [1, None], "b": "x"}).dtypes == [("a", "bigint"), ("b", "string")]
    assert literals.frame(spark, [{"a": 1}, {"b": 2.0, "a": 3}]).collect()[1].b == 2.0
    assert literals.frame(spark, [[1, "x"], [2]]).columns == ["0", "1"]
    assert literals.frame(spark, {"a": [None, None]}).dtypes == [("a", "double")]
    assert literals.frame(spark, {"a": [[1, 2], None]}).dtypes == [("a", "array<bigint>")]
    with pytest.raises(ValueError):
        literals.frame(spark, {"a": [1], "b": [1, 2]})


def test_group_aggregates_and_null_keys(make):
    f = make({"cat": ["a", "b", "a", "b", "a", None], "val": [1, 2, 3, 4, 5, 9]})
    assert {r.cat: r.val for r in f.groupby("cat")["val"].sum().df.collect()} == {"a": 9, "b": 6}
    assert {r.cat: r.val for r in f.groupby("cat")["val"].mean().df.collect()} == {"a": 3.0, "b": 3.0}
    assert len(f.groupby("cat")) == 2
    assert f.groupby("cat")["val"].transform("sum").to_dict()["val"] == [9, 6, 9, 6, 9, None]
    assert f.groupby("cat").filter(F.count("*") > 2).to_dict()["val"] == [1, 3, 5]
    assert {r.cat: r.val for r in f.groupby("cat")["val"].last().df.collect()} == {"a": 5, "b": 4}
    with pytest.raises(KeyError):
        f.groupby("none").sum()


def test_joins(spark):
    left = Frame(literals.frame(spark, {"key": [1, 2, 3, None], "val": [10, 20, 30, 40]}))
    right = Frame(literals.frame(spark, {"key": [2, 3, 4, None], "val": [200, 300, 400, 500]}))
    for how, n in {"inner": 2, "left": 4, "right": 4, "outer": 6}.items():
        out = left.merge(right, on="key", how=how)
        assert out.columns == ["key", "val_x", "val_y"]
        assert len(out) == n
    with pytest.raises(ValueError):
        left.merge(right, on="key", how="cross")
    with pytest.raises(TypeError):
        left.merge(right)
    with pytest.raises(TypeError):
        left.merge(Frame(literals.frame(spark, {"key": ["1"]})), on="key")
    with pytest.raises(KeyError):
        left.merge(right, on="none")


def test_positional_join_checks_lengths(make):
    a, b = make({"x": [1, 2]}), make({"x": [3, 4]})
    assert a.join(b).columns == ["i_0", "x_0", "i_1", "x_1"]
    with pytest.raises(Exception, match="unequal"):
        a.join(make({"x": [1]})).df.collect()


def test_sorting_nulls_and_nan(make):
    f = make({"v": [2.0, None, math.nan, 1.0]})
    assert [str(r["v"]) for r in f.sort_values("v").df.collect()] == ["1.0", "2.0", "nan", "None"]
    down = [r["v"] for r in f.sort_values("v", ascending=False).df.collect()]
    assert down[:2] == [2.0, 1.0]
    assert math.isnan(down[2])
    assert down[3] is None


def test_descending_ties_come_backwards(make):
    f = make({"v": [1, 2, 2]})
    assert [r["i"] for r in f.sort_values("v", ascending=False).df.collect()] == [2, 1, 0]
    assert [r["i"] for r in f.nlargest(2, "v").df.collect()] == [2, 1]
    assert [r["i"] for r in f.nsmallest(3, "v").df.collect()] == [0, 1, 2]


def test_duplicates(make):
    f = make({"a": [1, 2, 1], "b": [10, 20, 99]})
    assert sorted(f.drop_duplicates("a").to_dict()["b"]) == [10, 20]
    assert sorted(f.drop_duplicates("a", keep="last").to_dict()["b"]) == [20, 99]
    assert sorted(f.drop_duplicates("a", keep=False).to_dict()["b"]) == [20]
    assert f.duplicated("a").tolist() == [False, False, True]


def test_rank(make):
    v = make({"v": [3, 1, 4, 1, 5, None]})["v"]
    assert v.rank().tolist() == [3, 1.5, 4, 1.5, 5, None]
    assert v.rank("dense").tolist() == [2, 1, 3, 1, 4, None]
    assert v.rank("first").tolist() == [3, 1, 4, 2, 5, None]
    assert v.rank("max").tolist() == [3, 2, 4, 2, 5, None]
    assert v.rank("min", ascending=False).tolist() == [3, 4, 2, 4, 1, None]
    with pytest.raises(TypeError):
        make({"v": ["a"]})["v"].rank()


def test_changes(make):
    assert make({"v": [0, 5, 10]})["v"].pct_change().tolist() == [None, None, 1.0]
    assert make({"v": [10**16, 10**16 + 1]})["v"].diff().tolist() == [None, 1]
    assert make({"v": [1, 4, 9]})["v"].diff(-1).tolist() == [3, 5, None]
    assert make({"v": [1, None, 3]})["v"].cumsum().tolist() == [1, None, 4]
    assert make({"v": [2, None, 3]})["v"].cumprod().tolist() == [2, None, 6]
    assert make({"v": [1, 2]})["v"].shift(1, 0).tolist() == [0, 1]
    assert make({"v": [1.0, None, 3.0, 5.0]})["v"].rolling(2).mean().tolist() == [None, 1.0, 3.0, 4.0]
    assert make({"v": [None, 2.0, None]})["v"].expanding().sum().tolist() == [0.0, 2.0, 2.0]


def test_nulls_in_aggregates(make):
    f = make({"v": [1.0, None, math.nan], "e": [None, None, None]})
    assert math.isnan(f["v"].sum())
    assert f["v"].max() == f["v"].min() == f["v"].median() == 1.0
    assert f["v"].count() == 2
    assert f["e"].sum() is None
    assert make({"v": [5]})["v"].std() is None
    assert f["v"].isna().tolist() == [False, True, False]


def test_axis_one_skips_texts(make):
    f = make({"a": [1, 2, 3], "b": ["x", "y", "z"], "c": [4, 5, 6]})
    assert Frame(f[["a", "b", "c"]].df).sum(axis=1).tolist() == [5, 7, 9]


def test_arithmetic_rules(make):
    f = make({"a": [1, 2], "s": ["x", "y"], "x": [1.5, -2.0]})
    assert (f["a"] + 2.0).kind == "int64"
    assert (f["a"] * f["x"]).tolist() == [1.5, -4.0]
    assert (f["x"] / 0).tolist() == [math.inf, -math.inf]
    assert (10 - f["a"]).tolist() == [9, 8]
    for bad in (lambda: f["s"] + 1, lambda: f["s"] > 1, lambda: f["a"] + "x"):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        (f["a"] / (f["a"] - f["a"])).tolist()


def test_logic_takes_null_as_false(make):
    f = make({"a": [True, None, False]})
    assert (~f["a"]).tolist() == [False, True, True]
    assert (f["a"] & f["a"]).tolist() == [True, False, False]
    assert f["a"].any() is True
    assert f["a"].all() is False


def test_casts(make):
    f = make({"x": [4.0, 1.5, 1e8], "t": ["true", "0", "False"], "b": [True, False, None]})
    assert f["x"].astype(str).tolist() == ["4", "1.5", "100000000"]
    assert f["t"].astype(bool).tolist() == [True, False, False]
    assert f["b"].astype("str").tolist() == ["True", "False", None]
    assert f["x"].astype(int).tolist() == [4, 1, 100000000]
    with pytest.raises(TypeError):
        f["x"].astype(bool)
    with pytest.raises(Exception, match="not a bool"):
        make({"t": ["maybe"]})["t"].astype(bool).tolist()
    assert fw.to_numeric(make({"t": ["1", "2.5"]})["t"]).tolist() == [1.0, 2.5]


def test_fill_and_round(make):
    f = make({"x": [None, 2.5, -2.5], "n": [1, None, 3]})
    assert f["x"].fillna(0).tolist() == [0.0, 2.5, -2.5]
    assert f["x"].round().tolist() == [None, 3.0, -3.0]
    assert f["n"].fillna(0.5).tolist() == [1.0, 0.5, 3.0]
    assert f["x"].clip(-1, 1).tolist() == [None, 1.0, -1.0]
    with pytest.raises(TypeError):
        f["x"].fillna("a")


def test_positions(make):
    f = make({"a": [10, 20, 30, 40, 50]})
    assert f.iloc(-1)["a"] == 50
    assert f.iloc(slice(None, None, -2)).df.select("a").toPandas().a.tolist() == [50, 30, 10]
    assert f.loc(slice(1, 2)).to_dict()["a"] == [20, 30]
    assert [r.a for r in f.iloc([2, 0, 2]).df.collect()] == [30, 10, 30]
    assert f.head(-3).to_dict()["a"] == [10, 20]
    assert f.tail(2).to_dict()["a"] == [40, 50]
    assert f["a"].idxmax() == 4
    assert f.set_at(0, {"a": 11}).to_dict()["a"][0] == 11
    with pytest.raises(IndexError):
        f.iloc(9)


@pytest.mark.parametrize("op", ["//", "%", "**", "/"])
def test_query_operators_equal_pythons(make, op):
    values = [(a, b) for a in (-7, -3, 0, 2, 7) for b in (-3, -2, 0, 1, 3)] + [(1.0, 0.1), (-2.5, 2.0), (1e200, 2.0), (None, 2.0), (2.0, None)]
    for kind in (int, float):
        rows = [(a, b) for a, b in values if {type(a), type(b)} <= {kind, type(None)}]
        f = make({"i": list(range(len(rows))), "a": [x for x, _ in rows], "b": [y for _, y in rows]}, order="i")
        for bound in (-2, 0, 1, 5):
            wanted = []
            for i, (a, b) in enumerate(rows):
                try:
                    wanted += [i] if eval(f"a {op} b >= {bound}") else []
                except Exception:
                    pass
            assert f.query(f"a {op} b >= {bound}").to_dict()["i"] == wanted, (kind, bound)


def test_query_rejects_code(make):
    f = make({"a": [1, 2, 3]})
    assert f.query("a > 1 and not a == 3").to_dict()["a"] == [2]
    for bad in ("__import__('os')", "a.real > 1", "[x for x in a]"):
        with pytest.raises(ValueError):
            f.query(bad)
    with pytest.raises(KeyError):
        f.query("zz > 1")


def test_reshaping(make):
    f = make({"a": [1, 2], "x": [0.5, None]})
    assert len(f.melt("i")) == 4
    assert f.transpose().to_dict("records")[0] == {"column": "a", "0": 1.0, "1": 2.0}
    e = make({"l": [[1, 2], [], None]}).explode("l")
    assert sorted(e.df.select("l").toPandas().l.fillna(-1).tolist()) == [-1, 1, 2]
    c = fw.concat([f, make({"a": [3.5]})])
    assert c.dtypes["a"] == "float64"
    with pytest.raises(TypeError):
        make({"a": [1], "s": ["x"]}).melt("i")


def test_texts(make):
    s = make({"s": ["  It's a-b ", None, "x1y"]})["s"]
    assert s.str.strip().tolist() == ["It's a-b", None, "x1y"]
    assert s.str.title().tolist() == ["  It'S A-B ", None, "X1Y"]
    assert s.str.contains("a-").tolist() == [True, False, False]
    assert s.str.slice(-3, None).tolist() == ["-b ", None, "x1y"]
    assert s.str.center(6, "*").tolist()[2] == "x1y".center(6, "*")
    assert make({"s": ["x"]})["s"].str.center(4, "*").tolist() == ["x".center(4, "*")]
    assert make({"s": ["a", None, "b"]})["s"].str.cat("-") == "a-b"
    assert make({"s": ["a,b", ""]})["s"].str.split(",").tolist() == [["a", "b"], [""]]
    assert make({"s": ["", " a  b"]})["s"].str.split().tolist() == [[], ["a", "b"]]
    with pytest.raises(NotImplementedError):
        s.str.encode("utf-8")


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('name,age,score,ok,none,mix\nalice,30,1.5,true,NA,1\n"b, ""o""",25,inf,false,,x\ncarol,NA,2.0,,null,3\n')
    df = csv.read_csv(spark, str(p))
    assert [t for _, t in df.dtypes] == ["string", "bigint", "double", "boolean", "string", "string"]
    rows = df.collect()
    assert rows[1].name == 'b, "o"'
    assert rows[2].age is None
    assert csv.read_csv(spark, str(p), columns=["age"], dtypes={"age": "float"}).dtypes == [("age", "double")]
    with pytest.raises(KeyError):
        csv.read_csv(spark, str(p), columns=["zz"])
    assert csv.to_csv_string(literals.frame(spark, {"a": [4.0, None], "b": [True, False]})) == "a,b\n4,true\n,false\n"
    csv.write_csv(df.drop("none"), str(tmp_path / "out"))
    assert csv.read_csv(spark, str(tmp_path / "out")).count() == 3


def test_workflow_clean(make):
    f = make({"name": ["Alice", None, "Charlie", "Dave"], "score": [90, 85, None, 70]})
    out = f.dropna().rename({"name": "student"}).sort_values("score", ascending=False)
    assert [r.student for r in out.df.collect()] == ["Alice", "Dave"]


def test_streaming_frames_take_row_wise_operators(spark, tmp_path):
    from framewright.operators import grouping, select

    path = str(tmp_path / "in")
    literals.frame(spark, {"k": ["a", "b", "a"], "v": [1, 2, 3]}).write.parquet(path)
    stream = spark.readStream.schema("k string, v long").parquet(path)
    out = grouping.aggregate(select.assign(stream, v=F.col("v") * 2), "k", "sum")
    q = out.writeStream.format("memory").queryName("sums").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k: r.v for r in spark.table("sums").collect()} == {"a": 8, "b": 4}


def test_the_entry_imports_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)


def test_front_door(spark):
    import framewright.api as api

    f = api.DataFrame([{"k": "a", "v": 1}, {"k": "b", "v": 2}], order="k")
    api.assert_frame_equal(f, api.from_dict({"k": ["a", "b"], "v": [1, 2]}, order="k"))
    api.assert_series_equal(api.series([1, 2, 3]) * 2, api.series([2, 4, 6]))
    assert api.series([3, 1, 2]).sort_values().to_frame().columns == ["0"]
    assert api.isna(None)
    assert api.isna(float("nan"))
    assert api.notna(0)
    assert len(api.melt(f, id_vars=["k"])) == 2
    with pytest.raises(AssertionError):
        api.assert_frame_equal(f, f.assign(v=F.lit(5).cast("long")))
    with pytest.raises(ValueError, match="order"):
        Frame(spark.range(3)).head()
