"""Series across frames, windows beside their frame, indexers with setters and the hidden order of literal frames."""

import pytest
from pyspark.errors import PySparkException

import framewright.api as api
from framewright.plans.frame import Frame
from framewright.sources import csv, literals


def frame(data, order=None):
    return api.DataFrame(data, order=order)


def test_series_of_two_frames(spark):
    a, b = api.series([1, 2, 3], "a"), api.series([10, 20, 30], "b")
    assert (a + b).tolist() == [11, 22, 33]
    assert (b - a).tolist() == [9, 18, 27]
    assert (a == api.series([1, 0, 3], "a")).tolist() == [True, False, True]
    assert ((a > 1) & (b < 30)).tolist() == [False, True, False]
    assert a.where(b > 10, b).tolist() == [10, 2, 3]
    assert a.corr(b) == pytest.approx(1.0)
    f, g = frame({"a": [1, 2, 3]}), frame({"a": [10, 20, 30]})
    assert (f["a"] + g["a"]).tolist() == [11, 22, 33]
    assert f.assign(b=g["a"]).to_dict() == {"a": [1, 2, 3], "b": [10, 20, 30]}
    assert f[g["a"] > 10].to_dict() == {"a": [2, 3]}
    assert (f.assign(a=f["a"] * 100)["a"] - f["a"]).tolist() == [99, 198, 297]


def test_series_of_unequal_length_raise(spark):
    with pytest.raises(PySparkException, match="partner"):
        (api.series([1, 2, 3]) + api.series([1, 2])).tolist()
    with pytest.raises(PySparkException, match="partner"):
        (frame({"a": [1, 2, 3]}) + frame({"a": [1]})).to_dict()


def test_order_keys_join_and_repeated_or_null_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (2, 4)], "k long, v long")
    f, g = Frame(df, "k"), Frame(df.repartition(3), "k")
    assert sorted((f["v"] + g["v"] * 0).tolist()) == [1, 2, 3, 4]
    assert f.equals(g)
    assert not f.equals(Frame(df.where("v < 4"), "k"))


def test_windows_stay_beside_their_frame(spark):
    f = frame({"v": [3, 1, 4, 1, 5]})
    assert (f["v"] - f["v"].shift()).tolist() == [None, -2, 3, -3, 4]
    assert (f["v"].cumsum() - f["v"].shift(fill_value=0)).tolist() == [3, 1, 7, 5, 13]
    assert f["v"].cumsum().diff().tolist() == [None, 1, 4, 1, 5]
    assert f.assign(c=f["v"].cumsum(), r=lambda x: x["c"].rank()).to_dict() == {"v": [3, 1, 4, 1, 5], "c": [3, 4, 8, 9, 14], "r": [1.0, 2.0, 3.0, 4.0, 5.0]}
    assert f[f["v"].diff() > 0].to_dict() == {"v": [4, 5]}
    assert f[f.duplicated("v")].to_dict() == {"v": [1]}
    assert f["v"].rolling(2).sum().tolist() == [None, 4, 5, 5, 6]
    assert f[f["v"].rolling(2).mean() > 2].to_dict() == {"v": [4, 1, 5][:2] + [5]}
    assert f["v"][f["v"] > 1].tolist() == [3, 4, 5]
    assert f["v"].drop_duplicates().tolist() == [3, 1, 4, 5]
    assert (f["v"] + 1).expanding().max().tolist() == [4, 4, 5, 5, 6]


def test_setting_columns(spark):
    f = frame({"a": [1, 2, 3]})
    old = f["a"]
    f["b"] = f["a"] * 2
    f["c"] = [7, 8, 9]
    f["d"] = "x"
    f["a"] = f["a"] + f["c"].cumsum()
    assert f.to_dict() == {"a": [8, 17, 27], "b": [2, 4, 6], "c": [7, 8, 9], "d": ["x", "x", "x"]}
    assert old.tolist() == [1, 2, 3]
    assert f.columns == ["a", "b", "c", "d"]


def test_iloc_and_loc(spark):
    f = frame({"a": [1, 2, 3, 4], "b": ["w", "x", "y", "z"]})
    assert f.iloc[0] == {"a": 1, "b": "w"}
    assert f.iloc[-1] == {"a": 4, "b": "z"}
    assert f.iloc[1, 1] == "x"
    assert f.iloc[1, [0]] == {"a": 2}
    assert f.iloc[1:3].to_dict() == {"a": [2, 3], "b": ["x", "y"]}
    assert f.iloc[::-1].to_dict()["a"] == [4, 3, 2, 1]
    assert f.iloc[[3, 0]].to_dict()["a"] == [4, 1]
    assert f.iloc[1:, 0].tolist() == [2, 3, 4]
    assert f.iloc[:2, :1].to_dict() == {"a": [1, 2]}
    assert f.loc[1:2].to_dict()["a"] == [2, 3]
    assert f.loc[2, "b"] == "y"
    assert f.loc[f["a"] > 2, "b"].tolist() == ["y", "z"]
    assert f.loc[[True, False, False, True]].to_dict()["a"] == [1, 4]
    assert f.loc[:, ["b"]].to_dict() == {"b": ["w", "x", "y", "z"]}
    assert f[[True, False, True, False]].to_dict()["a"] == [1, 3]
    assert f["a"].iloc[2] == 3
    assert f["a"].iloc[[3, 1]].tolist() == [4, 2]
    assert f["a"].loc[0:1].tolist() == [1, 2]
    with pytest.raises(IndexError):
        f.iloc[9]
    with pytest.raises(TypeError):
        f.iloc["a"]


def test_setting_cells(spark):
    f = frame({"a": [1, 2, 3], "b": ["x", "y", "z"]})
    f.iloc[0, 0] = 10
    f.iloc[-1, "b"] = "last"
    f.loc[1] = {"a": 20, "b": "one"}
    f.loc[f["a"] > 10, "b"] = "big"
    assert f.to_dict() == {"a": [10, 20, 3], "b": ["x", "big", "last"]}
    with pytest.raises(KeyError):
        f.loc[0, "none"] = 1


def test_hidden_order_of_values(spark):
    f = frame({"a": [3, 1, 2], "b": [1.0, None, 2.0]})
    assert f.columns == ["a", "b"]
    assert f.shape == (3, 2)
    assert f.head(2).to_dict()["a"] == [3, 1]
    assert f.tail(1).to_dict()["a"] == [2]
    assert f.sum() == {"a": 6, "b": 3.0}
    assert f.rename({"a": "x"}).add_prefix("p_").columns == ["p_x", "p_b"]
    assert f[["b"]].fillna(0.0).head(2).to_dict() == {"b": [1.0, 0.0]}
    assert f.isna().to_dict()["b"] == [False, True, False]
    assert (f * 2).to_dict()["a"] == [6, 2, 4]
    assert f.groupby("a").sum().df.columns == ["a", "b"]
    assert f.groupby("a").first().df.columns == ["a", "b"]
    assert f.groupby("a").transform("sum").columns == ["a", "b"]
    assert f.cumsum().to_dict() == {"a": [3, 4, 6], "b": [1.0, None, 3.0]}
    assert f.drop("a").columns == f.select_dtypes("float").columns == ["b"]
    assert f.astype({"a": "float"}).dtypes == {"a": "float64", "b": "float64"}
    assert api.concat([f, f], axis=1).columns == ["a_0", "b_0", "a_1", "b_1"]
    assert f.equals(frame({"a": [3, 1, 2], "b": [1.0, None, 2.0]}))
    assert not f.equals(frame({"a": [1, 3, 2], "b": [None, 1.0, 2.0]}))
    assert frame({"a": [1, 1]}).drop_duplicates().to_dict() == {"a": [1]}
    assert f["a"].reset_index().to_dict() == {"index": [0, 1, 2], "a": [3, 1, 2]}


def test_a_sort_is_the_order_of_what_follows(spark):
    f = frame({"a": [3, None, 2, 3], "b": ["w", "x", "y", "z"]})
    assert f.sort_values("a").to_dict()["b"] == ["y", "w", "z", "x"]
    assert f.sort_values("a", ascending=False).head(2).to_dict()["b"] == ["z", "w"]
    assert f.sort_values("a").iloc[-1]["b"] == "x"
    assert f.sort_values("a")[["b"]].tail(2).to_dict()["b"] == ["z", "x"]
    assert f.sort_values("b", ascending=False)["a"].cumsum().tolist() == [3, 5, None, 8]
    assert f.nlargest(2, "a").to_dict()["b"] == ["z", "w"]
    assert f["b"].sort_values(ascending=False).head(2).tolist() == ["z", "y"]
    plan = f.sort_values("a").df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_negative_heads_and_tails_with_repeated_or_null_keys(spark):
    for keys in ([1, 1, 1, 2, 2], [None, None, 1, 1, None]):
        f = Frame(literals.frame(spark, {"k": keys, "v": [1, 2, 3, 4, 5]}), "k")
        assert len(f.head(-1)) == len(f.tail(-1)) == 4
        assert len(f.head(-2)) == 3
        assert len(f.tail(-9)) == 0


def test_frame_conditions_and_operands(spark):
    f, g = frame({"a": [1, 5], "b": [2, 2]}), frame({"a": [1, 4], "b": [3, 1]})
    assert f.eq(g).to_dict() == {"a": [True, False], "b": [False, False]}
    assert (f > g).to_dict() == {"a": [False, True], "b": [False, True]}
    assert f.where(f > g, 0).to_dict() == {"a": [0, 5], "b": [0, 2]}
    assert f.mask([True, False], 9).to_dict() == {"a": [9, 5], "b": [9, 2]}
    assert (f + g).to_dict() == {"a": [2, 9], "b": [5, 3]}
    with pytest.raises(KeyError):
        f + frame({"a": [1, 2]})


def test_to_numeric(spark):
    assert api.to_numeric(["1", 2, None]) == [1.0, 2.0, None]
    assert api.to_numeric(["1", "x"], errors="coerce") == [1.0, None]
    assert api.to_numeric(api.series(["1", "x"]), errors="coerce").tolist() == [1.0, None]
    with pytest.raises(ValueError):
        api.to_numeric(["x"])


def test_texts_with_a_final_line_break(spark):
    s = api.series(["abc\n", "abc", "12\n", "12"])
    assert s.str.isalpha().tolist() == [False, True, False, False]
    assert s.str.isalnum().tolist() == [False, True, False, True]
    assert s.str.isdigit().tolist() == s.str.isnumeric().tolist() == [False, False, False, True]


def test_text_of_great_fractions(spark):
    assert api.series([1e40, 1e38, -2.5e20, 1e17, 0.5]).astype("str").tolist() == ["1" + "0" * 40, "1" + "0" * 38, "-250000000000000000000", "1" + "0" * 17, "0.5"]


def test_csv_line_breaks_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc,d'), (2, "plain")], "k long, t string")
    csv.write_csv(df, f"{tmp_path}/x")
    assert sorted(map(tuple, csv.read_csv(spark, f"{tmp_path}/x").collect())) == [(1, 'a "b"\nc,d'), (2, "plain")]


def test_wrap_and_normalize(spark):
    s = api.series(["one two three", None, "e\u0301", ""])
    assert s.str.wrap(7).tolist() == ["one two\nthree", None, "e\u0301", ""]
    assert s.str.normalize("NFC").tolist()[2] == "\u00e9"


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from framewright.session import scratch

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", applicationId="app")
    with pytest.raises(ValueError, match="checkpoint"):
        scratch(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context), "x")
