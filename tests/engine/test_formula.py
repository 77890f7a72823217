import pytest

from fathomlake.plans.formula import Call, Leaf, batches, parse
from fathomlake.plans.operator import find, known


@pytest.mark.parametrize("text", ["a", "(a/b)", "abs((a/b))", "log(a)", "date_diff(a,b)", "date_per(a,date_diff(b,c))", "mean(a,b,c,d,e)",
    "roll_3D_mean(a,b)", "roll_3D_mean_offset_1D(a,b)", "((a+b)*(c-d))", "GroupByThenMin(min(x,y),g)", "vol_ratio_2D_to_7D(d,g,v)",
    "date_diff_Y_18_23_count(a,b)", "date_diff_Y_60_plusinf_count_norm(a,b)", "date_diff_D_minusinf_7_mean(a,b)", "cross_add_offset_2D(d,k,v)",
    "outlier_dist_1(emb(x))", "onnx_score(a,b)", "catboost_p(a)", "ewma_vol_3(d,v)", "trend_coef_offset_1D(d,v)", "roll_2H_norm_mean(d,v)"])
def test_printing_gives_what_was_read(text):
    assert parse(text).formula() == text


@pytest.mark.parametrize("text", ["unsupported(a,b)", "(a,b)", "a/b", "(a/b", "abs()", "", "abs(a)b", "a b(c)"])
def test_what_is_no_formula_is_refused(text):
    with pytest.raises(ValueError):
        parse(text)


def test_registry():
    assert find("+").alias == find("add").alias == "add"
    assert type(find("date_diff_type2")).__name__ == "DateDiffType2" and type(find("date_diff_type1")).__name__ == "DateDiff"
    op = find("date_diff_Y_18_23_count")
    assert (op.diff_unit, op.lower_bound, op.upper_bound, op.aggregation, op.normalize) == ("Y", 18, 23, "count", None)
    roll = find("roll_3d_mean")
    assert (roll.window_size, roll.window_unit, roll.aggregation) == (3, "d", "mean")
    assert find("GroupByThenMin").agg == "Min" and type(find("GroupByThenRank")).__name__ == "GroupByThenRank"
    assert find("nothing") is None and find("roll_1W_mean" if False else "nope_1D") is None
    assert len(known()) == 51
    with pytest.raises(ValueError):
        find("roll_1W_mean")


def test_names_and_hashes():
    assert parse("(a/b)").display_name() == "f_a_f_b_autofe_div"
    assert parse("abs(norm(b))").display_name() == "f_b_autofe_norm_abs"
    assert parse("GroupByThenMin(a,b)").display_name(shorten=True) == "f_autofe_groupbythenmin"
    assert parse("lag_1D(d,roll_3D_mean(d,v))").display_name() == "f_d_f_v_autofe_roll_3d_mean_lag_1d"
    assert parse("(a/b)").pretty() == "a / b" and parse("mean(a,b)").pretty() == "mean(a, b)"
    f = parse("(a/b)")
    assert len(f.digest()) == 10 and f.digest() != parse("(b/a)").digest() and f.digest() == parse("(a/b)").digest()
    assert f.rename({"a": "x"}).formula() == "(x/b)"
    assert parse("abs((a/b))").operator_names() == {"abs", "/"}
    assert parse("(min(a,b)/a)").columns() == ["a", "b"]


def test_parameters():
    norm1, norm2 = parse("norm(a)").set_params({"norm": "1"}), parse("norm(b)").set_params({"norm": "2"})
    f = Call(find("/"), [norm1, Call(find("abs"), [norm2])])
    first, second = "f_a_autofe_norm_norm", "f_b_autofe_norm_abs_f_b_autofe_norm_norm"
    assert f.get_params() == {first: "1.0", second: "2.0", "alias": "div"}
    f.set_params({"norm": "3"})
    assert [x.op.norm for x in (norm1, norm2)] == [3, 3]
    f.set_params({first: "4", second: "5", "alias": "div"})
    assert [x.op.norm for x in (norm1, norm2)] == [4, 5] and norm1.op.alias is None
    f.rename_params({"f_a_": "f_z_"})
    assert "f_z_autofe_norm_norm" in f.get_params()


@pytest.mark.parametrize("text", ["roll_3D_mean_offset_2H(d,v)", "date_diff_Y_0_18_count_norm(a,b)", "vol_ratio_2D_to_7D(d,v)", "delta2_3H(d,v)", "GroupByThenStd(a,b)"])
def test_parameters_make_the_same_operator_again(text):
    op = parse(text).op
    again = type(op)(**{k: v for k, v in op.get_params().items() if k != "alias"})
    assert again.formula() == op.formula()


def test_batches_are_consecutive_features_of_one_operator_and_key():
    nodes = [parse(t) for t in ("GroupByThenMin(a,k)", "GroupByThenMin(b,k)", "GroupByThenMin(a,j)", "freq(a)", "GroupByThenMin(c,k)")]
    assert [len(b) for b in batches(nodes)] == [2, 1, 1, 1]


def test_types():
    types = {"a": "bigint", "b": "double"}
    assert parse("(a/b)").result_type(types) == "float" and parse("(a+b)").result_type(types) == "bigint" and Leaf("b").result_type(types) == "double"
