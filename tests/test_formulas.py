import math

import pytest

from foliospark.functions import aggregate, scalar
from foliospark.plans.compile import aggregate_formulas, truth, with_formulas, with_references, with_truth
from foliospark.plans.syntax import FormulaError, format_cell, parse, parse_cell

CASES = [
    ("1+2*3", 7), ("-2^2", 4), ("2^3^2", 512), ("10%+1", 1.1), ('"a"&1&TRUE', "a1TRUE"), ("1/0", "#DIV/0!"), ('"abc"+1', "#VALUE!"), ('" 5 "*2', 10),
    ("1=1", True), ('"A"="a"', True), ('2<"1"', True), ('"z"<TRUE', True), ("1<>2", True), ("0.1+0.2&\"\"", "0.30000000000000004"), ("1E21&\"\"", "1e+21"),
    ("100000000000000000000&\"\"", "100000000000000000000"), ("1E-7&\"\"", "1e-7"), ("0.00001&\"\"", "0.00001"), ("5&\"\"", "5"), ('"0x1F"+0', 31),
    ("ROUND(1.005,2)", 1.0), ("ROUND(-2.5,0)", -3), ("ROUNDUP(-1.1,0)", -2), ("ROUNDDOWN(1.99,1)", 1.9), ("TRUNC(-1.9)", -1), ("INT(-1.5)", -2), ("MOD(7,-3)", -2), ("MOD(1,0)", "#DIV/0!"),
    ("CEILING(2.5,1)", 3), ("CEILING(-2.5,1)", "#NUM!"), ("FLOOR(2.5,1)", 2), ("MROUND(7,3)", 6), ("EVEN(-1)", -2), ("ODD(2)", 3), ("GCD(12,18,8)", 2), ("LCM(4,6)", 12), ("QUOTIENT(-7,2)", -3),
    ("SQRT(-1)", "#NUM!"), ("LN(0)", "#NUM!"), ("LOG(8,2)", 3), ("LOG(8,1)", "#NUM!"), ("FACT(5)", 120), ("FACT(171)", "#NUM!"), ("COMBIN(5,2)", 10), ("PERMUT(5,2)", 20), ("ATAN2(0,0)", "#NUM!"), ("ATAN2(1,1)", math.pi / 4), ("DEGREES(PI())", 180), ("SQRTPI(1)", math.sqrt(math.pi)), ("ASIN(2)", "#NUM!"), ("SIGN(-3)", -1), ("POWER(2,10)", 1024), ("EXP(0)", 1), ("SUMSQ(3,4)", 25),
    ("LEN(\"a😀\")", 3), ("LEFT(\"abc\")", "a"), ("LEFT(\"abc\",-1)", "#VALUE!"), ("RIGHT(\"abc\",2)", "bc"), ("MID(\"hello\",2,3)", "ell"), ("MID(\"a\",0,1)", "#VALUE!"), ("PROPER(\"o'neil 2nd\")", "O'Neil 2Nd"), ("TRIM(\"  a   b \")", "a b"), ("SUBSTITUTE(\"aXbXc\",\"X\",\"-\",2)", "aXb-c"), ("SUBSTITUTE(\"aXb\",\"X\",\"-\",5)", "aXb"), ("REPLACE(\"abcdef\",2,3,\"*\")", "a*ef"), ("REPT(\"ab\",3)", "ababab"), ("SEARCH(\"B\",\"abc\")", 2), ("FIND(\"B\",\"abc\")", "#VALUE!"), ("EXACT(\"a\",\"A\")", False), ("CHAR(65)", "A"), ("CHAR(0)", "#VALUE!"), ("CODE(\"A\")", 65), ("UNICHAR(128512)", "😀"), ("UNICODE(\"😀\")", 128512), ("CLEAN(\"a\"&CHAR(7)&\"b\")", "ab"), ("T(1)", ""), ("VALUE(\"1.5\")", 1.5), ("VALUE(\"5d\")", "#VALUE!"), ("CONCATENATE(\"a\",1,TRUE)", "a1TRUE"), ("TEXTJOIN(\"-\",TRUE,\"a\",\"\",\"b\")", "a-b"), ("TEXTJOIN(\"-\",FALSE,\"a\",\"\",\"b\")", "a--b"), ("CONCAT(\"a\",\"b\")", "ab"), ("LOWER(\"ÀB\")", "àb"), ("UPPER(\"é\")", "É"),
    ("IF(1,\"y\",\"n\")", "y"), ("IF(0,1)", False), ("IFS(FALSE,1)", "#N/A"), ("IFERROR(1/0,\"bad\")", "bad"), ("IFNA(NA(),3)", 3), ("IFNA(1/0,3)", "#DIV/0!"), ("SWITCH(3,1,\"one\",3,\"three\",\"no\")", "three"), ("SWITCH(\"B\",\"b\",1)", 1), ("SWITCH(9,1,2)", "#N/A"), ("CHOOSE(2,\"a\",\"b\")", "b"), ("CHOOSE(3,\"a\")", "#VALUE!"), ("AND(TRUE,1)", True), ("OR(FALSE,0)", False), ("XOR(TRUE,TRUE)", False), ("NOT(0)", True), ("TRUE()", True), ("ISNUMBER(1)", True), ("ISTEXT(1)", False), ("ISERROR(1/0)", True), ("ISERR(NA())", False), ("ISNA(NA())", True), ("ISLOGICAL(TRUE)", True), ("ISNONTEXT(1)", True), ("ISEVEN(-2)", True), ("ISODD(2.5)", False), ("N(TRUE)", 1), ("N(\"a\")", 0), ("TYPE(\"a\")", 2), ("TYPE(1/0)", 16), ("ERROR.TYPE(NA())", 7), ("ERROR.TYPE(1)", "#N/A"),
    ("DATE(2024,2,30)", 45352), ("DATE(24,1,1)", 8767), ("DATE(1800,1,1)", "#NUM!"), ("YEAR(45352)", 2024), ("MONTH(45352)", 3), ("DAY(45352.9)", 1), ("WEEKDAY(45352)", 6), ("WEEKDAY(45352,2)", 5), ("WEEKDAY(45352,9)", "#NUM!"), ("EDATE(45322,1)", 45351), ("EOMONTH(45322,1)", 45351), ("DAYS(45352,45322)", 30), ("HOUR(0.75)", 18), ("MINUTE(0.5+1/1440)", 1), ("SECOND(1/86400)", 1), ("TIME(25,0,0)*24", 1), ("WEEKNUM(45657)", 53), ("WEEKNUM(45657,21)", 1), ("ISOWEEKNUM(44927)", 52), ("NOW()", 45000.5), ("TODAY()", 45000), ("YEAR(-1)", "#NUM!"),
    ("SUM(1,TRUE,\"x\")", 2), ("AVERAGE(1,2)", 1.5), ("MIN(3,1)", 1), ("MAX(3,1)", 3), ("COUNT(1,\"a\",TRUE)", 1), ("COUNTA(1,\"a\")", 2), ("PRODUCT(2,3,4)", 24), ("MEDIAN(1,5,2,8)", 3.5), ("LARGE({3,9,4},2)", 4), ("SMALL({3,9,4},4)", "#NUM!"), ("MODE(3,1,3,1,2)", 3), ("MODE(1,2)", "#N/A"), ("STDEV(1,2,3,4)", 1.2909944487358056), ("STDEV(1)", "#DIV/0!"), ("STDEVP(1,3)", 1), ("VAR.P(1,3)", 1), ("VAR(1,3)", 2), ("AVEDEV(1,2,6)", 2), ("DEVSQ(1,3)", 2), ("GEOMEAN(1,4)", 2), ("GEOMEAN(0,4)", "#NUM!"), ("HARMEAN(1,1)", 1), ("QUARTILE({1,2,4,8},1)", 1.75), ("PERCENTILE({1,2,4,8},2)", "#NUM!"), ("AVERAGEA(1,TRUE,\"x\")", 2 / 3), ("MAXA(TRUE,0.5)", 1), ("MINA(2,\"x\")", 0),
    ("VLOOKUP(2.5,{1,\"a\";2,\"b\";3,\"c\"},2)", "b"), ("VLOOKUP(0,{1,\"a\";2,\"b\"},2)", "#N/A"), ("VLOOKUP(2,{1,\"a\";2,\"b\"},2,FALSE)", "b"), ("VLOOKUP(5,{1,\"a\"},2,FALSE)", "#N/A"), ("VLOOKUP(1,{1,\"a\"},3)", "#REF!"), ("HLOOKUP(2,{1,2;\"a\",\"b\"},2,FALSE)", "b"), ("MATCH(\"b\",{\"a\",\"b\"},0)", 2), ("MATCH(2.5,{1,2,3})", 2), ("MATCH(2.5,{3,2,1},-1)", 1), ("INDEX({1,2;3,4},2,1)", 3), ("INDEX({1,2},3,1)", "#REF!"),
    ("ROW(B3)", 3), ("COLUMN(B3)", 2), ("ROWS(A1:B3)", 3), ("COLUMNS(A1:B3)", 2), ("ISREF(A1)", True), ("FOO(1)", "#NAME?"), ("nothing", "#NAME?"), ("ABS()", "#VALUE!"), ("#REF!", "#REF!"),
]


def test_case_table(spark):
    row = with_formulas(spark.range(1), {f"c{k}": f for k, (f, _) in enumerate(CASES)}, now_serial=45000.5, errors=True).first()
    for k, (formula, want) in enumerate(CASES):
        value, error = row[f"c{k}"], row[f"c{k}_error"]
        if hasattr(value, "kind"):
            value = value[value.kind]
        got = error or value
        if isinstance(want, float):
            assert got == pytest.approx(want, rel=1e-12), formula
        else:
            assert got == want, formula


def test_long_texts_keep_their_tails(spark):
    """Only REPT and joins are limited to 32 767 characters."""
    long = "xYz" * 20000
    table = spark.createDataFrame([("b-c" + long,)], "t string")
    row = with_formulas(table, {"r": 'REPLACE(t,2,1,"*")', "s": 'SUBSTITUTE(t,"-","*",1)', "p": "PROPER(t)"}).first()
    assert (row.r, row.s) == ("b*c" + long, "b*c" + long)
    assert row.p == "B-C" + long.lower()


def test_every_function_name_is_known():
    known = set(aggregate.RANGE) | set(scalar.SCALAR) | {"ROW", "COLUMN", "ROWS", "COLUMNS", "ISREF", "VLOOKUP", "HLOOKUP"}
    assert len(known) >= 156


@pytest.mark.parametrize("bad", ["", "1+", "(1", "SUM(1", "{1,2;3}", "{1,A1}", '"open', "1 2", "(" * 80 + "1" + ")" * 80, "1" * 9000, "@"])
def test_bad_formulas(bad):
    with pytest.raises(FormulaError):
        parse(bad)


def test_addresses():
    for text, cell in (("A1", (0, 0)), ("$Z$9", (8, 25)), ("AA10", (9, 26)), ("XFD1", (0, 16383))):
        row, col, *_ = parse_cell(text)
        assert (row, col) == cell and format_cell(row, col) == text.replace("$", "")


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, 10.0, "Ab", True, "g"), (2, -3.5, "b*d", False, "g"), (3, None, None, None, "g"), (4, 7.0, "", True, "h"), (5, 10.0, "ab", None, "h")]
    return spark.createDataFrame(rows, "i int, x double, t string, b boolean, k string").repartition(3)


def test_ranges(table):
    formulas = {
        "s": "SUM(x)", "n": "COUNT(x)", "na": "COUNTA(t)", "cb": "COUNTBLANK(t)", "ci": 'COUNTIF(t,"ab")', "cw": 'COUNTIF(t,"?*")', "ce": 'COUNTIF(t,"b~*d")', "cn": 'COUNTIF(x,"<>10")', "nb": 'COUNTIF(t,"<>ab")', "gt": 'COUNTIF(t,">ab")', "cb2": "COUNTIF(b,TRUE)", "sp": "SUMPRODUCT(x,i)", "avg": 'AVERAGEIFS(x,i,">3",t,"a*")', "none": 'AVERAGEIF(t,"zzz",x)', "m": "MEDIAN(x)", "an": "AND(b)", "or": "OR(b)", "xo": "XOR(b)", "cat": "CONCAT(t)", "tj": 'TEXTJOIN("|",TRUE,t)', "ma": "MATCH(7,x,0)", "mw": 'MATCH("b*",t,0)', "ix": "INDEX(x,4)", "ir": "INDEX(x,9)", "mo": "MODE(x)", "rk": "RANK(7,x)", "la": "LARGE(x,2)", "pc": "PERCENTILE(x,0.5)", "aa": "AVERAGEA(b)", "mx": "MAX(x*i,100)", "er": "SUM(1/(i-1))",
    }
    row = aggregate_formulas(table, formulas, order="i", errors=True).first()
    want = {"s": 23.5, "n": 4, "na": 4, "cb": 2, "ci": 2, "cw": 3, "ce": 1, "cn": 2, "nb": 2, "gt": 2, "cb2": 2, "sp": 81, "avg": 10, "none": "#DIV/0!", "m": 8.5, "an": False, "or": True, "xo": False, "cat": "Abb*dab", "tj": "Ab|b*d|ab", "ma": 4, "mw": 2, "ir": "#REF!", "mo": 10, "rk": 3, "la": 10, "pc": 8.5, "aa": 2 / 3, "mx": 100, "er": "#DIV/0!"}
    for k, v in want.items():
        got = row[f"{k}_error"] or row[k]
        assert got == (pytest.approx(v) if isinstance(v, float) else v), k
    assert row.ix.num == 7.0


def test_groups_do_not_depend_on_partitioning(table):
    f = {"s": "SUM(x)", "c": 'COUNTIFS(b,TRUE,x,">0")'}
    want = {"g": (6.5, 1.0), "h": (17.0, 1.0)}
    for n in (1, 2, 5):
        got = aggregate_formulas(table.repartition(n), f, ["k"]).collect()
        assert {r.k: (r.s, r.c) for r in got} == want


def test_windows_and_rules(table):
    rows = with_formulas(table, {"share": "[@x]/SUM(x)", "rank": "RANK([@x],x)"}, ["k"]).orderBy("i").collect()
    assert rows[0].share == pytest.approx(10 / 6.5) and rows[3]["rank"] == 2
    hit = [r.i for r in table.where("true").select("i", truth(table, '=AND(x>5,t="AB")').alias("m")).where("m").orderBy("i").collect()]
    assert hit == [1, 5]
    above = with_truth(table, "=x>AVERAGE(x)", "m").where("m").orderBy("i").collect()
    assert [r.i for r in above] == [1, 4, 5]
    with pytest.raises(ValueError):
        truth(table, "=x>AVERAGE(x)")
    assert table.select(truth(table, "=1+(").alias("m")).where("m").count() == 0
    assert table.select(truth(table, "=1/0").alias("m")).where("m").count() == 0


def test_cells(spark):
    cells = spark.createDataFrame([(0, 0, "num", 1.0, None, None, None), (1, 0, "num", 2.0, None, None, None), (0, 1, "str", None, "k", None, None), (2, 2, "err", None, None, None, "#N/A"), (3, 0, "bool", None, None, True, None)], "row int, col int, kind string, num double, str string, bool boolean, err string")
    f = {"s": "SUM(A1:B5)", "one": "A1+1", "gone": "Z9&\"\"", "cb": "COUNTBLANK(A1:B2)", "e": "SUM(A1:C3)", "ci": 'COUNTIF(A1:B9,"k")', "tr": "COUNTIF(A1:A9,TRUE)", "nm": "rate*2"}
    row = aggregate_formulas(cells, f, names={"rate": "A2"}, errors=True).first()
    assert (row.s, row.one, row.gone, row.cb, row.e_error, row.ci, row.tr, row.nm) == (3, 2, "", 1, "#N/A", 1, 2, 4)


def test_frames_agree_with_small_groups(spark):
    """Percentiles, k-th values, modes and ranks of groups with ties, nulls and a null key."""
    import random
    import statistics

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(12))]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, x double, o int").repartition(3)
    f = {"m": "MEDIAN(x)", "p": "PERCENTILE(x,0.3)", "q": "QUARTILE(x,3)", "l": "LARGE(x,5)", "s": "SMALL(x,7)", "mo": "MODE(x)", "ad": "AVEDEV(x)", "two": "MEDIAN(x,o)", "far": "LARGE(x,999)"}
    got = {r.k: r for r in aggregate_formulas(df, f, ["k"], order="o", errors=True).collect()}
    for key in ("a", "b", None):
        own = [(x, o) for k, x, o in rows if k == key]
        xs = sorted(x for x, _ in own if x is not None)
        place = 0.3 * (len(xs) - 1)
        low = int(place)
        r = got[key]
        assert r.m == statistics.median(xs) and r.p == pytest.approx(xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (place - low))
        assert r.q == pytest.approx(statistics.quantiles(xs, n=4, method="inclusive")[2]) and (r.l, r.s) == (xs[-5], xs[6])
        most = max(xs.count(x) for x in xs)
        assert r.mo == next(x for x, _ in sorted(own, key=lambda r: r[1]) if x is not None and xs.count(x) == most)
        assert r.ad == pytest.approx(sum(abs(x - statistics.mean(xs)) for x in xs) / len(xs)) and r.far_error == "#NUM!"
        assert r.two == statistics.median([*xs, *(float(o) for _, o in own)])
    ranked = with_formulas(df, {"r": "RANK([@x],x)", "all": "SUM(x)"}, ["k"]).collect()
    assert len(ranked) == 300
    for r in ranked:
        xs = [x for k, x, _ in rows if k == r.k and x is not None]
        assert r.r == (None if r.x is None else 1 + sum(x > r.x for x in xs)) and r["all"] == sum(xs)
    whole = {r.o: r.r for r in with_formulas(df, {"r": "RANK([@x],x,1)"}).collect()}
    assert all(whole[o] == (None if x is None else 1 + sum(y < x for _, y, _ in rows if y is not None)) for _, x, o in rows)


def test_percentiles_of_large_groups_use_brackets(spark, monkeypatch):
    """Groups over the limit are cut down first; the result stays exact."""
    import numpy as np

    from foliospark.operators import statistics as st

    monkeypatch.setattr(st, "SMALL_GROUP", 1000)
    rng = np.random.default_rng(4)
    xs = np.concatenate([rng.normal(size=60_000), np.full(30_000, 0.25)])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").repartition(4)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9999, "e": 1.0}
    row = st.percentiles(df, "x", [], shares).first()
    assert [row[k] for k in shares] == pytest.approx([float(np.quantile(xs, p)) for p in shares.values()], rel=1e-12)


def test_texts_too_long_are_not_gathered(spark):
    df = spark.createDataFrame([("a", "x" * 20000, 1), ("a", "y" * 20000, 2), ("b", "q", 2), ("b", "p", 1), ("c", None, 1)], "k string, t string, o int")
    got = {r.k: (r.c, r.c_error, r.j) for r in aggregate_formulas(df, {"c": "CONCAT(t)", "j": 'TEXTJOIN("-",FALSE,"<",t)'}, ["k"], order="o", errors=True).collect()}
    assert got == {"a": (None, "#VALUE!", None), "b": ("pq", None, "<-p-q"), "c": ("", None, "<-")}


def test_moved_and_cross_sheet_references(spark):
    kinds = "sheet int, row int, col int, kind string, num double, str string, bool boolean, err string"
    cells = spark.createDataFrame([(0, 0, 0, "num", 3.0, None, None, None), (0, 1, 0, "num", 10.0, None, None, None), (0, 0, 1, "str", None, "hi", None, None), (1, 0, 0, "num", 7.0, None, None, None), (1, 1, 0, "err", None, None, None, "#N/A")], kinds)
    targets = spark.createDataFrame([(0, 0, 3), (0, 1, 3), (0, 5, 3)], "sheet int, row int, col int")
    f = {"a": "A1>5", "b": "$A$1=3", "c": "A1+other!A1", "d": "nowhere!A1", "e": "A1/SUM($A$1:$A$9)", "f": "ISBLANK(A1)", "g": "$B1"}
    out = {r.row: r for r in with_references(targets, cells, f, "D1", {"Other": 1}, errors=True).collect()}
    assert [out[k].a for k in (0, 1, 5)] == [False, True, False] and all(out[k].b for k in (0, 1, 5))
    assert out[0].c == 10 and out[1].c_error == "#N/A" and out[5].c == 0 and out[0].d_error == "#REF!"
    assert out[1].e == pytest.approx(10 / 13) and out[5].f and out[0].g.str == "hi"
    above = with_references(targets, cells, {"x": "A1"}, "D2", errors=True).where("row = 0").first()
    assert above.x_error == "#REF!"
    with pytest.raises(NotImplementedError):
        with_references(targets, cells, {"x": "SUM(A1:A2)"}, "D1")
