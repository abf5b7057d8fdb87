import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pharmalith.functions import nearest_cut, number_rows, number_text, r_ifelse, round_one, to_datetime, upper_names
from pharmalith.operators import (
    Dictionary, UnsupportedConversion, add_nominal_timepoints, create_demographics_table, detect_dataset_type, get_data_for_modelfit, get_data_for_nca, get_nominal_timepoints, get_route_from_data_column, modeling_to_modeling, modeling_to_nca, nca_to_modeling, reformat_data,
    impute_missing, sample_covariates, sample_covariates_bootstrap, sample_covariates_mice, sample_covariates_mvtnorm, sdtm_to_modeling,
)
from pharmalith.operators.nominal import bandwidth
from pharmalith.operators.sdtm import asof_strict, expand_doses
from pharmalith.sources import close, nm_data_timepoints, read_domains, read_table, write_csv, written


def col(spark, values, expression, kind="double"):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").orderBy("k").select(expression).collect()]


# --- expressions


def test_ifelse_keeps_missing(spark):
    assert col(spark, [1.0, None, 3.0], r_ifelse(F.col("x") > 2, F.lit("y"), F.lit("n"))) == ["n", None, "y"]


def test_rounding_and_number_text(spark):
    assert col(spark, [0.15, 0.25, 61.45, 2.0, -0.25, None], round_one(F.col("x"))) == [0.1, 0.2, 61.5, 2.0, -0.2, None]
    assert col(spark, [65.0, 65.5, None], number_text(F.col("x"))) == ["65", "65.5", None]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=20))
def test_rounded_is_a_nearest_neighbour(spark, values):
    for v, r in zip(values, col(spark, values, round_one(F.col("x")))):
        assert abs(r - v) <= 0.05 + 1e-9 * max(1, abs(v))


def test_iso_text(spark):
    got = col(spark, ["2020-01-02", "2020-01-02T10:20", "2020-01", "", None, "junk", "2020-13-45"], to_datetime(F.col("x")), "string")
    assert [str(x) for x in got] == ["2020-01-02 00:00:00", "2020-01-02 10:20:00", "None", "None", "None", "None", "None"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=8, unique=True), st.lists(st.floats(-80, 80), min_size=1, max_size=20))
def test_nearest_value(spark, cuts, xs):
    cuts = [float(c) for c in sorted(cuts)]
    for x, got in zip(xs, col(spark, xs, nearest_cut(F.col("x"), cuts))):
        assert abs(got - x) == pytest.approx(min(abs(c - x) for c in cuts))


def test_a_midpoint_goes_to_the_later(spark):
    assert col(spark, [10.5, 10.4, None], nearest_cut(F.col("x"), [0.0, 21.0])) == [21.0, 0.0, None]


def test_numbering_is_dense_and_ordered(spark):
    rows = number_rows(spark.range(1000).withColumn("v", F.xxhash64("id")), ["v"], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 1001)) and [r.v for r in rows] == sorted(r.v for r in rows)
    assert number_rows(spark.range(0), ["id"], "n").collect() == []


def test_names_that_clash_in_upper_case(spark):
    with pytest.raises(ValueError):
        upper_names(spark.createDataFrame([(1, 2)], "a int, b int").toDF("x", "X"))


# --- routes


@pytest.mark.parametrize("spelling, route", [("oral", "oral"), ("subcutaneous", "sc"), ("sc", "sc"), ("Intramuscular", "im"), ("IM", "im"), ("intravenous", "iv"), ("iv", "iv"), ("unknown", "oral")])
def test_routes(spark, spelling, route):
    assert get_route_from_data_column(spark.createDataFrame([(spelling,)], "r string"), "r") == route


def test_first_route_wins_with_a_warning(spark):
    rows = spark.createDataFrame([(1, None), (2, "sc"), (3, "iv")], "o int, r string")
    with pytest.warns(UserWarning):
        assert get_route_from_data_column(rows, "r", "o") == "sc"
    assert get_route_from_data_column(rows.where("o = 1"), "r", "o") == "oral"


# --- modeling tables


def test_modeling_to_modeling(spark):
    rows = spark.createDataFrame([(0, 5.0, 7), (1, 6.0, 7), (None, 4.0, 7), (2, 3.0, 7)], "evid int, dv double, group int")
    out = modeling_to_modeling(rows).orderBy("GROUP", "EVID").collect()
    assert [(r.EVID, r.DV, r.MDV, r.GROUP) for r in out] == [(None, None, None, 1), (0, 5.0, 0, 1), (1, 0.0, 1, 1), (2, 0.0, 1, 1)]
    assert {r.GROUP for r in modeling_to_modeling(rows, keep_existing_group=True).collect()} == {7}
    with_mdv = spark.createDataFrame([(1, 2.0, 9)], "EVID int, DV double, MDV int")
    assert modeling_to_modeling(with_mdv).first().MDV == 9


def test_modeling_to_nca(spark):
    rows = [(1, 0.0, 1, 0.0, 100.0), (1, 0.0, 0, 1.0, 0.0), (1, 5.0, 0, 2.0, 0.0), (1, 6.0, 1, 0.0, 50.0), (1, 7.0, 0, 3.0, 0.0), (1, 7.0, 2, 9.0, 0.0), (2, 1.0, 0, 4.0, 0.0)]
    out = modeling_to_nca(spark.createDataFrame(rows, "ID int, TIME double, EVID int, DV double, AMT double")).orderBy("ID", "TIME").collect()
    assert [(r.ID, r.TIME, r.DOSE) for r in out] == [(1, 0.0, 100.0), (1, 5.0, 100.0), (1, 7.0, 50.0), (2, 1.0, None)]


NCA = Dictionary(subject_id="SUBJ", time="T", dose="D", conc="C")


def test_nca_to_modeling_small(spark):
    rows = [(1, "b", 1.0, "10", 5.0, "x"), (2, "a", 1.0, "<LLOQ", 7.0, "y"), (3, "b", 0.0, "1e5", 6.0, "x"), (4, "a", 2.0, "3.5", 8.0, "y"), (5, "c", 1.0, None, 9.0, "z"), (6, "b", None, "2", 1.0, "x")]
    df = spark.createDataFrame(rows, "o int, SUBJ string, T double, C string, D double, COV string")
    got = nca_to_modeling(df, NCA, covariates=["COV"], order_by="o", ordered=True)
    assert got.columns == ["ID", "TIME", "CMT", "EVID", "MDV", "DV", "AMT", "GROUP", "ORIGID", "COV"]
    assert [tuple(r) for r in got.collect()] == [
        (1, 0.0, 1.0, 1.0, 1.0, 0.0, 5.0, 1, 1, 1), (1, 1.0, 1.0, 0.0, 0.0, 10.0, 0.0, 1, 1, 1), (1, None, 1.0, 0.0, 0.0, 2.0, 0.0, 1, 1, 1),
        (2, 0.0, 1.0, 1.0, 1.0, 0.0, 7.0, 1, 2, 2), (2, 2.0, 1.0, 0.0, 0.0, 3.5, 0.0, 1, 2, 2), (3, 0.0, 1.0, 1.0, 1.0, 0.0, 9.0, 1, 3, 3),
    ]
    with pytest.raises(ValueError):
        nca_to_modeling(df.withColumn("ID", F.lit(1)), NCA, covariates=["ID"])


def test_nca_numeric_concentrations_and_order_independence(spark):
    rows = [(k, f"s{k % 4}", float(k), 1.0e5 + k, 10.0) for k in range(40)]
    df = spark.createDataFrame(rows, "o int, SUBJ string, T double, C double, D double")
    one = sorted(map(tuple, nca_to_modeling(df, NCA, order_by="o").collect()))
    assert one == sorted(map(tuple, nca_to_modeling(df.orderBy(F.rand(3)), NCA, order_by="o").collect())) and len(one) == 44


# --- dispatch


def test_layouts_and_dispatch(spark):
    table = spark.createDataFrame([(0, 1.0)], "EviD int, dv double")
    assert detect_dataset_type(table) == "modeling" and detect_dataset_type({}) == "sdtm" and detect_dataset_type(spark.range(1)) == "nca"
    assert reformat_data(table, output_type="modeling").columns == ["EVID", "DV", "MDV", "GROUP"]
    with pytest.raises(UnsupportedConversion):
        reformat_data({}, output_type="nca")
    with pytest.raises(UnsupportedConversion):
        reformat_data(spark.range(1), output_type="nca")
    with pytest.raises(ValueError):
        reformat_data(table, output_type="other")
    with pytest.raises(TypeError):
        detect_dataset_type([1])


# --- demographics


def test_levels_that_nobody_has(spark):
    from pharmalith.operators.demographics import categorical_summary

    people = spark.createDataFrame([("A", "x"), ("B", "x"), ("A", "y"), (None, "y")], "sex string, arm string")
    got = sorted(map(tuple, categorical_summary(people, ["sex"], levels={"SEX": ["A", "C"]}).collect()))
    assert got == [("sex", "A", "2"), ("sex", "B", "1"), ("sex", "C", "0")]
    grouped = {(r.arm, r.level): r.value for r in categorical_summary(people, ["sex"], ["arm"], {"sex": ["A", "C"]}).collect()}
    assert grouped == {("x", "A"): "1", ("x", "B"): "1", ("x", "C"): "0", ("y", "A"): "1", ("y", "C"): "0"}


def test_first_row_of_a_subject_is_by_order(spark):
    dm = spark.createDataFrame([("s", 50.0, 2), ("s", 40.0, 1), ("t", 30.0, 9)], "USUBJID string, AGE double, ORD int")
    table = create_demographics_table({"dm": dm.repartition(4)}, ["age"], order_by="ORD")
    assert [r["Value/count"] for r in table.collect() if r.Statistic == "min_max"] == ["30 - 40"]


def study(spark, dm=range(10), vs=range(10), height_only=False):
    arms, races = ["A", "B", "C"], ["w", "x", "y", "z"]
    subjects = [("s", f"u{k}", arms[k % 3], races[k % 4], "FM"[k % 2], 30.0 + k * k) for k in dm]
    vitals = [(f"u{k}", "Height", f"{150 + k}.25") for k in vs] + ([] if height_only else [(f"u{k}", "Weight", f"{60 + k}.50") for k in vs])
    return {"dm": spark.createDataFrame(subjects, "STUDYID string, USUBJID string, ARM string, RACE string, SEX string, AGE double"), "vs": spark.createDataFrame(vitals, "USUBJID string, VSTEST string, VSSTRESC string")}


def cells(df):
    out, name = {}, None
    for r in df.collect():
        name = r["Demographic"] or name
        out[name, r["Statistic"]] = r["Value/count"]
    return out


def test_demographics(spark):
    table = create_demographics_table(study(spark), ["Age", "ARM", "weight", "nothing"])
    assert table.columns == ["Demographic", "Statistic", "Value/count"]
    rows = table.collect()
    assert [r["Statistic"] for r in rows][:4] == ["mean", "sd", "median", "min_max"] and rows[0]["Demographic"] == "age" and rows[1]["Demographic"] == ""
    got = cells(table)
    assert got["age", "mean"] == "58.5" and got["age", "min_max"] == "30 - 111" and got["arm", "A"] == "4" and got["arm", "B"] == "3" and got["weight", "median"] == "65"


def test_subjects_missing_on_either_side(spark):
    whole = cells(create_demographics_table(study(spark), ["height", "age"]))
    no_vitals = cells(create_demographics_table(study(spark, vs=range(5), height_only=True), ["height", "age"]))
    no_subjects = cells(create_demographics_table(study(spark, dm=range(5)), ["height", "age"]))
    assert whole["age", "mean"] == no_vitals["age", "mean"] and whole["height", "mean"] == no_subjects["height", "mean"]


def test_demographics_errors_groups_and_csv(spark, tmp_path):
    with pytest.raises(ValueError):
        create_demographics_table(study(spark), ["nothing"])
    grouped = create_demographics_table(study(spark), ["age"], group="ARM")
    assert grouped.columns[0] == "arm" and grouped.count() == 12
    path = str(tmp_path / "table.csv")
    create_demographics_table({"dm": study(spark)["dm"]}, ["age"], path=path)
    assert len(open(path).read().strip().split("\n")) == 5
    with pytest.raises(ValueError):
        write_csv(spark.createDataFrame([("a,b",)], "x string"), path)
    write_csv(spark.createDataFrame([(None, "b")], "x string, y string"), path)
    assert open(path).read() == "x,y\nNA,b\n"


# --- nominal times


def test_nominal_times(spark):
    times = [(t + j / 50,) for t in (0.0, 21.0, 42.0, 63.0) for j in range(20) for _ in range(3)]
    df = spark.createDataFrame(times, "TIME double")
    assert get_nominal_timepoints(df, "TIME", adjust=0.7) == [0, 21, 42, 64]
    out = add_nominal_timepoints(df, "TIME", "NOM", adjust=0.7)
    assert {r.NOM for r in out.collect()} == {0.0, 21.0, 42.0, 64.0}
    with pytest.raises(ValueError):
        get_nominal_timepoints(df.union(spark.createDataFrame([(None,)], "TIME double")), "TIME")


def test_one_peak_gives_floor_and_ceiling(spark):
    assert get_nominal_timepoints(spark.createDataFrame([(5.3 + j / 100,) for j in range(30)], "t double"), "t", adjust=2.0) == [5, 6]
    assert bandwidth(10, 0.0, 0.0, 0.0) == 0.9 * 10 ** -0.2 and bandwidth(10, 2.0, 0.0, 1.0) == pytest.approx(1.8 * 10 ** -0.2)


def test_density_of_many_rows_is_exact(spark):
    """200,000 rows, all distinct: the curve is the sum over every one of them, as numpy has it."""
    import numpy as np

    from pharmalith.operators.nominal import density

    df = spark.range(200_000).select((F.col("id") % 4 * 21 + F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e9).alias("t"))
    t = np.array([r.t for r in df.collect()])
    h = 0.7 * bandwidth(len(t), t.std(ddof=1), np.subtract(*np.quantile(t, [0.75, 0.25])), t.min())
    grid = np.linspace(t.min() - 3 * h, t.max() + 3 * h, 512)
    want = np.array([np.exp(-0.5 * ((g - t) / h) ** 2).sum() for g in grid]) / (len(t) * h * math.sqrt(2 * math.pi))
    got = density(df, "t", adjust=0.7).orderBy("i").collect()
    assert np.allclose([r.gx for r in got], grid) and np.allclose([r.y for r in got], want, rtol=1e-9, atol=1e-300)


def test_quantiles_are_those_of_numpy(spark):
    import numpy as np

    from pharmalith.operators.nominal import quantiles

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 501):
        values, counts = np.unique(rng.integers(0, 50, n) / 7, return_counts=True)
        df = spark.createDataFrame(list(zip(values.tolist(), counts.tolist())), "t double, n long")
        every = np.repeat(values, counts)
        assert quantiles(df, n, [0.0, 0.25, 0.5, 0.75, 1.0]) == pytest.approx(np.quantile(every, [0.0, 0.25, 0.5, 0.75, 1.0]).tolist())


def test_unknown_frequency_raises_and_terms_follow_rules(spark):
    from pharmalith.operators.sdtm import FREQUENCIES, with_dosing_interval

    rows = spark.createDataFrame([("qd ",), ("Q8H",), ("3 TIMES PER WEEK",), ("EVERY 2 WEEKS",), ("Q45MIN",), ("ONCE",), (None,)], "f string")
    assert [r.h for r in with_dosing_interval(rows, "f", "h").collect()] == [24.0, 8.0, 56.0, 336.0, 0.75, 0.0, 0.0]
    with pytest.raises(Exception, match="no interval is known"):
        with_dosing_interval(spark.createDataFrame([("PRN",)], "f string"), "f", "h").collect()
    assert FREQUENCIES["BID"] == 12 and FREQUENCIES["QM"] == 730.5 and len(FREQUENCIES) > 500


def test_closing_deletes_written_tables(tmp_path):
    from pharmalith.sources import shared

    gone = []

    class Fake:
        class sparkContext:
            applicationId = "app-1"

    before = shared._delete
    shared._delete, shared.shared_dir, kept = lambda spark, path: gone.append(path), lambda spark: "file:///x", shared.shared_dir
    try:
        close(Fake)
        assert gone == ["file:///x/pharmalith-app-1"] and shared.fresh_path(Fake, "t").startswith(gone[0] + "/t-")
    finally:
        shared._delete, shared.shared_dir = before, kept


def test_shuffle_setting_is_restored(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    table = written(spark.range(100).repartition(3, "id"), "t")
    assert spark.conf.get(name) == before and table.count() == 100 and table.groupBy("id").count().count() == 100


# --- study domains


def domains(spark, ex, pc, vs=None):
    adsl = spark.createDataFrame([("01", "01-2-3", "3", "2", 40.0, "F", "w", "n", "A", "A", "US")], "STUDYID string, USUBJID string, SUBJID string, SITEID string, AGE double, SEX string, RACE string, ETHNIC string, ARM string, ACTARM string, COUNTRY string")
    e = "STUDYID string, USUBJID string, EXSEQ int, EXTRT string, EXDOSE double, EXDOSU string, EXDOSFRQ string, EXDOSFRM string, EXROUTE string, EXSTDTC string, EXENDTC string, VISITDY int"
    p = "STUDYID string, USUBJID string, PCTESTCD string, PCTEST string, PCDTC string, PCTPTNUM double, PCSTRESC string, PCSTRESN double, PCSTRESU string, PCLLOQ double"
    v = "STUDYID string, USUBJID string, VSTESTCD string, VSSTRESN double, VSBLFL string"
    return {
        "ADSL": adsl, "EX": spark.createDataFrame([("01", "01-2-3", s, "D", dose, "mg", f, "TABLET", "Oral", a, b, day) for s, dose, f, a, b, day in ex], e),
        "PC": spark.createDataFrame([("01", "01-2-3", "C", "D", at, n, c, x, "ng", 1.0) for at, n, c, x in pc], p),
        "VS": spark.createDataFrame(vs or [("01", "01-2-3", "WEIGHT", 70.0, "Y"), ("01", "01-2-3", "WEIGHT", 71.0, "N")], v), "LB": spark.createDataFrame([], "STUDYID string, USUBJID string, LBTESTCD string, LBSTRESN double, LBBLFL string"),
    }


EX = [(1, 100.0, "ONCE", "2020-01-01T08:00", None, 1), (2, 0.0, "ONCE", "2020-01-01T09:00", None, 1), (3, 50.0, "BID", "2020-01-02T08:00", "2020-01-03", 1)]
PC = [("2020-01-01T08:00", -1.0, "5", 5.0), ("2020-01-01T09:30", 1.0, "<BLQ", None), ("2020-01-02T12:00", 4.0, "6", 6.0)]


def test_sdtm_to_modeling(spark):
    rows = sdtm_to_modeling(domains(spark, EX, PC), ordered=True).collect()
    assert [(r.TIME, r.DV, r.EVID, r.AMT, r.MDV) for r in rows] == [(0.0, 5.0, 0, None, 0), (0.0, None, 1, 100.0, 1), (0.0, None, 1, 50.0, 1), (4.0, 6.0, 0, None, 0), (12.0, None, 1, 50.0, 1)]
    assert {(r.ID, r.SEXN, r.WT, r.COHORT, r.COUNTRY) for r in rows} == {("3", 2, 70.0, "A", "US")} and {r.ROUTE for r in rows} == {None, "oral"}
    assert len(rows[0]) == 18


def test_doses_after_the_last_sample_go_and_undosed_samples_too(spark):
    assert sdtm_to_modeling(domains(spark, EX, PC[:1])).where("EVID = 1").count() == 1
    assert sdtm_to_modeling(domains(spark, EX[1:2], PC)).count() == 0


def test_ties_and_repeated_vitals_raise(spark):
    with pytest.raises(Exception, match="not unique"):
        sdtm_to_modeling(domains(spark, EX, [*PC, PC[0]])).collect()
    assert sdtm_to_modeling(domains(spark, EX, [*PC, PC[0]]), validate=False).count() == 6
    with pytest.raises(Exception, match="more than one baseline weight"):
        sdtm_to_modeling(domains(spark, EX, PC, [("01", "01-2-3", "WEIGHT", 70.0, "Y")] * 2)).collect()


def test_dose_expansion_caps_like_filtering_after(spark):
    from pharmalith.operators.sdtm import prepare_ex, upper_domains

    ex = prepare_ex(upper_domains(domains(spark, [(k, 10.0, f, "2020-01-01", "2020-01-04", d) for k, (f, d) in enumerate([("QD", 1), ("BID", 1), ("TID", 2), ("QID", 1), ("QOD", 1), ("ONCE", 1), ("ONCE", 8), (None, 1)])], PC)))
    key = ["EXSEQ", "ADTM", "NFRLT"]
    capped, whole = expand_doses(ex).select(key), expand_doses(ex, first_day_only=False)
    assert sorted(map(str, capped.collect())) == sorted(map(str, whole.where("AVISITN = 1").select(key).collect()))
    counts = {r.EXSEQ: r["count"] for r in whole.groupBy("EXSEQ").count().collect()}
    assert counts == {0: 4, 1: 8, 2: 12, 3: 16, 4: 2, 5: 1, 6: 1, 7: 1}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=8), st.lists(st.integers(0, 8), max_size=8))
def test_asof_is_strict(spark, left, right):
    a = spark.createDataFrame([("k", float(x), n) for n, x in enumerate(left)], "USUBJID string, t double, n int")
    b = spark.createDataFrame([("k", float(x), n) for n, x in enumerate(right)], "USUBJID string, t double, s int")
    got = {r.n: (r.tp, r.sp) for r in asof_strict(a, b, "USUBJID", "t", {"t": "tp", "s": "sp"}, "s").collect()}
    for n, x in enumerate(left):
        assert got[n] == max(((float(y), k) for k, y in enumerate(right) if y < x), default=(None, None))


def test_nca_rows(spark):
    data = domains(spark, EX, PC)
    rows = get_data_for_nca(spark, data={"pc": data["PC"], "ex": data["EX"], "dm": data["ADSL"]}).orderBy("TIME").collect()
    assert [(r.TIME, r.CONC, r.DOSE, r.GROUP) for r in rows] == [(0.0, "5", 100.0, "A"), (1.5, "<BLQ", 100.0, "A"), (28.0, "6", 100.0, "A")]


def test_reading_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/x.parquet")
    assert read_table(spark, f"file://{tmp_path}", "x").count() == 3
    (tmp_path / "y.csv").write_text("a,b\n1,NA\n")
    assert read_table(spark, f"file://{tmp_path}", "y", format="csv").first().b is None
    with pytest.raises(ValueError):
        read_table(spark, f"file://{tmp_path}", "y", format="xml")


def test_reading_by_jdbc(spark, tmp_path):
    """A database that comes with Spark."""
    db = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(1, "a"), (2, None)], "K int, V string").write.format("jdbc").options(**db).option("dbtable", "PC").save()
    assert sorted(map(tuple, read_domains(spark, db, ["PC"])["pc"].collect())) == [(1, "a"), (2, None)]


def test_example_data(spark):
    rows = get_data_for_modelfit(spark).collect()
    assert len(rows) > 300 and len(rows[0]) == 18 and {r.EVID for r in rows} == {0, 1}
    nca = get_data_for_nca(spark).collect()
    assert len(nca) > 300 and {r.GROUP for r in nca} == {"LOW DOSE", "HIGH DOSE"} and {r.DOSE for r in nca} == {50.0, 100.0}
    example = nm_data_timepoints(spark)
    assert (example.count(), len(example.columns)) == (3600, 20)
    assert [r.NOM for r in add_nominal_timepoints(example, "TIME", "NOM", adjust=0.7).where("ID = 1").orderBy("TIME").collect()][::5] == [0, 21, 42, 64]


# --- sampling


@pytest.fixture(scope="module")
def people(spark):
    rows = [(40.0 + k % 50, 150.0 + k % 40 + (k % 50) / 5, None if k % 7 == 0 else 20.0 + k % 60, "FM"[k % 2]) for k in range(400)]
    return spark.createDataFrame(rows, "WT double, HT double, AGE double, SEX string")


def test_bootstrap(spark, people):
    out = sample_covariates_bootstrap(people, 1000, {"WT": (50, 60)}, seed=3)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == 1000 and set(rows) <= {tuple(r) for r in people.collect()} and all(50 <= r[0] <= 60 for r in rows)
    assert sample_covariates_bootstrap(people, conditional={"WT": (50, 60)}).count() == people.where("WT between 50 and 60").count()
    with pytest.raises(ValueError):
        sample_covariates_bootstrap(people, 10, {"WT": (900, 901)})


@pytest.mark.parametrize("log", [False, True])
def test_mvtnorm_keeps_moments(spark, people, log):
    out = sample_covariates(people.select("WT", "HT"), "mvtnorm", n_subjects=4000, exponential=log, seed=5)
    f = F.ln if log else (lambda c: F.col(c))
    a = people.agg(F.avg(f("WT")), F.stddev(f("WT")), F.corr(f("WT"), f("HT"))).first()
    b = out.agg(F.avg(f("WT")), F.stddev(f("WT")), F.corr(f("WT"), f("HT"))).first()
    assert abs(a[0] - b[0]) < 4 * a[1] / math.sqrt(4000) and abs(a[1] / b[1] - 1) < 0.06 and abs(a[2] - b[2]) < 0.06
    with pytest.raises(ValueError):
        sample_covariates_mvtnorm(people.select("WT", "AGE"))


def test_mice(spark, people):
    out = sample_covariates_mice(people, ["SEX"], {"WT": (50, 60)}, n_subjects=500, seed=2)
    rows = out.collect()
    assert len(rows) == 500 and all(50 <= r.WT <= 60 for r in rows) and all(None not in tuple(r) for r in rows)
    seen = {c: {r[c] for r in people.select(c).collect()} for c in ("HT", "AGE", "SEX")}
    assert all(r[c] in seen[c] for r in rows for c in seen)
    again = sample_covariates_mice(people.repartition(3), ["SEX"], {"WT": (50, 60)}, n_subjects=500, seed=2).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    with pytest.raises(ValueError):
        sample_covariates(people, "other")


def test_imputation_keeps_relations(spark):
    """Values missing at random by another column: means, spread and correlation come out as in the whole table, and no row needs to be complete."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(60, 10, 3000)
    y = 2 * x + rng.normal(0, 8, 3000)
    g = np.where(x + rng.normal(0, 5, 3000) > 60, "b", "a")
    hide = rng.random(3000) < np.clip((x - 45) / 30, 0.05, 0.9)
    lost = ~hide & (rng.random(3000) < 0.3)
    rows = [(None if lost[k] else float(x[k]), None if hide[k] else float(y[k]), None if k % 5 == 0 else str(g[k]), float(k)) for k in range(3000)]
    for method in ("pmm", "norm"):
        out = impute_missing(spark.createDataFrame(rows, "x double, y double, g string, k double"), ["g"], iterations=6, cont_method=method, seed=4).orderBy("k").collect()
        a, b = np.array([r.x for r in out]), np.array([r.y for r in out])
        assert len(out) == 3000 and all(r.y == rows[k][1] for k, r in enumerate(out) if rows[k][1] is not None)
        assert abs(b.mean() - y.mean()) < 1.5 and abs(b.std() / y.std() - 1) < 0.08 and abs(np.corrcoef(a, b)[0, 1] - np.corrcoef(x, y)[0, 1]) < 0.05
        assert np.mean([r.g == g[k] for k, r in enumerate(out)]) > 0.9
        if method == "pmm":
            assert {r.y for r in out} <= {r[1] for r in rows}
    none_whole = [(1.0 * k, None) if k % 2 else (None, 2.0 * k) for k in range(200)]
    got = impute_missing(spark.createDataFrame(none_whole, "x double, y double"), iterations=2).collect()
    assert len(got) == 200 and all(None not in tuple(r) for r in got)
    with pytest.raises(ValueError):
        impute_missing(spark.createDataFrame([(1.0, None)], "x double, y double"))


def test_donors_of_all_ranges(spark, monkeypatch):
    """With many ranges and salts each row gets one of its five nearest donors, as by sorting all of them."""
    import numpy as np

    from pharmalith.operators import sampling

    monkeypatch.setattr(sampling, "RANGE_DONORS", 40)
    monkeypatch.setattr(sampling, "RANGE_ROWS", 10)
    rng = np.random.default_rng(5)
    fitted, guess, u = rng.normal(size=900), rng.normal(size=400) * 1.5, rng.random(400)
    donors = spark.createDataFrame([(float(v), float(k)) for k, v in enumerate(fitted)], "v double, value double")
    asked = spark.createDataFrame([(2**60 + k, float(v), float(w)) for k, (v, w) in enumerate(zip(guess, u))], "_id long, v double, u double")
    got = {r["_id"]: r.value for r in sampling._donated(asked, donors).collect()}
    order = np.argsort(fitted)
    want = sampling.nearest_donor(guess, u, fitted[order], order.astype(float))
    assert [got[2**60 + k] for k in range(400)] == want.tolist()
    assert all(got[2**60 + k] in np.argsort(np.abs(fitted - guess[k]))[:5] for k in range(400))


# --- streams


def test_streams(spark, tmp_path):
    from pharmalith.streaming import modeling_stream, route_stream

    spark.createDataFrame([(0, 5.0, "SC"), (1, 6.0, None)], "EVID int, DV double, R string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("EVID int, DV double, R string").parquet(f"file://{tmp_path}/in")
    query = route_stream(modeling_stream(stream), "R").writeStream.format("memory").queryName("events_out").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.EVID, r.DV, r.ROUTE) for r in spark.table("events_out").collect()) == [(0, 5.0, "sc"), (1, 0.0, "oral")]
