"""List parsing, domain keys, scope, merge, gates: golden cases and invariance to order."""

import re

import pytest
from pyspark.sql import functions as F

from policyspark.functions import domains as fd
from policyspark.operators import domains as dm
from policyspark.sources import lists as ls


def lines(spark, fmt, values):
    return spark.createDataFrame([("s", "c", fmt, v) for v in values], "source string, category string, format string, value string")


def entries(df):
    return sorted((r.domain, r.scope_hint) for r in ls.raw_entries(df).collect())


def report(df):
    return {r.outcome: r.n for r in ls.parse_report(df).collect()}


def test_plain_and_hosts_lines(spark):
    d = lines(spark, "plain", ["# a comment", "", "   ", "example.com"])
    assert entries(d) == [("example.com", "none")] and report(d) == {"blank": 3, "entry": 1}
    assert entries(lines(spark, "plain", ["example.com # flagged 2024-01"])) == [("example.com", "none")]
    assert entries(lines(spark, "hosts", ["0.0.0.0 example.com", "127.0.0.1 other.example.com"])) == [("example.com", "none"), ("other.example.com", "none")]
    wild = lines(spark, "plain", ["*.example.com", "*."])
    assert entries(wild) == [("*.", "none"), ("example.com", "apex")] and report(wild) == {"entry": 2, "wildcard": 1}
    assert report(lines(spark, "hosts", ["0.0.0.0 0.0.0.0", "0.0.0.0 example.com", "::1"])) == {"entry": 1, "ip_literal": 1, "malformed": 1}


@pytest.mark.parametrize(
    "name,key",
    [("Example.COM", "example.com"), ("example.com.", "example.com"), ("", None), (".", None), ("foo..com", None), (".example.com", None), ("exa mple.com", None), ("exa/mple.com", None), ("[::1]", None),
     ("müller.de", "xn--mller-kva.de"), ("MÜLLER.DE", "xn--mller-kva.de"), ("_dmarc.google.com", "_dmarc.google.com"), ("under_score.com", "under_score.com"), ("a" * 63 + ".com", "a" * 63 + ".com"), ("a" * 64 + ".com", None)],
)
def test_domain_keys(spark, name, key):
    df = spark.createDataFrame([(name,)], "d string")
    assert df.select(fd.normalize_domain(F.col("d")).alias("k")).first().k == key


def scoped(spark, name, hint="apex", denied=()):
    e = spark.createDataFrame([(name, hint)], "domain string, scope_hint string")
    rules = spark.createDataFrame([(r,) for r in ("com", "net", "org", "uk", "co.uk", "blogspot.com", "s3.amazonaws.com", "*.ck", "!www.ck")], "rule string")
    return dm.with_scope(e, rules, spark.createDataFrame([(d,) for d in denied], "value string")).first().scope


def test_scope(spark):
    assert scoped(spark, "example.com") == "apex" and scoped(spark, "www.example.com") == "exact_host"
    assert scoped(spark, "example.com", "none") == "exact_host"
    for suffix in ("com", "co.uk", "s3.amazonaws.com", "blogspot.com"):
        assert scoped(spark, suffix) == "exact_host"
    assert scoped(spark, "someone.blogspot.com") == "apex" and scoped(spark, "cdn.someone.blogspot.com") == "exact_host"
    assert scoped(spark, "www.ck") == "apex" and scoped(spark, "a.b.ck") == "apex" and scoped(spark, "b.ck") == "exact_host"
    assert scoped(spark, "example.com", denied=["Example.com."]) is None


def test_merge_in_any_order_and_partitioning(spark):
    raw = [("example.com", "alpha", "adult", "none"), ("EXAMPLE.com.", "beta", "gambling", "apex"), ("example.com", "beta", "adult", "none"), ("a.example.com", "beta", "adult", "apex"), ("bad..name", "beta", "adult", "none"), ("shared.example", "beta", "adult", "none"), ("10.1.1.1", "beta", "x", "none")]
    rules, deny = spark.createDataFrame([("com",)], "rule string"), spark.createDataFrame([("Shared.example.",)], "value string")
    results = set()
    for rows, parts in ((raw, 1), (raw[::-1], 3), (raw[3:] + raw[:3], 5)):
        done = dm.classified(spark.createDataFrame(rows, "domain string, source string, category string, scope_hint string").repartition(parts), rules, deny)
        results.add(tuple(sorted((r.domain, r.scope, tuple(r.sources), tuple(r.categories)) for r in dm.merge(done).collect())))
        assert {r.outcome: r.n for r in dm.merge_report(done).collect()} == {"merged": 4, "not_normal": 1, "denylisted": 1, "ip_literal": 1}
    assert results == {(("a.example.com", "exact_host", ("beta",), ("adult",)), ("example.com", "apex", ("alpha", "beta"), ("adult", "gambling")))}


def test_personal_names(spark):
    names = {"red-panda": True, "john.q.public": True, "mary.jane.smith.jones": True, "jane_doe": True, "jane-doe.smith": True, "janedoe": False, "a.b.c.d.e": False, "panda99-red": False, "": False, "xn--mller-kva": False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.f for r in df.select("n", fd.looks_like_personal_name(F.col("n")).alias("f")).collect()} == names


@pytest.mark.parametrize("previous,current,limit,floor,passed", [(1000, 950, 0.1, 0, True), (1000, 900, 0.1, 0, True), (1000, 899, 0.1, 0, False), (None, 5, 0.1, 10, False), (None, 5, 0.1, 0, True), (1000, 950, 0.1, 1000, False), (1000, 950, float("nan"), 0, False), (1000, 950, 1.5, 0, False), (1000, 950, -0.1, 0, False)])
def test_shrinkage(spark, previous, current, limit, floor, passed):
    counts = spark.createDataFrame([(previous, current)], "previous long, current long")
    assert dm.shrinkage_gate(counts, limit, floor).first().passed is passed


def test_false_positive_gate(spark):
    build = spark.createDataFrame([("n1.com", ["a"]), ("n2.com", ["a", "b"])], "domain string, sources array<string>")
    none = spark.createDataFrame([], "value string")
    control = lambda n, extra="n1.com": spark.createDataFrame([(extra,)] + [(f"x{i}.com",) for i in range(n - 1)], "value string")
    gate = lambda c, limit=0.005, least=1: dm.false_positive_gate(build, c, none, limit, least).first().passed
    assert not gate(control(100)) and gate(control(200)) and gate(control(10, "n2.com"), 0.0)
    assert not gate(control(2), 0.5, 1000) and gate(none, 0.005, 0)


def test_licences_and_snapshots(spark):
    s = lambda *rows: spark.createDataFrame(rows, "source string, category string, revision string, license string, fetched_at long")
    assert dm.output_license(s(("a", "x", "1", " mit", 1), ("b", "x", "1", "GPL-3.0", 1))).first()[0] == "GPL-3.0"
    assert dm.output_license(s(("a", "x", "1", "odd", 1), ("b", "x", "1", "MIT", 1))).first()[0] == "UNKNOWN"
    assert dm.output_license(s(("a", "x", "1", "MIT", 1)).limit(0)).first()[0] == "UNKNOWN"
    c = {r.source: r for r in dm.collapse_snapshots(s(("a", "y", "2", "MIT", 5), ("a", "x", "1", "mit ", 3), ("b", "x", "1", "MIT", 1), ("b", "y", "1", "GPL", 1))).collect()}
    assert c["a"].revision == "x=1;y=2" and c["a"].fetched_at == 3 and c["b"].license is None


def test_user_list(spark):
    rows = ["Ads.Example.COM. # x", "ADS.example.com.", "http://x.com/", "x.com:53", "0.0.0.0 x.com", ".x", "a..b", "a" * 64 + ".com", ""]
    df = spark.createDataFrame(list(enumerate(rows)), "line_no int, value string")
    assert [tuple(r) for r in ls.user_blocklist(df).collect()] == [("ads.example.com", 0)]


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "l/adult").mkdir(parents=True)
    (tmp_path / "l/adult/domains").write_text("a.com\n")
    (tmp_path / "l/adult/urls").write_text("a.com/x\n# c\n")
    assert [(r.category, r.value) for r in ls.read_category_dirs(spark, str(tmp_path / "l"), "ut1").collect()] == [("adult", "a.com")]
    assert ls.count_urls_entries(ls.read_lines(spark, str(tmp_path / "l/adult/urls"), "u", "c", "plain")).first()[0] == 1
    assert [r.value for r in ls.read_param_list(spark, str(tmp_path / "l/adult/urls")).collect()] == ["a.com/x"]
    df = spark.createDataFrame([(5, 6, "EV", "de\ttail\n" + "x" * 200)], "w long, e long, ev string, d string")
    line = df.select(ls.tamper_line(*[F.col(c) for c in df.columns]).alias("value"))
    back = ls.read_tamper_lines(line.unionAll(spark.createDataFrame([("rubbish",), ("x\t1\tE\td",)], "value string"))).collect()
    assert [(r.wall_ms, r.elapsed_ms, r.event, len(r.detail), r.detail[:8]) for r in back] == [(5, 6, "EV", 120, "de tail ")]
    with pytest.raises(ValueError):
        ls.binary_corpus(spark, str(tmp_path))


def test_admission(spark):
    s = spark.createDataFrame([("a", "1", "MIT"), ("b", "2", "MIT"), ("c", "1", "GPL"), ("d", "1", "odd")], "source string, revision string, license string")
    e = spark.createDataFrame([("b", "1", "GPL"), ("c", "1", "MIT")], "source string, revision string, license string")
    got = {r.source: r.admission for r in ls.admission(s, e, spark.createDataFrame([("mit ",), ("gpl",)], "value string")).collect()}
    assert got == {"a": "admitted", "b": "revision_mismatch", "c": "license_changed", "d": "license_not_allowed"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_addresses_are_told_without_python(spark):
    names = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1::3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "1::2::3", ":1::", "1:::2", "::ffff:10.0.0.1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "::01.2.3.4", "::256.1.1.1", "::12345", "::g", "::%e0", "::%", "::%a%b", "::/64", "::%a/64", "::1\n", "a:b", ":", "FE80::aB%e", "1:2:3:4::5:6:7:8"]
    df = spark.createDataFrame([(x,) for x in names], "n string").select("n", fd.is_ip_literal(F.col("n")).alias("ip"))
    assert {r.n: r.ip for r in df.collect()} == {x: _parses(x) for x in names} and "EvalPython" not in _plan(df)
    few = spark.createDataFrame([("10.1.2.3", True), ("10.1.2.256", False), (None, False), ("x.com", False)], "n string, want boolean")
    assert few.where(fd.is_ip_literal(F.col("n")) != F.col("want")).count() == 0


def _parses(x):
    import ipaddress

    try:
        return ipaddress.ip_address(x) is not None
    except ValueError:
        return False


def test_python_of_a_task_of_lists_is_one_worker(spark):
    """Names beyond ASCII alone go to Python, once a task; small tables of the driver are part of the plan."""
    from policyspark.plans import lists

    plan = _plan(lists.done(spark, "/root/testdata/sf0.001"))
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan
    assert set(re.findall(r"\w*EvalPython \[(\w+)", plan)) == {"encoded"}


def test_local_tables(spark):
    from policyspark.functions.tables import local_table

    schema = "a int, b string, c array<string>, d array<struct<e:string,f:bigint>>"
    rows = [(1, None, [], [("x", 2)]), (None, "é", ["p", None], [])]
    got = local_table(spark, [(a, b, c, [dict(zip("ef", x, strict=True)) for x in d]) for a, b, c, d in rows], schema)
    assert [tuple(r) for r in got.collect()] == rows and got.schema == spark.createDataFrame([], schema).schema
    assert local_table(spark, [], schema).collect() == [] and local_table(spark, [], schema).schema == got.schema
