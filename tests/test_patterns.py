"""Expressions by what they must contain, paths that don't grow with loops, exact p-values, and codes of many categories."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from agrarium.functions import patterns
from agrarium.operators import drift, joins, prepare


def test_literals_are_in_every_match():
    cases = {"abc": ["abc"], "a(bcd)+e": ["bcd"], "x?yz": ["yz"], "mys(ore|uru) t": ["mys"], "foo|barbaz": ["barbaz", "foo"], "foo|x*": None, ".*": None, "[a-z]+": None, "(ab){0,2}": None, "(?i:QUX)": ["qux"], "(?P<n>abc)d": ["abc"], "a.{3}bcde": ["bcde"], "(": None}
    assert {p: patterns.literals(p) for p in cases} == cases
    rng = random.Random(3)
    for _ in range(2_000):
        pattern = "".join(rng.choice(["a", "b", "c", "ab", "[ab]", ".", "c?", "(a|bc)", "b+", "(ca)*", "\\w", "|"]) for _ in range(rng.randrange(1, 6)))
        text = "".join(rng.choices("abcABC", k=rng.randrange(0, 9)))
        needed = patterns.literals(pattern)
        if needed and re.search(pattern, text, re.IGNORECASE):
            assert any(x in text.lower() for x in needed), (pattern, text)


def test_java_gets_only_what_it_reads_alike(spark):
    rng = random.Random(4)
    parts = ["a", "b", "É", "k", "ı", "ß", "1", " ", "[ab]", "[^a-c]", ".", "?", "*", "+", "+?", "{1,2}", "{", "}", "(a|b)", "(?:ab)", "(?=a)", "(?P<x>a)", "(?<=a)", "\\d", "\\w", "\\s", "\\b", "\\.", "^", "$", "|", "[[]", "[a&&b]", "]", "\\Z", "(", ")"]
    tried = [("".join(rng.choices(parts, k=rng.randrange(1, 5))), "".join(rng.choice("abÉékKıIß12 .\n") for _ in range(rng.randrange(0, 7)))) for _ in range(3_000)]
    rows = [(p, t, bool(re.search(p, t, re.IGNORECASE))) for p, t in tried if patterns.plan_of(p)[:2] == (True, True)]
    assert len(rows) > 800
    got = spark.createDataFrame(rows, "p string, t string, want boolean").withColumn("got", F.rlike("t", F.concat(F.lit(patterns.JAVA), "p"))).where("got <> want").collect()
    assert not got


def test_staged_expressions_equal_all_pairs(spark, capsys):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice(["ka", "ri", "Mys", "ore ", "uru", "T"]) for _ in range(rng.randrange(1, 6)))) for i in range(300)]
    probes = ["mys(ore|uru) t", "^ka.*ri$", ".*", "[x-z]", "(?P<a>ri)(?P=a)", "k(?!a)", "t{2}", "(", "uru|zzz", "^$", "Kari", "ka ri?$", "(?<=ri)MYS"]
    got = {r.probe: (r.matched, r.stage) for r in joins.staged_name_match(spark.createDataFrame([(p,) for p in probes], "probe string"), spark.createDataFrame(texts, "pos int, name string"), "probe", "name", "pos", raw="name").collect()}
    for p in probes:
        plain = next((t for _, t in texts if t.strip() == p), None) or next((t for _, t in texts if p.lower() in t.lower()), None)
        if plain is None and p != "(":
            hit = next((t for _, t in texts if re.search(p, t, re.IGNORECASE)), None)
            assert got.get(p) == ((hit, 4) if hit is not None else None), p
    big = spark.range(10**7).selectExpr("id pos", "concat('n', id) name")
    joins.staged_name_match(spark.range(10**6).selectExpr("concat('^n.*', id) probe"), big, "probe", "name", "pos", raw="name").explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BatchEvalPython" not in plan


def test_paths_leave_out_loops_and_what_leads_to_them(spark):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(40)] + [(100, 101, "a"), (101, 100, "b"), (102, 100, "c"), (103, 103, "d"), (104, 999, "e"), (None, 1, "f")]
    got = {r.k: r.path for r in joins.root_paths(spark.createDataFrame(rows, "k long, p long, n string"), "k", "p", "n").collect()}
    assert got == {i: [f"n{j}" for j in range(i, -1, -1)] for i in range(40)} | {104: ["e"]}
    assert joins.root_paths(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "k long, p long, n string"), "k", "p", "n").count() == 0
    assert joins.root_paths(spark.createDataFrame([], "k long, p long, n string"), "k", "p", "n").count() == 0


def test_one_loop_among_many_nodes_does_not_grow(spark):
    nodes = spark.range(1_000_000).selectExpr("id k", "case when id = 0 then 1L when id = 1 then 0L when id < 10 then null else id div 10 end p", "cast(id as string) n")
    found = joins.root_paths(nodes, "k", "p", "n").agg(F.count("*").alias("n"), F.max(F.size("path")).alias("longest")).first()
    # All below node 1 lead to the loop: 1, 10-19, 100-199, ...
    assert found.n == 1_000_000 - 1 - sum(10**i for i in range(6)) and found.longest == 6


def test_exact_p_equals_enumeration():
    for n, m in [(1, 1), (2, 3), (4, 4), (3, 7), (8, 8), (5, 8)]:
        ways: dict[int, int] = {}
        for own in itertools.combinations(range(n + m), n):
            i = j = worst = 0
            for s in range(n + m):
                i, j = (i + 1, j) if s in own else (i, j + 1)
                worst = max(worst, abs(i * m - j * n))
            ways[worst] = ways.get(worst, 0) + 1
        every = sum(ways.values())
        for d in ways:
            assert drift.exact_ks_p(d / (n * m), n, m) == pytest.approx(sum(w for k, w in ways.items() if k >= d) / every), (n, m, d)
    assert drift.exact_ks_p(0.0, 5, 5) == 1.0 and drift.exact_ks_p(0.5, 0, 5) == 1.0
    assert drift.exact_ks_p(0.05, 2_000, 3_000) == pytest.approx(drift.ks_p_value(0.05, 2_000, 3_000), rel=0.1)


def test_many_categories_are_numbered_in_ranges(spark):
    df = spark.range(20_000).selectExpr("id", "concat('c', id % 3000) c")
    got = {r.category: r.code for r in prepare.categories(df, "c", "id").collect()}
    assert got == {f"c{i}": i for i in range(3_000)}
    assert prepare.categories(df.limit(0), "c", "id").count() == 0
    with pytest.raises(ValueError, match="more than 100"):
        prepare.TabularPipeline([], ["c"], "id", most_categories=100).fit(df)


def test_empty_reference_of_periods(spark):
    df = spark.createDataFrame([(1, 2.0)], "p int, x double")
    assert drift.temporal_psi(df, F.col("p"), "x", df.limit(0)).count() == 0
